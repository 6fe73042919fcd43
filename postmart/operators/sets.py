"""Set operations on ids, unions of seed files, and the folder walk."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postmart.functions.scalars import is_blank
from postmart.operators.skew import join_facts
from postmart.operators.windows import first_wins
from postmart.session import checkpoint_dir, cut_lineage, delete_on_exit
from postmart.sources.files import resolved_paths, scan_jsonl_strict


def union_seeds(frames: list[DataFrame], line: str = "line_no") -> DataFrame:
    """Union of seed tables in precedence order; later frames win in :func:`merge_versions`.

    Adds ``source_rank``.  A frame passed twice counts once, at its first place; for files see ``read_seeds``."""
    distinct = list({id(frame): frame for frame in frames}.values())
    ranked = [frame.withColumn("source_rank", F.lit(rank)) for rank, frame in enumerate(distinct)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def read_seeds(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame | None:
    """Union of seed archives in precedence order, see ``union_seeds``.  A path that leads to the same place as an
    earlier one counts once, a missing one not at all; None when there are none."""
    frames = [scan_jsonl_strict(spark, path, schema) for path in resolved_paths(spark, paths)]
    return union_seeds(frames) if frames else None


def distinct_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.where(~is_blank(F.col(key).cast("string"))).select(F.col(key).cast("string").alias("id")).distinct()


def ids_except(after: DataFrame, before: DataFrame) -> DataFrame:
    return distinct_ids(after).subtract(distinct_ids(before))


def page_overlap(earlier: DataFrame, page: DataFrame) -> DataFrame:
    """Ids of a page that earlier pages already showed."""
    return distinct_ids(page).intersect(distinct_ids(earlier))


def walk_folders(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first walk: every reachable folder once, at its first visit.

    ``edges``: (parent, child, pos) with ``pos`` the place of the child on the parent's pages.
    ``roots``: (folder).  Output: (folder, depth, path), where ``path`` is the list of places from the
    root; (depth, path) sorts folders in visiting order.  One join per level.  Every level is a folder of its own,
    written once, and the visited set is all of them together: what is written follows the frontier, the plan does
    not grow with depth, and any fan-out stays distributed."""
    spark = edges.sparkSession
    edges = edges.where(~is_blank(F.col("child").cast("string")))
    # Counted once, so that a folder with very many children is known as a hot key at every level.
    sizes = cut_lineage(edges.groupBy("parent").agg(F.count(F.lit(1)).alias("__n")))
    root = f"{checkpoint_dir(spark)}/walk-{uuid.uuid4().hex}"
    frontier = roots.select("folder", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"))
    schema, level = frontier.schema, 0

    def stored(*levels: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{root}/level={k}" for k in levels])

    while True:
        frontier.write.parquet(f"{root}/level={level}")
        frontier = stored(level)
        if frontier.isEmpty():
            delete_on_exit(spark, root)
            return stored(*range(level + 1))
        known = frontier.withColumnRenamed("folder", "parent").join(sizes, "parent")
        reached = join_facts(edges, known, "parent", ["child", "pos"], rows="__n").where(F.col("depth").isNotNull()).select(
            F.col("child").alias("folder"),
            (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array(F.col("pos").cast("bigint"))).alias("path"),
        )
        first = first_wins(reached, "folder", ["depth", "path"])
        frontier = first.join(stored(*range(level + 1)).select("folder"), "folder", "left_anti").select(*schema.names)
        level += 1


def walk_items(folders: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the visited folders; an item listed in several is kept where it is met first.

    ``items``: (folder, item, pos)."""
    met = join_facts(items, folders, "folder", ["item", "pos"]).where(F.col("depth").isNotNull())
    return first_wins(met, "item", ["depth", "path", "pos"])

"""Joins of the serving layer and of run identities.  All are equi-joins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from postmart.functions.scalars import is_blank, nonblank
from postmart.operators.skew import join_facts

# Columns of the newest run shown with a post, and their names there.
LATEST_RUN_COLUMNS = {
    "id": "last_backtest_run_id",
    "status": "last_backtest_status",
    "start_date": "last_backtest_start",
    "end_date": "last_backtest_end",
    "annual_return": "last_backtest_annual_return",
    "sharpe": "last_backtest_sharpe",
}


def join_archives(posts: DataFrame, archives: DataFrame) -> DataFrame:
    """Add ``download_status`` and ``cloned_strategy_id`` of the (at most one) strategy archive."""
    right = archives.select(
        F.col("post_id").alias("id"), F.col("status").alias("download_status"), "cloned_strategy_id"
    )
    return posts.join(right, "id", "left")


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per post: its run with the highest id.  ``max_by`` combines on the map side, so a post
    with very many runs sends one row per task through the shuffle."""
    columns = [c for c in LATEST_RUN_COLUMNS if c in runs.columns]
    newest = F.max_by(F.struct(*columns), F.col("id")).alias("run")
    return runs.groupBy("post_id").agg(newest).select(
        "post_id", *[F.col(f"run.{c}").alias(LATEST_RUN_COLUMNS[c]) for c in columns]
    )


def join_latest_run(posts: DataFrame, runs: DataFrame) -> DataFrame:
    return posts.join(latest_runs(runs).withColumnRenamed("post_id", "id"), "id", "left")


def flag_candidates(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``is_original_candidate`` 0/1.  Distinct ids keep the join 1:0..1; whether the id side is
    broadcast is left to the size-checked planner rule."""
    marked = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct().withColumn("__hit", F.lit(1))
    joined = posts.drop("is_original_candidate").join(marked, "id", "left")
    return joined.withColumn("is_original_candidate", F.coalesce("__hit", F.lit(0))).drop("__hit")


def label_lists(labels: DataFrame) -> DataFrame:
    """Alphabetical label list per post; at most one entry per rule, so the list is small."""
    return labels.groupBy("post_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def attach_labels(posts: DataFrame, labels: DataFrame) -> DataFrame:
    joined = posts.join(label_lists(labels).withColumnRenamed("post_id", "id"), "id", "left")
    return joined.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


class PostDetail(NamedTuple):
    """Posts with their labels and archive nested, and their runs as rows of their own."""

    posts: DataFrame
    runs: DataFrame


def post_detail(posts: DataFrame, labels: DataFrame, archives: DataFrame, runs: DataFrame) -> PostDetail:
    """Everything known about the given posts.

    Labels (at most one per rule) and the archive (at most one) are nested into the post.  Runs are not:
    one post may own any number of them.  They come newest first, linked by ``post_id``."""
    label_rows = labels.groupBy(F.col("post_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("label", "score", "reason"))).alias("labels")
    )
    archive = archives.select(
        F.col("post_id").alias("id"), F.struct(*[c for c in archives.columns if c != "post_id"]).alias("archive")
    )
    shown = posts.join(label_rows, "id", "left").join(archive, "id", "left")
    wanted = posts.select(F.col("id").alias("post_id"), F.lit(True).alias("__wanted"))
    own = join_facts(runs, wanted, "post_id", ["id"]).where("__wanted").drop("__wanted")
    return PostDetail(shown, own.orderBy("post_id", F.desc("id")))


def enrich_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach ``stats`` by backtest id and never drop a post.

    ``stats``: (backtest_id unique, stats, stats_error).  Without a backtest id the statistics stay
    as they were; a failed or absent fetch is recorded in ``stats_error`` and keeps the old ones."""
    found = stats.select(
        "backtest_id", F.col("stats").alias("__stats"), F.col("stats_error").alias("__error"), F.lit(True).alias("__hit")
    )
    asked = ~is_blank("backtest_id")
    # Many posts have no backtest at all, and many may share one; neither may pile up in one task.
    joined = join_facts(posts, found, "backtest_id", ["id"], never=~asked)
    failed = F.coalesce("__error", F.when(F.col("__hit").isNull(), "no stats payload"))
    return joined.select(
        *[F.col(c) for c in posts.columns if c not in ("stats", "stats_error")],
        F.when(asked & failed.isNull(), F.col("__stats")).otherwise(F.col("stats")).alias("stats"),
        F.when(asked, failed).otherwise(F.col("stats_error")).alias("stats_error"),
    )


def resume_anti(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not yet in the output.  Rows with a blank key are never in it; they keep out of each other's
    way by a hash of their other columns."""
    blank, others = is_blank(F.col(key).cast("string")), [c for c in rows.columns if c != key]
    elsewhere = F.struct(F.lit(None).cast(rows.schema[key].dataType).alias("key"), F.xxhash64(*others, F.spark_partition_id()).alias("salt"))
    own = F.struct(F.col(key).alias("key"), F.lit(None).cast("bigint").alias("salt"))
    known = done.where(~is_blank(F.col(key).cast("string"))).select(F.struct(F.col(key).cast(rows.schema[key].dataType).alias("key"), F.lit(None).cast("bigint").alias("salt")).alias("__seen")).distinct()
    placed = rows.withColumn("__own", F.when(blank, elsewhere).otherwise(own))
    return placed.join(known, F.col("__own").eqNullSafe(F.col("__seen")), "left_anti").drop("__own")


def resolve_run(ids: DataFrame, runs: DataFrame, id_columns=("id", "list_id", "source_id"), pos: str = "pos") -> DataFrame:
    """First listing row (in ``pos`` order) that carries the wanted id under any of its identities.

    The three-way OR becomes one equi-join by exploding each row's distinct identities.  An id that is asked
    for very often is split (:func:`join_facts`).  Output: ``wanted`` plus the listing columns, NULL where
    nothing matches."""
    names = [c for c in runs.columns]
    keyed = runs.select(
        F.explode(F.array_distinct(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_columns]))).alias("wanted"),
        F.struct(*names).alias("row"),
    )
    first = keyed.groupBy("wanted").agg(F.min_by("row", F.col(f"row.{pos}")).alias("row"))
    return join_facts(ids, first, "wanted", ids.columns).select(*ids.columns, *[F.col(f"row.{c}").alias(c) for c in names])


def resolve_internal_id(ids: DataFrame, items: DataFrame, pos: str = "pos") -> DataFrame:
    """Internal id of a strategy: by id or internal id, else by the looked-up name, else the id itself.

    ``ids``: (wanted, name), name NULL when the strategy page could not be read."""
    internal = F.coalesce(nonblank(F.col("internal_id").cast("string")), F.col("id").cast("string"))
    by_id = (
        items.select(
            F.explode(F.array_distinct(F.array(
                F.coalesce(F.col("id").cast("string"), F.lit("")),
                F.coalesce(F.col("internal_id").cast("string"), F.lit("")),
            ))).alias("wanted"),
            internal.alias("internal"), F.col(pos).alias("p"),
        )
        .groupBy("wanted").agg(F.min_by("internal", "p").alias("by_id"))
    )
    by_name = (
        items.where(~is_blank("name")).select("name", internal.alias("internal"), F.col(pos).alias("p"))
        .groupBy("name").agg(F.min_by("internal", "p").alias("by_name"))
    )
    known = join_facts(ids, by_id, "wanted", ["wanted"])
    named = join_facts(known, by_name, "name", ["wanted"], never=is_blank("name") | F.col("by_id").isNotNull())
    return named.select("wanted", F.coalesce("by_id", "by_name", "wanted").alias("internal_id"))


def find_new_item(before: DataFrame, after: DataFrame, top: int = 20) -> DataFrame:
    """The most recently updated of the ``top`` newest items that was not there before; when all were,
    the newest item.  Empty ids never count as new."""
    order = [F.coalesce("updated_at", F.lit("")).desc(), F.col("pos").asc()]
    newest = after.orderBy(*order).limit(top)
    known = before.where(~is_blank("id")).select("id", F.lit(True).alias("known")).distinct()
    fresh = newest.join(known, "id", "left").withColumn(
        "is_new", F.col("known").isNull() & ~is_blank("id")
    )
    return fresh.orderBy(F.desc("is_new"), *order).limit(1).select(*after.columns)

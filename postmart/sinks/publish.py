"""Distributed writers.

A published table is a folder ``root`` with immutable version folders and one small pointer file::

    root/versions/<id>/…      part files written by the executors
    root/CURRENT              the id readers follow

A job writes a whole new version and then replaces the pointer with one rename.  A job that dies, or
loses executors for good, leaves the old version published; readers of the old version are not disturbed
because its files stay in place."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postmart.functions.scalars import is_blank
from postmart.operators.joins import resume_anti
from postmart.operators.windows import first_wins

RANKED_COLUMNS = [
    "published_at", "title", "author", "url", "post_id", "backtest_id", "clone_count", "like_count",
    "reply_count", "view_count", "is_best",
]
_POINTER = "CURRENT"


class IncompleteSnapshot(RuntimeError):
    """Raised instead of publishing something partial."""


# ---- files ------------------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _fs(spark, path)
    return fs.exists(hadoop_path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _fs(spark, path)
    fs.delete(hadoop_path, True)


def _point(spark: SparkSession, root: str, versions: list[str]) -> None:
    """Replace the pointer file: written aside, then renamed over the old one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{_POINTER}")
    aside = jvm.org.apache.hadoop.fs.Path(f"{root}/.{_POINTER}-{versions[0]}")
    fs = target.getFileSystem(conf)
    stream = fs.create(aside, True)
    stream.write(bytearray("\n".join(versions).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    context.rename(aside, target, options)


def _pointed(spark: SparkSession, root: str) -> list[str]:
    """The published version, and those before it that are still kept."""
    hadoop_path, fs = _fs(spark, f"{root}/{_POINTER}")
    if not fs.exists(hadoop_path):
        return []
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def published_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the version readers should use, or None when nothing was published yet."""
    versions = _pointed(spark, root)
    return f"{root}/versions/{versions[0]}" if versions else None


def read_published(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame | None:
    path = published_path(spark, root)
    if path is None:
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _publish(spark: SparkSession, root: str, write: Callable[[str], None], keep_previous: int = 1) -> str:
    """Run ``write(folder)``, publish the folder, drop the version that falls behind the ``keep_previous`` last.
    Only versions that were published once are dropped, never what another writer is busy with."""
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    try:
        write(folder)
    except BaseException:
        _delete(spark, folder)
        raise
    old = _pointed(spark, root)
    _point(spark, root, [version, *old[:keep_previous]])
    for behind in old[keep_previous:]:
        _delete(spark, f"{root}/versions/{behind}")
    return folder


def replace_published(df: DataFrame, root: str) -> str:
    """Publish a frame as the new parquet version of ``root``."""
    return _publish(df.sparkSession, root, lambda folder: df.write.parquet(folder))


# ---- sinks ------------------------------------------------------------------------------------

def write_archive_jsonl(df: DataFrame, root: str) -> str:
    """Whole archive as JSON lines, newest first (ties by id), published in one step.

    The order is a range partitioning: part files in name order are the sorted archive."""
    ordered = df.orderBy(F.coalesce("published_at", F.lit("")).desc(), F.asc("id"))
    return _publish(df.sparkSession, root, lambda folder: ordered.write.json(folder))


def read_appended(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame | None:
    """The lines of all batches that ``append_new_jsonl`` has published."""
    versions = _pointed(spark, root)
    if not versions:
        return None
    batches = spark.read.text(f"{root}/versions/{versions[0]}").where("value <> ''").collect()
    paths = [f"{root}/batches/{r[0]}" for r in batches]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def append_new_jsonl(df: DataFrame, root: str, key: str = "id", order: list[str] | None = None, force: bool = False) -> None:
    """Append only rows whose key is not in the output yet, the first row of each key; ``force`` starts the output afresh.

    First along ``order``, or as the frame is read.  Every batch is a folder of its own, and a small published list
    says which of them make up the output.  A job that dies, also one with ``force``, leaves the list as it was."""
    spark = df.sparkSession
    rows = df.withColumn("__at", F.monotonically_increasing_id()) if order is None else df
    fresh = first_wins(rows.where(~is_blank(key)), key, order or ["__at"]).select(*df.columns)
    done = None if force else read_appended(spark, root, T.StructType([T.StructField(key, df.schema[key].dataType)]))
    if done is not None:
        fresh = resume_anti(fresh, done, key)
    batch = uuid.uuid4().hex
    fresh.write.json(f"{root}/batches/{batch}")
    names = [(batch,)]
    if done is not None:
        names += [tuple(r) for r in spark.read.text(published_path(spark, root)).where("value <> ''").collect()]
    _publish(spark, root, lambda folder: spark.createDataFrame(names, "value string").coalesce(1).write.text(folder))


def write_ranked_csv(ranked: DataFrame, root: str, rank: str = "rank") -> str:
    """The 11 report columns with a header, published in one step.  With a ``rank`` column the part files in name
    order are the report in rank order."""
    rows = ranked.orderBy(rank) if rank in ranked.columns else ranked
    report = rows.select(*RANKED_COLUMNS)
    return _publish(ranked.sparkSession, root, lambda folder: report.write.option("header", True).option("escape", '"').csv(folder))


def write_json_document(ranked: DataFrame, root: str, rank: str = "rank") -> str:
    """A ``{"count":N,"items":[…]}`` document whose text is written in parallel.

    The frame carries a 1-based ``rank``.  Every item becomes one line, the head and the tail are lines
    too; the part files concatenated in name order are the document."""
    items = [c for c in ranked.columns if c != rank]
    line = F.concat(F.when(F.col(rank) > 1, F.lit(",")).otherwise(F.lit("")), F.to_json(F.struct(*items), {"ignoreNullFields": "false"}))
    body = ranked.select(F.col(rank).cast("bigint").alias("at"), line.alias("value"))
    count = ranked.agg(F.count(F.lit(1)).alias("n"))
    head = count.select(F.lit(0).cast("bigint").alias("at"), F.format_string('{"count":%d,"items":[', "n").alias("value"))
    tail = count.select((F.col("n") + 1).alias("at"), F.lit("]}").alias("value"))
    document = head.unionByName(body).unionByName(tail).orderBy("at").select("value")
    return _publish(ranked.sparkSession, root, lambda folder: document.write.text(folder))


def publish_snapshot(parts: dict[str, DataFrame], problems: DataFrame, root: str) -> str:
    """Write all parts of a snapshot and publish them together, or raise and leave the old snapshot.

    ``problems`` has one row per reason not to publish; nothing is merged with earlier snapshots.  A refusal
    leaves all reasons as a table in ``root/refused`` and names their number and the first ones."""
    spark = problems.sparkSession
    problems.write.mode("overwrite").parquet(f"{root}/refused")
    reasons = spark.read.schema(problems.schema).parquet(f"{root}/refused")
    if n := reasons.count():
        first = "; ".join(row[0] for row in reasons.orderBy("problem").take(20))
        raise IncompleteSnapshot(f"{n} reasons, all in {root}/refused: {first}")

    def write(folder: str) -> None:
        for name, frame in parts.items():
            out = frame.select(*[
                F.to_json(c).alias(c) if kind == "variant" else F.col(c) for c, kind in frame.dtypes
            ])
            out.write.parquet(f"{folder}/{name}")

    return _publish(spark, root, write)


STATE_SCHEMA = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    T.StructField("updated_at", T.StringType()),
])


def write_run_state(spark: SparkSession, metrics: dict[str, object], section: str, root: str) -> None:
    """Update one section of the run-state table; its other values and other sections stay."""
    text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in metrics.items()}
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    entries = spark.createDataFrame([(section, text, None)], STATE_SCHEMA).withColumn("updated_at", now)
    current = read_published(spark, root, STATE_SCHEMA)
    if current is not None:
        old = current.where(~is_blank("section"))
        both = old.select("section", "metrics", "updated_at", F.lit(0).alias("r")).unionByName(
            entries.withColumn("r", F.lit(1))
        )
        cells = both.select("section", "updated_at", "r", F.explode_outer("metrics").alias("k", "v"))
        last = cells.groupBy("section", "k").agg(F.max_by("v", "r").alias("v"), F.max_by("updated_at", "r").alias("u"))
        entries = last.groupBy("section").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("metrics"),
            F.max("u").alias("updated_at"),
        )
    replace_published(entries.coalesce(1), root)

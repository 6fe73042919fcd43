"""Incremental ingestion of landed feed pages with Structured Streaming.

Micro-batches append normalised versions to a log that is partitioned by batch; compaction folds the log
into the published archive.  Writing a batch replaces its own log partition, so a batch that is replayed
after a failure is written once, and folding the same versions again changes nothing.

Beside the log lie two small tables, partitioned by batch as well: ``_stops``, where readings of a feed have met
their end, and ``_progress``, what every page has brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from postmart.functions.scalars import DEFAULT_POST_URL, is_blank, parse_time
from postmart.operators.filters import mark_feed_stop, parse_until
from postmart.operators.ranking import split_running_sum
from postmart.operators.skew import join_facts
from postmart.operators.windows import first_wins
from postmart.operators.merge import merge_repeated
from postmart.operators.normalize import compact_post, conform, normalize_feed_post
from postmart.schemas import ARCHIVE
from postmart.session import cut_lineage
from postmart.sinks.manifest import BUCKETS, append_rows, read_table
from postmart.sinks.publish import read_published, replace_published
from postmart.sources.files import path_exists
from postmart.sources.payloads import scan_feed_pages
from postmart.streaming.events import observed
from postmart.streaming.ledger import IdLedger

#: A reading is one walk through a feed from its first page on; a later walk has another name.
LANDING_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("reading", T.StringType()),
    T.StructField("page", T.LongType()),
    T.StructField("payload", T.StringType()),
])


def high_watermark(archive: DataFrame, until: str | None = None) -> Column | None:
    """Cut of the next increment: the newest archived time.  It overrides the caller's ``until``, which
    only counts while the archive has no readable time.  One value comes to the driver."""
    newest = archive.agg(F.max(parse_time("published_at")).cast("string")).first()[0]
    return parse_until(until) if newest is None else parse_until(newest[:19])


def late_rows(df: DataFrame, cut: str | Column) -> DataFrame:
    """Rows older than the cut and what becomes of them: pinned ones are ignored, unpinned ones end the
    increment."""
    marked = mark_feed_stop(df, until=cut)
    fate = F.when(F.col("is_top"), "ignored").otherwise("end of increment")
    return marked.where("is_old").drop("is_old", "stop_kind").withColumn("fate", fate)


def normalize_pages(pages: DataFrame, base_url: str = DEFAULT_POST_URL) -> DataFrame:
    """Landed feed pages to archive versions; pages the site rejected are left out."""
    items = scan_feed_pages(pages, on_reject="skip")
    versions = compact_post(normalize_feed_post(items, base_url=base_url), canonical=True)
    return conform(versions).where(~is_blank("id"))


_PLACE = [T.StructField("feed", T.StringType()), T.StructField("reading", T.StringType()), T.StructField("page", T.LongType()), T.StructField("pos", T.LongType())]
_LOG = T.StructType([*ARCHIVE.fields, *_PLACE])
_STOPS = T.StructType([T.StructField("walk", T.StringType()), T.StructField("cut", T.StringType()), T.StructField("page", T.LongType()), T.StructField("pos", T.LongType())])
_PROGRESS = T.StructType([
    *_PLACE[:3], *[T.StructField(n, T.LongType()) for n in ("page_items", "late", "behind")], T.StructField("stopped", T.BooleanType()),
])


def _by_batch(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(path)


def place_items(pages: DataFrame, cut: Column | None, base_url: str = DEFAULT_POST_URL) -> DataFrame:
    """Landed pages to archive versions with their place and whether they are older than ``cut``.  A page without
    entries leaves one row without an id, so that it shows up in the progress."""
    items = scan_feed_pages(pages, on_reject="skip", keep_empty=True)
    place = ("feed", "reading", "page", "pos")
    items = items.withColumn("reading", F.coalesce("reading", F.lit(""))).withColumn("pos", F.col("pos").cast("bigint"))
    whole = conform(compact_post(normalize_feed_post(items, base_url=base_url), canonical=True, keep=place), keep=place)
    no_stop = {"is_old": F.lit(False), "stop_kind": F.lit(None).cast("string")}
    marked = whole.withColumns(no_stop) if cut is None else mark_feed_stop(whole, until=cut)
    there = ~is_blank("id")
    return marked.withColumn("is_item", there).withColumn("is_old", F.col("is_old") & there)


def _stops_so_far(spark: SparkSession, log: str, cut: str, batch: int) -> DataFrame | None:
    """Where walks have ended in earlier batches: (walk, page, pos)."""
    before = _by_batch(spark, f"{log}/_stops", _STOPS)
    return None if before is None else before.where((F.col("batch") < batch) & (F.col("cut") == cut)).select("walk", "page", "pos")


def stream_ingest(
    spark: SparkSession, landing: str, log: str, checkpoint: str, cut: Column | str | None = None,
    base_url: str = DEFAULT_POST_URL,
) -> StreamingQuery:
    """Ingest everything that has landed since the last run, then stop.

    ``landing`` holds JSON lines (feed, reading, page, payload).  A walk through a feed ends at the first unpinned row
    older than ``cut``, in the order of page and position: rows behind it are not taken, whichever batch brings
    them, and older pinned rows are left out without ending it.  Where a walk has ended is kept with the log and
    belongs to this ``cut`` and reading.  ``items``, ``late`` (rows older than the cut) and the last ``page`` of each
    batch are observed as ``feed`` in the query progress; ``feed_events`` has them page by page."""
    limit = parse_until(cut) if isinstance(cut, str) else cut
    cut_text = "" if limit is None else str(spark.range(1).select(limit.cast("string")).first()[0])
    rows = observed(place_items(spark.readStream.schema(LANDING_SCHEMA).json(landing), limit, base_url))
    walk = F.concat_ws("\x00", F.coalesce("feed", F.lit("")), "reading")

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = cut_lineage(batch.withColumn("walk", walk))  # parsed once
        place = F.struct("page", "pos")
        found = placed.where(F.col("stop_kind").isNotNull()).groupBy("walk").agg(F.min(place).alias("stop"))
        found = found.select("walk", "stop.page", "stop.pos")
        found.withColumn("cut", F.lit(cut_text)).select(*_STOPS.names).coalesce(1).write.mode("overwrite").parquet(f"{log}/_stops/batch={batch_id}")
        before = _stops_so_far(spark, log, cut_text, batch_id)
        stops = (found if before is None else found.unionByName(before)).groupBy("walk").agg(F.min(place).alias("stop"))
        sizes = placed.groupBy("walk").agg(F.count(F.lit(1)).alias("n"))
        judged = join_facts(placed, sizes.join(stops, "walk", "left"), "walk", ["page", "pos"], rows="n")
        behind = F.coalesce(place >= F.col("stop"), F.lit(False))
        taken = F.col("is_item") & ~F.col("is_old") & ~behind
        judged.where(taken).select(*_LOG.names).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        progress = judged.groupBy("feed", "reading", "page").agg(
            F.count_if(taken).alias("page_items"), F.count_if("is_old").alias("late"),
            F.count_if(F.col("is_item") & behind & ~F.col("is_old")).alias("behind"),
            F.coalesce(F.max(F.col("stop.page") <= F.col("page")), F.lit(False)).alias("stopped"))
        progress.coalesce(1).write.mode("overwrite").parquet(f"{log}/_progress/batch={batch_id}")

    return (
        rows.writeStream.queryName("feed_ingest").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def feed_events(spark: SparkSession, log: str) -> DataFrame | None:
    """The events of all readings as rows keyed by (feed, reading, page): ``progress`` for each page, with the items it
    brought and those so far, and one ``done`` for each reading, with page NULL.

    A page that was delivered again counts as it came last.  Pages behind the end of a reading brought nothing and
    count as not read."""
    rows = _by_batch(spark, f"{log}/_progress", _PROGRESS)
    if rows is None:
        return None
    last = rows.groupBy("feed", "reading", "page").agg(*[F.max_by(c, "batch").alias(c) for c in ("page_items", "late", "behind", "stopped")])
    # The page that holds the end was read; those after it were not.
    ends = last.where("stopped").groupBy("feed", "reading").agg(F.min("page").alias("last_page"))
    read = last.join(ends, ["feed", "reading"], "left").where(F.col("last_page").isNull() | (F.col("page") <= F.col("last_page")))
    pages = split_running_sum(read.select("feed", "reading", "page", "page_items", "late", "stopped"), ["feed", "reading"], "page", "page_items", "items_seen")
    done = read.groupBy("feed", "reading").agg(F.sum("page_items").alias("items_seen"), F.count(F.lit(1)).alias("pages_read"), F.sum("late").alias("late"), F.max("stopped").alias("stopped"))
    return pages.withColumn("type", F.lit("progress")).unionByName(done.withColumn("type", F.lit("done")), allowMissingColumns=True)


def read_log(spark: SparkSession, log: str) -> DataFrame | None:
    """All versions of all batches, with their place in the feed."""
    return _by_batch(spark, log, _LOG)


_FOLDED = T.StructType([T.StructField("batch", T.LongType())])


def compact_archive(spark: SparkSession, root: str, log: str, base_url: str = DEFAULT_POST_URL) -> DataFrame:
    """Fold the batches that are not folded yet over the published archive, publish the result and return it.

    Which batch was folded last is published beside the archive, right after it, so that an old batch never
    overwrites what was merged into the archive since.  A crash between the two folds the same batches once
    more.  Archive rows come first, then batches in order, and within a batch pages and positions: a post may
    show up twice, because it moved to another page while the feed was read, and counts as it was read last."""
    archive = read_published(spark, root, ARCHIVE)
    ledger = f"{root}/folded"
    folded = read_published(spark, ledger, _FOLDED)
    done = -1 if folded is None or archive is None else folded.first()[0]
    fresh = read_log(spark, log)
    if fresh is not None:
        fresh = fresh.where(F.col("batch") > done)
        last = fresh.agg(F.max("batch")).first()[0]
        if last is None and archive is not None:
            return archive
    parts = []
    if archive is not None:
        parts.append(archive.withColumn("__source", F.lit(-1).cast("bigint")))
    if fresh is not None:
        parts.append(fresh.drop("feed", "reading").withColumnRenamed("batch", "__source"))
    if not parts:
        raise ValueError("nothing to compact")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    for c in ("page", "pos"):
        rows = rows.withColumn(f"__{c}", F.coalesce(c, F.lit(-1)) if c in rows.columns else F.lit(-1).cast("bigint")).drop(c)
    tie = F.xxhash64(F.to_json(F.struct(*[f.name for f in ARCHIVE.fields])))
    merged = merge_repeated(rows, "id", ["__source", "__page", "__pos"], base_url, tie)
    replace_published(conform(merged), root)
    if fresh is not None and last is not None:
        replace_published(spark.range(1).select(F.lit(last).cast("bigint").alias("batch")), ledger)
    return read_published(spark, root, ARCHIVE)


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key, as the frame is read; blank keys are no rows."""
    return first_wins(rows.where(~is_blank(key)).withColumn("__at", F.monotonically_increasing_id()), key, ["__at"]).select(*rows.columns)


def write_new_rows(batch: DataFrame, batch_id: int, ledger: IdLedger, target: str) -> None:
    """Write the rows of a batch whose id is new, then record their ids.

    A replay rewrites the same folder: ids that the first attempt recorded do not count as known.  A crash
    between the two leaves the ids unrecorded and the batch uncommitted, so that it is replayed."""
    fresh = ledger.unknown(first_rows(batch, ledger.key), batch_id)
    fresh.write.mode("overwrite").json(f"{target}/batch={batch_id}")
    spark, kind = batch.sparkSession, T.StructType([batch.schema[ledger.key]])
    ledger.record(spark.read.schema(kind).json(f"{target}/batch={batch_id}"), batch_id)


def stream_dedupe(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str = "id", buckets: int = BUCKETS
) -> StreamingQuery:
    """Append rows whose key is not in the target yet, each key once, also across batches of this run.

    Written keys are remembered in an ``IdLedger`` below ``target/_ids``: state does not grow with the stream, and a
    batch reads the buckets of its own keys instead of the target.  A target without a ledger gets one first."""
    rows = spark.readStream.schema(schema).json(source)
    ledger = IdLedger(spark, f"{target}/_ids", key, buckets)
    if path_exists(spark, target) and not ledger.exists():
        done = T.StructType([schema[key], T.StructField("batch", T.LongType())])
        old = spark.read.schema(done).option("basePath", target).json(target)
        append_rows(old.where(~is_blank(key)), ledger.root, key, buckets, {"batch": str(old.agg(F.max("batch")).first()[0])})

    def write(batch: DataFrame, batch_id: int) -> None:
        write_new_rows(batch, batch_id, ledger, target)

    return (
        rows.writeStream.queryName("dedupe").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_ndjson_stream(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str
) -> StreamingQuery:
    """Copy a stream to compact JSON lines.  The file sink's commit log makes output exactly-once, and the
    checkpoint is the resume point."""
    rows = spark.readStream.schema(schema).json(source)
    return (
        rows.writeStream.queryName("ndjson").format("json").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )

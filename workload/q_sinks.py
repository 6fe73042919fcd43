"""Sinks and file sources: derive files from the driver tables, read them back, compare the rows.

Files go below the shared folder of the session (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F, types as T

from postmart import sinks as K
from postmart.functions.scalars import DEFAULT_POST_URL
from postmart.operators import filters, windows as W
from postmart.operators.aggregates import day_summary, page_integrity
from postmart.session import checkpoint_dir, cut_lineage
from postmart.sinks.publish import STATE_SCHEMA, published_path, read_published
from postmart.sources.files import scan_id_csv, scan_json_document, scan_jsonl_strict
from postmart.sources import payloads as S
from workload.q_archive import _SQL_UPSERT, upsert_sides
from workload.registry import query
from workload.views import TERMS  # noqa: F401


def scratch(v) -> str:
    return f"{checkpoint_dir(v.spark)}/{uuid.uuid4().hex}"


_DOC = T.StructType([T.StructField("id", T.StringType()), T.StructField("published_at", T.StringType()), T.StructField("content", T.StringType())])
_DIGEST = "SELECT id, published_at, md5(content) AS content FROM posts_v"


def _digest(df):
    return df.select("id", "published_at", F.md5(F.col("content").cast("binary")).alias("content"))


@query("write_archive_jsonl", "SELECT id, published_at, md5(content) AS content, row_number() OVER (ORDER BY published_at DESC, id) AS line FROM posts_v")
def _(v):
    """The written lines in file order, numbered."""
    root = scratch(v)
    path = K.write_archive_jsonl(v.posts().select("id", "published_at", "content"), root)
    return _digest_line(_numbered(v.spark.read.schema(_DOC).json(path)))


def _numbered(rows):
    """Rows with the number of their ``line`` in the part files, taken in name order."""
    from postmart.operators.ranking import global_rank

    placed = rows.select("*", F.element_at(F.split(F.col("_metadata.file_name"), "-"), 2).cast("int").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # The order inside a file is the order of the partition that reads it.
    numbered = placed.withColumn("key", F.monotonically_increasing_id())
    return global_rank(numbered, [("file", False), ("at", False), ("key", False)], "line").select(*rows.columns, "line")


def _digest_line(df):
    return df.select("id", "published_at", F.md5(F.col("content").cast("binary")).alias("content"), "line")


@query("scan_jsonl_strict", _DIGEST)
def _(v):
    """Archive lines mixed with blank lines and lines that are not objects."""
    root = scratch(v)
    line = F.to_json(F.struct("id", "published_at", "content"))
    noise = F.array(line, F.lit("   "), F.lit("[1,2]"), F.lit("17"))
    v.posts().select(F.explode(noise).alias("value")).write.text(root)
    return _digest(scan_jsonl_strict(v.spark, root, _DOC))


@query("append_new_jsonl", _DIGEST)
def _(v):
    """Two overlapping batches, the first one twice; every id is written once."""
    root, rows = scratch(v), v.posts().select("id", "published_at", "content")
    even = rows.where(F.col("id").cast("bigint") % 2 == 0)
    for batch in (even, even, rows):
        K.append_new_jsonl(batch, root)
    return _digest(K.read_appended(v.spark, root, _DOC))


def _popular(v):
    rows = filters.filter_popular(v.posts()).select(
        "published_at", "title", F.col("author_name").alias("author"), "url", F.col("id").alias("post_id"), "id", "backtest_id",
        "clone_count", "like_count", "reply_count", "view_count", F.lit(False).alias("is_best"))
    return W.rank_output(rows).drop("id")


_SQL_POPULAR = """
SELECT published_at, title, author_name AS author, url, id AS post_id, backtest_id, clone_count, like_count, reply_count, view_count, false AS is_best
FROM posts_v WHERE clone_count > 100 AND like_count > 50"""


_SQL_RANKED = _SQL_POPULAR.replace("backtest_id,", "nullif(backtest_id, '') AS backtest_id,").replace(
    "SELECT published_at", "SELECT row_number() OVER (ORDER BY clone_count DESC, like_count DESC, published_at, id) AS line, published_at")


@query("write_ranked_csv", _SQL_RANKED)
def _(v):
    """The report read back in file order: lines are numbered by where they stand."""
    root = scratch(v)
    path = K.write_ranked_csv(_popular(v), root)
    schema = ", ".join(
        f"{c} " + ("bigint" if c.endswith("count") else "boolean" if c == "is_best" else "string") for c in K.publish.RANKED_COLUMNS)
    return _numbered(v.spark.read.schema(schema).csv(path, header=True, escape='"'))


@query("write_json_document", f"SELECT *, (SELECT count(*) FROM ({_SQL_POPULAR}) c) AS stated FROM ({_SQL_POPULAR}) p")
def _(v):
    """The document is read back by its own reader, whatever number of part files it has."""
    root = scratch(v)
    path = K.write_json_document(_popular(v), root)
    lines = v.spark.read.text(path)
    stated = lines.where(F.col("value").startswith('{"count"')).select(F.regexp_extract("value", r"(\d+)", 1).cast("bigint").alias("stated"))
    schema = ", ".join(
        f"{c} " + ("bigint" if c.endswith("count") else "boolean" if c == "is_best" else "string") for c in K.publish.RANKED_COLUMNS)
    items = scan_json_document(v.spark, path, T.StructType.fromDDL(schema), lines=True)
    return items.withColumn("stated", stated.scalar())


@query("scan_json_document", "SELECT c_custkey, c_name FROM customer")
def _(v):
    """Documents of at most 10,000 items, one file each."""
    root = scratch(v)
    c = v.table("customer")
    c.select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 10000).alias("part")).groupBy("part").agg(
        F.collect_list(F.struct("c_custkey", "c_name")).alias("items")).select("items").write.json(root)
    item = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    docs = v.spark.read.text(root)
    docs.write.option("maxRecordsPerFile", 1).text(root + "/one")
    return scan_json_document(v.spark, root + "/one", item)


@query("scan_id_csv", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE user_id % 3 <> 0")
def _(v):
    root = scratch(v)
    ids = v.table("events").select(
        "event_type", F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).otherwise("").alias("id"))
    ids.write.option("header", True).csv(root)
    return scan_id_csv(v.spark, root)


@query("write_upsert", _SQL_UPSERT)
def _(v):
    """Upsert through a published table: first the target, then the batch."""
    root = scratch(v)
    target, incoming = upsert_sides(v)
    K.upsert_table(target, root, "id")
    K.upsert_table(incoming, root, "id")
    return K.read_table(v.spark, root)


@query("upsert_partitions", _SQL_UPSERT.replace("SELECT c_custkey AS id", "SELECT c_custkey % 8 AS part, c_custkey AS id").replace("SELECT -1 - s_suppkey", "SELECT s_suppkey % 4, -1 - s_suppkey"))
def _(v):
    """Upsert into a table whose buckets are partitioned further; rows that move change folders within a bucket."""
    root = scratch(v)
    target, incoming = upsert_sides(v)
    part = F.when(F.col("id") >= 0, F.col("id") % 8).otherwise((-1 - F.col("id")) % 4).alias("part")
    for rows in (target, incoming):
        K.upsert_table(rows.select("*", part), root, "id", buckets=16, partition=("part",))
    return K.read_table(v.spark, root)


@query("publish_snapshot", "SELECT 'records' AS part, count(*) AS n FROM days_v WHERE NOT is_limit UNION ALL SELECT 'days', count(*) FROM (SELECT DISTINCT sim_id, requested_date FROM days_v WHERE NOT is_limit) d")
def _(v):
    """A complete snapshot is published; a truncated one afterwards is refused and changes nothing."""
    root = scratch(v)
    records = v.days().withColumn("kind", F.lit("orders"))

    def parts_of(rows):
        days = day_summary(rows)
        truncated = days.where(~F.col("complete")).select(F.concat(F.lit("truncated "), "requested_date").alias("problem"))
        return {"records": rows, "days": days.withColumn("record_dates", F.array_join("record_dates", ","))}, truncated

    K.publish_snapshot(*parts_of(records.where(~F.col("is_limit"))), root)
    try:
        K.publish_snapshot(*parts_of(records), root)
    except K.publish.IncompleteSnapshot:
        pass
    path = published_path(v.spark, root)
    counts = [v.spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("records", "days")]
    return counts[0].unionByName(counts[1])


@query("write_run_state", """
SELECT 'sync' AS section, 'items_total' AS k, CAST(count(*) AS VARCHAR) AS v FROM documents UNION ALL SELECT 'sync', 'fetched', '7' UNION ALL SELECT 'list', 'done', 'true'""")
def _(v):
    root = scratch(v)
    K.write_run_state(v.spark, {"items_total": 1, "fetched": 7}, "sync", root)
    K.write_run_state(v.spark, {"done": True}, "list", root)
    K.write_run_state(v.spark, {"items_total": v.table("documents").count()}, "sync", root)
    state = read_published(v.spark, root, STATE_SCHEMA)
    return state.select("section", F.explode("metrics").alias("k", "v"))


def _landed(v, root: str):
    """Feed pages as landed files: odd pages first, then even pages, page 1 again."""
    from workload.q_feed import feed_payloads

    pages = cut_lineage(feed_payloads(v))
    pages.where(F.col("page") % 2 == 1).write.json(f"{root}/landing")
    return pages


@query("stream_ingest", f"""
SELECT id, 't ' || id AS title, '{DEFAULT_POST_URL}' || id AS url, published_at, is_top FROM feed_v WHERE page % 10 <> 7""")
def _(v):
    """Two runs of the same stream with re-delivered pages, each followed by a compaction."""
    from postmart.streaming.ingest import compact_archive, stream_ingest

    root = scratch(v)
    pages = _landed(v, root)
    run = lambda: stream_ingest(v.spark, f"{root}/landing", f"{root}/log", f"{root}/checkpoint").awaitTermination()
    run()
    compact_archive(v.spark, f"{root}/archive", f"{root}/log")
    pages.where((F.col("page") % 2 == 0) | (F.col("page") == 1)).write.mode("append").json(f"{root}/landing")
    run()
    archive = compact_archive(v.spark, f"{root}/archive", f"{root}/log")
    return archive.select("id", "title", "url", "published_at", "is_top")


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events")
def _(v):
    """Two runs over halves of the events; ids of the first run are known from the ledger."""
    from postmart.streaming.ingest import stream_dedupe

    root = scratch(v)
    ids = v.table("events").select(F.col("user_id").cast("string").alias("id"), "event_id")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("event_id", T.LongType())])
    for half in (0, 1):
        ids.where(F.col("event_id") % 2 == half).write.mode("append").json(f"{root}/in")
        stream_dedupe(v.spark, f"{root}/in", schema, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return v.spark.read.schema(schema).json(f"{root}/out").select("id")


@query("write_ndjson_stream", "SELECT event_id, event_type, value FROM events")
def _(v):
    from postmart.streaming.ingest import write_ndjson_stream

    root = scratch(v)
    rows = v.table("events").select("event_id", "event_type", "value")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").json(f"{root}/in")
        write_ndjson_stream(v.spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return v.spark.read.schema(rows.schema).json(f"{root}/out")


_CUT = "2024-01-20"
_SQL_WALK = f"""
marked_feed AS (SELECT *, published_at < '{_CUT} 00:00:00' AS is_old FROM feed_v WHERE page % 10 <> 7),
stops AS (SELECT feed, min(pos) AS stop FROM marked_feed WHERE is_old AND NOT is_top GROUP BY feed),
walk AS (SELECT m.*, stop, NOT is_old AND (stop IS NULL OR pos < stop) AS taken, (stop - 1) // 50 + 1 AS last_page FROM marked_feed m LEFT JOIN stops USING (feed))"""


def _walked(v) -> str:
    """Every feed read in three runs, in the order of its pages, up to the cut; the second run brings some pages of the
    first one once more."""
    from postmart.streaming.ingest import stream_ingest
    from workload.q_feed import feed_payloads

    root = scratch(v)
    pages = cut_lineage(feed_payloads(v).withColumn("reading", F.lit("r1")))
    for part in (F.col("page") <= 6, F.col("page").between(5, 12), F.col("page") > 12):
        pages.where(part).write.mode("append").json(f"{root}/landing")
        stream_ingest(v.spark, f"{root}/landing", f"{root}/log", f"{root}/checkpoint", cut=_CUT).awaitTermination()
    return f"{root}/log"


@query("stream_ingest_stops", f"WITH {_SQL_WALK.strip()} SELECT feed, page, (pos - 1) % 50 AS pos, id, is_top FROM walk WHERE taken")
def _(v):
    """What a reading takes when its end is found in one batch and later batches bring pages behind it."""
    from postmart.streaming.ingest import read_log

    rows = read_log(v.spark, _walked(v))
    return rows.select("feed", "page", "pos", "id", "is_top").distinct()


@query("progress_events", f"""
WITH {_SQL_WALK.strip()},
pages AS (SELECT feed, page, count(*) FILTER (taken) AS page_items, count(*) FILTER (is_old) AS late, coalesce(min(last_page) <= page, false) AS stopped
  FROM walk WHERE last_page IS NULL OR page <= last_page GROUP BY feed, page)
SELECT 'progress' AS type, feed, page, page_items, CAST(sum(page_items) OVER (PARTITION BY feed ORDER BY page) AS BIGINT) AS items_seen, late, stopped, NULL AS pages_read FROM pages
UNION ALL SELECT 'done', feed, NULL, NULL, CAST(sum(page_items) AS BIGINT), CAST(sum(late) AS BIGINT), bool_or(stopped), count(*) FROM pages GROUP BY feed""")
def _(v):
    """The events of every page and reading, from the table that the ingestion keeps."""
    from postmart.streaming.ingest import feed_events

    return feed_events(v.spark, _walked(v)).select("type", "feed", "page", "page_items", "items_seen", "late", "stopped", "pages_read")


@query("track_run_status", """
WITH polls AS (SELECT user_id, epoch_us(ts) * 1000 + event_id % 1000 AS moment,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'refund' THEN 'cancelled' ELSE 'running' END AS status,
  event_id % 2 AS half FROM events),
ends AS (SELECT user_id, half, min(struct_pack(moment := moment, status := status)) AS ending FROM polls WHERE status <> 'running' GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS run_id, arg_min(ending.status, half) AS status,
  CASE WHEN arg_min(ending.status, half) = 'done' THEN 'listing stats' ELSE 'listing' END AS decided_by FROM ends GROUP BY user_id""")
def _(v):
    """Polls that land in two halves, late ones among them: a run ends by the earliest end of the first half that has one."""
    from postmart.streaming.status import track_run_status

    root, key = scratch(v), "spark.sql.streaming.stateStore.providerClass"
    e, kind = v.table("events"), F.col("event_type")
    listed = F.when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "refund", "cancelled").otherwise("running")
    polls = e.select(
        F.col("user_id").cast("string").alias("run_id"), F.lit(False).alias("core"), listed.alias("listed"), (kind == "purchase").alias("listed_core"),
        F.lit(None).cast("string").alias("state"), F.lit(False).alias("has_errors"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("at"), "event_id")
    before = v.spark.conf.get(key)
    v.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for half in (0, 1):
            polls.where(F.col("event_id") % 2 == half).drop("event_id").write.mode("append").json(f"{root}/polls")
            landed = v.spark.readStream.schema(polls.drop("event_id").schema).json(f"{root}/polls")
            ended = track_run_status(landed, 86_400_000).writeStream.format("json").option("path", f"{root}/ended")
            # One batch for each half: with timers pending a query has always something to do.
            ended.option("checkpointLocation", f"{root}/checkpoint").trigger(once=True).start().awaitTermination()
    finally:
        v.spark.conf.set(key, before)
    return v.spark.read.schema("run_id string, status string, decided_by string").json(f"{root}/ended")


@query("simulation_snapshot", """
WITH users AS (SELECT DISTINCT user_id FROM events),
early AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-06')
SELECT 'listing' AS part, count(*) AS n FROM users UNION ALL SELECT 'days', count(*) * 10 FROM users UNION ALL SELECT 'points', count(*) FROM events
UNION ALL SELECT 'records', CAST(sum(CASE WHEN n = 0 THEN 1 ELSE n END) AS BIGINT) FROM (
  SELECT count(e.user_id) AS n FROM users u CROSS JOIN range(1, 6) d(day) CROSS JOIN (VALUES ('positions'), ('orders')) k(kind)
  LEFT JOIN early e ON e.user_id = u.user_id AND day(e.ts) = d.day AND (kind = 'positions' OR event_type = 'purchase') GROUP BY u.user_id, d.day, kind) x
UNION ALL SELECT 'refused', 3""")
def _(v):
    """Every user is a simulation with five days of records and a curve that ends with an empty page of any offset.  The whole
    is published; without one day, one curve or one end page it is refused, and what was published stays."""
    from postmart.operators.ranking import global_rank
    from postmart.plans.snapshot import sync_snapshot
    from workload.q_curves import curve_payloads

    e, root = v.table("events"), scratch(v)
    users = cut_lineage(global_rank(e.select("user_id").distinct(), [("user_id", False)], "rank"))
    answer = lambda data: F.to_json(F.struct(F.lit("00000").alias("code"), data.alias("data")))
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col("user_id").cast("string").alias("backtestId"))))
    pages = users.groupBy((F.floor((F.col("rank") - 1) / 50) + 1).alias("page")).agg(rows.alias("liveArr"))
    data = F.struct(F.lit(users.count()).alias("totalCount"), "liveArr")
    listing = S.scan_simulation_pages(cut_lineage(pages.select(F.lit("all").alias("listing"), "page", answer(data).alias("payload"))))

    days = users.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("day"))
    day = F.format_string("2024-01-%02d", F.col("day"))

    def records(kind, chosen):
        items = e.where(chosen).where(F.col("ts") < "2024-01-06").groupBy("user_id", F.day("ts").alias("day")).agg(
            F.collect_list(F.struct(F.substring(F.col("ts").cast("string"), 1, 10).alias("date"))).alias("list"))
        empty = F.from_json(F.lit("[]"), "array<struct<date:string>>")
        whole = days.join(items, ["user_id", "day"], "left").withColumn("list", F.coalesce("list", empty))
        data = F.struct(F.lit(False).alias("isLimit"), F.col("list").alias(S.DAY_RECORD_KEYS[kind]))
        return S.scan_day_records(whole.select(F.col("user_id").alias("sim_id"), day.alias("requested_date"), answer(data).alias("payload")), kind)

    both = cut_lineage(records("positions", F.lit(True)).unionByName(records("orders", F.col("event_type") == "purchase")))
    curves = cut_lineage(curve_payloads(v))
    last = curves.groupBy("series_id").agg((F.max("page") + 1).alias("page"))
    line = F.from_json(F.lit('{"time":[],"value":[]}'), "struct<time:array<bigint>,value:array<double>>")
    end = F.struct(F.lit("2").alias("state"), F.struct(F.lit(0).alias("count"), F.lit(77).alias("offset"), line.alias("overallReturn"), line.alias("benchmark")).alias("result"))
    series = cut_lineage(S.scan_series_pages(curves.unionByName(last.select("series_id", "page", answer(end).alias("payload")))))
    spans = users.select(F.col("user_id").alias("sim_id"), F.lit("2024-01-01").alias("start"), F.lit("2024-01-05").alias("end"))

    one = users.agg(F.min("user_id")).first()[0]
    sync_snapshot(listing, both, series, spans, root)
    path, refused = published_path(v.spark, root), 0
    for r, c in (
        (both.where(~((F.col("sim_id") == one) & (F.col("requested_date") == "2024-01-03"))), series),
        (both, series.where(F.col("series_id") != one)),
        (both, series.where(~((F.col("series_id") == one) & (F.col("count") == 0)))),
    ):
        try:
            sync_snapshot(listing, r, c, spans, root)
        except K.publish.IncompleteSnapshot:
            refused += published_path(v.spark, root) == path
    counts = [v.spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("listing", "records", "days", "points")]
    counts.append(v.spark.range(1).select(F.lit("refused").alias("part"), F.lit(refused).cast("bigint").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("read_seeds", """
SELECT id, source_rank, published_at FROM (SELECT id, published_at, 0 AS source_rank FROM posts_v WHERE CAST(id AS BIGINT) % 2 = 0
UNION ALL SELECT id, published_at, 1 FROM posts_v WHERE CAST(id AS BIGINT) % 3 = 0) s""")
def _(v):
    """Two seed archives in files; one is named again by another spelling of its path, one is missing."""
    from postmart.operators.sets import read_seeds

    root, rows = scratch(v), v.posts().select("id", "published_at", "content")
    for name, n in (("a", 2), ("b", 3)):
        rows.where(F.col("id").cast("bigint") % n == 0).write.json(f"{root}/{name}")
    seeds = read_seeds(v.spark, [f"{root}/a", f"{root}/none", f"{root}/b", f"{root}/b/../a"], _DOC)
    return seeds.select("id", F.col("source_rank").cast("int").alias("source_rank"), "published_at")

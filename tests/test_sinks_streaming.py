import json
import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F, types as T

from postmart import sinks as K
from postmart.plans.snapshot import simulation_snapshot
from postmart.session import checkpoint_dir, cut_lineage
from postmart.sinks import manifest as M
from postmart.sinks.publish import IncompleteSnapshot, published_path, read_published
from postmart.sources import payloads as S
from postmart.streaming import ingest as I
from postmart.streaming.events import observed, progress_events
from postmart.streaming.status import track_run_status
from tests.conftest import values


def lines(spark, path):
    """All lines of the part files in name order."""
    local = path.replace("file:", "")
    out = []
    for name in sorted(n for n in os.listdir(local) if n.startswith("part-")):
        with open(os.path.join(local, name), encoding="utf-8") as part:
            out += part.read().splitlines()
    return out


def test_archive_is_newest_first_with_stable_ties(spark, folder):
    rows = [(str(i), f"2024-01-{1 + i % 3:02d}") for i in range(30)] + [("x", None)]
    path = K.write_archive_jsonl(spark.createDataFrame(rows, "id string, published_at string").repartition(5), folder + "/a")
    got = [(json.loads(t).get("published_at", ""), json.loads(t)["id"]) for t in lines(spark, path)]
    assert got == sorted(got, key=lambda r: ([-ord(c) for c in r[0]] or [0], r[1])) and len(got) == 31 and got[-1][1] == "x"


def test_resume_and_force(spark, folder):
    df = lambda *ids: spark.createDataFrame([(i, "v") for i in ids], "id string, v string")
    path, schema = folder + "/out", T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    K.append_new_jsonl(df("1", "2", "", None), path)
    K.append_new_jsonl(df("2", "3"), path)
    read = lambda: sorted(values(K.read_appended(spark, path, schema), "id", "v"))
    assert read() == [("1", "v"), ("2", "v"), ("3", "v")]
    K.append_new_jsonl(df("9"), path, force=True)
    assert read() == [("9", "v")]
    # The first row of a key stays: by an order, or as the frame is read.
    rows = spark.createDataFrame([("a", "z", 2), ("a", "y", 1), ("9", "no", 0)], "id string, v string, n int")
    K.append_new_jsonl(rows, path, order=["n"])
    K.append_new_jsonl(spark.createDataFrame([("b", "first"), ("b", "later")], "id string, v string").coalesce(1), path)
    assert read() == [("9", "v"), ("a", "y"), ("b", "first")]
    bad = df("x").select("id", F.raise_error(F.lit("boom")).cast("string").alias("v"))
    with pytest.raises(Exception, match="boom"):
        K.append_new_jsonl(bad, path, force=True)
    assert read() == [("9", "v"), ("a", "y"), ("b", "first")]


def ranked(spark, n):
    row = lambda i: ("2024", f't "{i}", x', "a", "u", str(i), "", n - i, 1, 0, 0, None, i + 1)
    return spark.createDataFrame([row(i) for i in range(n)], (
        "published_at string, title string, author string, url string, post_id string, backtest_id string, clone_count bigint, "
        "like_count bigint, reply_count bigint, view_count bigint, is_best boolean, rank bigint")).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 12])
def test_json_document_parses(spark, folder, n):
    path = K.write_json_document(ranked(spark, n), folder + "/doc")
    document = json.loads("\n".join(lines(spark, path)))
    assert document["count"] == n and [r["post_id"] for r in document["items"]] == [str(i) for i in range(n)]
    assert all(r["is_best"] is None for r in document["items"])


def test_ranked_csv(spark, folder):
    path = K.write_ranked_csv(ranked(spark, 3), folder + "/csv")
    got = spark.read.csv(path, header=True, escape='"')
    assert [t.split(",")[4 if '"' not in t else -7] for t in lines(spark, path) if t.startswith("2024")] == ["0", "1", "2"]
    assert got.columns == K.publish.RANKED_COLUMNS and got.where("post_id = '2'").first()["title"] == 't "2", x'


def test_failed_write_keeps_the_published_version(spark, folder):
    good = spark.createDataFrame([(1,), (2,)], "x int")
    K.replace_published(good, folder + "/t")
    bad = good.select(F.when(F.col("x") == 2, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("x")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        K.replace_published(bad, folder + "/t")
    assert read_published(spark, folder + "/t").count() == 2
    assert len(os.listdir(folder + "/t/versions")) == 1
    for _ in range(3):
        K.replace_published(good.limit(1), folder + "/t")
    assert read_published(spark, folder + "/t").count() == 1 and len(os.listdir(folder + "/t/versions")) == 2
    assert read_published(spark, folder + "/nothing") is None


def data_files(root):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root + "/data") for n in names if n.startswith("part-"))


@pytest.mark.parametrize("partition", [(), ("part",)])
def test_upsert_touches_only_its_buckets(spark, folder, partition):
    root, schema = folder + "/p", "id int, v string, created_at string, part int"
    first = K.upsert_table(spark.createDataFrame([(i, "a", "t0", i % 3) for i in range(40)], schema), root, "id", buckets=8, partition=partition)
    before = data_files(root)
    batch = spark.createDataFrame([(1, "B", "t1", 2), (100, "n", "t1", 0)], schema)
    second = K.upsert_table(batch, root, "id", partition=partition)
    touched = {str(r[0]) for r in batch.select(M.bucket_of("id", 8)).collect()}
    assert {k for k in second.folders if second.folders[k] != first.folders.get(k)} == touched and len(touched) < 8
    assert set(before) <= set(data_files(root))  # readers of the version before are not disturbed
    plan = K.read_table(spark, root, [int(k) for k in touched]).inputFiles()
    assert plan and {f.split("bucket=")[1].split("/")[0] for f in plan} == touched
    want = {i: ("a", "t0", i % 3) for i in range(40)} | {1: ("B", "t0", 2), 100: ("n", "t1", 0)}
    got = values(K.read_table(spark, root), "id", "v", "created_at", "part")
    assert len(got) == len(want) and {i: tuple(r) for i, *r in got} == want
    K.upsert_table(batch, root, "id", partition=partition)
    assert not set(before) <= set(data_files(root)) and K.read_table(spark, root).count() == 41
    assert len(os.listdir(root + "/manifests")) <= 4  # two versions and their check sums
    assert K.upsert_table(batch.limit(0), root, "id").version == 2


def test_a_crash_before_the_swap_keeps_the_table(spark, folder, monkeypatch):
    root = folder + "/p"
    rows = lambda v: spark.createDataFrame([(i, v) for i in range(9)], "id int, v string")
    K.upsert_table(rows("a"), root, "id", buckets=4)
    with monkeypatch.context() as patch:
        patch.setattr(M, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost the driver")))
        with pytest.raises(RuntimeError, match="lost"):
            K.upsert_table(rows("b"), root, "id")
    assert {r["v"] for r in K.read_table(spark, root).collect()} == {"a"}
    K.upsert_table(rows("c"), root, "id")
    assert {r["v"] for r in K.read_table(spark, root).collect()} == {"c"} and K.read_table(spark, root).count() == 9


def test_the_second_of_two_writers_fails(spark, folder):
    root = folder + "/p"
    rows = spark.createDataFrame([(1, "a")], "id int, v string")
    version = K.upsert_table(rows, root, "id", buckets=2)
    K.upsert_table(rows.withColumn("v", F.lit("b")), root, "id")
    with pytest.raises(M.ConcurrentWrite):
        M.commit(spark, root, replace(version, version=1))
    assert values(K.read_table(spark, root), "id", "v") == [(1, "b")]


def test_appends_join_folders(spark, folder, monkeypatch):
    monkeypatch.setattr(M, "MOST_FOLDERS", 3)
    root = folder + "/p"
    for i in range(8):
        manifest = K.append_rows(spark.createDataFrame([(k, i) for k in range(6)], "id int, batch int"), root, "id", 2, {"batch": str(i)})
    assert manifest.marks == {"batch": "7"} and max(map(len, manifest.folders.values())) <= 3
    assert sorted(values(K.read_table(spark, root), "id", "batch")) == sorted((k, i) for k in range(6) for i in range(8))


def test_run_state_sections(spark, folder):
    K.write_run_state(spark, {"a": 1, "b": True}, "sync", folder + "/s")
    K.write_run_state(spark, {"a": 2}, "sync", folder + "/s")
    K.write_run_state(spark, {"z": "q"}, "list", folder + "/s")
    state = {r["section"]: r["metrics"] for r in read_published(spark, folder + "/s", K.publish.STATE_SCHEMA).collect()}
    assert state == {"sync": {"a": "2", "b": "true"}, "list": {"z": "q"}}


def simulation(spark, truncated=False, listed=2):
    listing = spark.createDataFrame([("all", 1, json.dumps({"data": {"totalCount": 2, "liveArr": [{"backtestId": i} for i in range(1, listed + 1)]}}))], "listing string, page bigint, payload string")
    record = json.dumps({"data": {"isLimit": truncated, "position": [{"date": "2024-01-01"}]}})
    records = S.scan_day_records(spark.createDataFrame([(1, "2024-01-01", record)], "sim_id bigint, requested_date string, payload string"), "positions")
    empty = json.dumps({"data": {"state": "0", "result": None}})
    series = S.scan_series_pages(spark.createDataFrame([("1", 1, empty)], "series_id string, page bigint, payload string"))
    return simulation_snapshot(*S.scan_simulation_pages(listing), records, series)


def test_incomplete_snapshot_keeps_the_old_one(spark, folder):
    root = folder + "/snap"
    K.publish_snapshot(*simulation(spark), root)
    first = published_path(spark, root)
    for bad in (simulation(spark, truncated=True), simulation(spark, listed=1)):
        with pytest.raises(IncompleteSnapshot):
            K.publish_snapshot(*bad, root)
        assert published_path(spark, root) == first
    assert spark.read.parquet(first + "/points").count() == 0 and spark.read.parquet(first + "/listing").count() == 2


def test_snapshot_notices_what_is_missing(spark):
    def page(count, offset):
        line = {"time": list(range(count)), "value": [0.5] * count}
        return json.dumps({"data": {"state": "2", "result": {"count": count, "offset": offset, "overallReturn": line, "benchmark": line}}})

    def reasons(pages, **expected):
        (listing, items), records = _listing_and_records(spark)
        series = S.scan_series_pages(spark.createDataFrame([(s, i, p) for s, i, p in pages], "series_id string, page bigint, payload string"))
        _, problems = simulation_snapshot(listing, items, records, series, **expected)
        return sorted(r[0] for r in problems.collect())

    ended = [("a", 1, page(2, 0)), ("a", 2, page(0, 77))]  # an end page may state any offset
    assert reasons(ended) == []
    assert reasons([*ended, ("b", 1, page(3, 0))]) == ["curve b: no end page"]
    assert reasons([("b", 1, page(3, 0))], intraday=spark.createDataFrame([("b",)], "series_id string")) == []
    days = spark.createDataFrame([(1, "positions", "2024-01-01"), (1, "positions", "2024-01-02"), (2, "positions", "2024-01-01")], "sim_id bigint, kind string, requested_date string")
    curves = spark.createDataFrame([("a",), ("c",)], "series_id string")
    assert reasons(ended, expected_days=days, expected_series=curves) == [
        "curve c is missing", "positions missing for 1 on 2024-01-02", "positions missing for 2 on 2024-01-01"]


def _listing_and_records(spark):
    listing = spark.createDataFrame([("all", 1, json.dumps({"data": {"totalCount": 1, "liveArr": [{"backtestId": 1}]}}))], "listing string, page bigint, payload string")
    record = json.dumps({"data": {"isLimit": False, "position": [{"date": "2024-01-01"}]}})
    records = S.scan_day_records(spark.createDataFrame([(1, "2024-01-01", record)], "sim_id bigint, requested_date string, payload string"), "positions")
    return S.scan_simulation_pages(listing), records


def test_compaction_never_goes_back_in_time(spark, folder):
    root, log, checkpoint = folder + "/archive", folder + "/log", folder + "/cp"
    land(folder, "a", "f", 1, [(1, "2024-01-05 00:00:00", "old", 0)])
    I.stream_ingest(spark, folder + "/landing", log, checkpoint).awaitTermination()
    archive = I.compact_archive(spark, root, log)
    detail = archive.withColumn("title", F.lit("new title")).withColumn("view_count", F.lit(99).cast("bigint"))
    K.publish.replace_published(detail, root)
    assert values(I.compact_archive(spark, root, log), "title", "view_count") == [("new title", 99)]
    land(folder, "b", "f", 1, [(2, "2024-01-06 00:00:00", "two", 0)])
    I.stream_ingest(spark, folder + "/landing", log, checkpoint).awaitTermination()
    assert sorted(values(I.compact_archive(spark, root, log), "id", "title")) == [("1", "new title"), ("2", "two")]


def land(folder, name, feed, page, posts, reading=None):
    os.makedirs(folder + "/landing", exist_ok=True)
    payload = json.dumps({"code": "00000", "data": {"list": [{"postId": i, "addTime": t, "title": x, "isTop": p} for i, t, x, p in posts]}})
    with open(f"{folder}/landing/{name}.json", "w") as out:
        out.write(json.dumps({"feed": feed, "reading": reading, "page": page, "payload": payload}) + "\n")


def test_ingest_is_idempotent_and_merges(spark, folder):
    root, log, checkpoint = folder + "/archive", folder + "/log", folder + "/cp"
    run = lambda cut=None: I.stream_ingest(spark, folder + "/landing", log, checkpoint, cut).awaitTermination()
    land(folder, "a", "f", 1, [(1, "2024-01-05 00:00:00", "one", 0), (2, "2024-01-04 00:00:00", "two", 0)])
    run()
    archive = I.compact_archive(spark, root, log)
    assert sorted(values(archive, "id", "title")) == [("1", "one"), ("2", "two")]
    land(folder, "b", "f", 1, [(3, "2024-01-06 00:00:00", "three", 0), (1, "2024-01-05 00:00:00", "", 0), (9, "2019-01-01 00:00:00", "old pin", 1)])
    land(folder, "c", "f", 1, [(1, "2024-01-05 00:00:00", "", 0)])
    run(I.high_watermark(archive, until="2030-01-01"))
    again = I.compact_archive(spark, root, log)
    # The blank title does not erase the first one, and the pinned old row is left out.
    want = [("1", "one"), ("2", "two"), ("3", "three")]
    assert sorted(values(again, "id", "title")) == want
    assert sorted(values(I.compact_archive(spark, root, log), "id", "title")) == want
    run()
    assert sorted(values(I.compact_archive(spark, root, log), "id", "title")) == want


def test_high_watermark_overrides_until(spark):
    rows = spark.createDataFrame([("2024-01-02 03:04:05",), ("junk",), ("2023-01-01",)], "published_at string")
    cut = spark.range(1).select(I.high_watermark(rows, "2030-01-01").cast("string")).first()[0]
    assert cut == "2024-01-02 03:04:05"
    empty = rows.where("published_at = 'junk'")
    assert spark.range(1).select(I.high_watermark(empty, "2030-01-01").cast("string")).first()[0] == "2030-01-01 00:00:00"
    assert I.high_watermark(empty, None) is None


POLL = T.StructType([
    T.StructField(n, k) for n, k in [
        ("run_id", T.StringType()), ("core", T.BooleanType()), ("listed", T.StringType()), ("listed_core", T.BooleanType()),
        ("state", T.StringType()), ("has_errors", T.BooleanType()), ("at", T.LongType())]
])


def test_run_tracking_ends_and_times_out(spark, folder):
    source = folder + "/polls"
    os.makedirs(source)

    def poll(name, *rows):
        with open(f"{source}/.{name}.tmp", "w") as out:
            for r in rows:
                out.write(json.dumps(r) + "\n")
        os.rename(f"{source}/.{name}.tmp", f"{source}/{name}.json")

    poll("1", {"run_id": "a", "state": "0", "at": 1}, {"run_id": "b", "listed": "cancelled", "has_errors": True, "at": 1}, {"run_id": "c", "state": "0", "at": 1})
    polls = spark.readStream.schema(POLL).json(source)
    query = (
        track_run_status(polls, 15000).writeStream.format("memory").queryName("ended").outputMode("append")
        .option("checkpointLocation", folder + "/cp").trigger(processingTime="1 second").start()
    )
    ended = lambda: {r["run_id"]: (r["status"], r["decided_by"]) for r in spark.table("ended").collect()}
    try:
        # Processing-time timers make a batch at every trigger, so the query never counts as idle.
        deadline = time.time() + 60
        while not ended() and time.time() < deadline:
            time.sleep(0.3)
        assert ended().get("b") == ("failed", "listing")
        poll("2", {"run_id": "a", "core": True, "at": 2}, {"run_id": "b", "core": True, "at": 2})
        deadline = time.time() + 60
        while len(ended()) < 3 and time.time() < deadline:
            time.sleep(0.5)
        assert ended() == {"a": ("done", "stats"), "b": ("failed", "listing"), "c": ("timeout", "none")}
        assert spark.table("ended").count() == 3
    finally:
        query.stop()


def test_progress_events(spark, folder):
    land(folder, "a", "f", 1, [(1, "2024-01-05 00:00:00", "one", 0), (2, "2024-01-04 00:00:00", "two", 0)])
    events = []
    listener = progress_events(spark, events.append)
    try:
        rows = observed(I.normalize_pages(spark.readStream.schema(I.LANDING_SCHEMA).json(folder + "/landing")))
        query = rows.select("id").writeStream.format("noop").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        deadline = time.time() + 30
        while not any(e["type"] == "done" for e in events) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [e["type"] for e in events][-1] == "done" and events[-1]["items_seen"] == 2
    assert any(e["type"] == "progress" and e["page_items"] == 2 for e in events)


def test_checkpoint_folder_comes_from_the_session(spark):
    path = checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir()
    assert cut_lineage(spark.range(3)).count() == 3


def test_a_reading_ends_across_batches(spark, folder):
    """The end found in one batch holds in later ones, but neither for another reading nor for another cut."""
    log, checkpoint = folder + "/log", folder + "/cp"

    def run(cut="2024-01-05"):
        query = I.stream_ingest(spark, folder + "/landing", log, checkpoint, cut=cut)
        query.awaitTermination()
        return [p.observedMetrics["feed"] for p in query.recentProgress if "feed" in (p.observedMetrics or {})]

    taken = lambda: sorted(values(I.read_log(spark, log), "batch", "id"))
    land(folder, "a", "f", 1, [(1, "2024-01-09 00:00:00", "x", 0), (90, "2020-01-01 00:00:00", "pin", 1), (2, "2024-01-08 00:00:00", "x", 0)], "r1")
    land(folder, "b", "f", 2, [(3, "2024-01-07 00:00:00", "x", 0), (4, "2024-01-01 00:00:00", "end", 0), (5, "2024-01-06 00:00:00", "behind", 0)], "r1")
    land(folder, "g", "g", 1, [], "r1")
    metrics = run()
    assert taken() == [(0, "1"), (0, "2"), (0, "3")]
    assert [(m["items"], m["late"]) for m in metrics] == [(6, 2)]
    land(folder, "c", "f", 3, [(6, "2024-01-08 00:00:00", "behind", 0), (91, "2020-01-01 00:00:00", "pin", 1)], "r1")
    land(folder, "d", "f", 1, [(7, "2024-01-10 00:00:00", "x", 0)], "r2")
    land(folder, "h", "g", 2, [(8, "2024-01-08 00:00:00", "x", 0)], "r1")
    assert [(m["items"], m["late"]) for m in run()] == [(4, 1)]
    assert taken() == [(0, "1"), (0, "2"), (0, "3"), (1, "7"), (1, "8")]
    events = {(r["type"], r["feed"], r["reading"], r["page"]): r for r in I.feed_events(spark, log).collect()}
    assert [(events["progress", "f", "r1", p]["page_items"], events["progress", "f", "r1", p]["items_seen"]) for p in (1, 2)] == [(2, 2), (1, 3)]
    assert ("progress", "f", "r1", 3) not in events and events["progress", "g", "r1", 1]["page_items"] == 0
    done = events["done", "f", "r1", None]
    assert (done["items_seen"], done["pages_read"], done["stopped"]) == (3, 2, True) and not events["done", "f", "r2", None]["stopped"]
    # A replay of the last batch writes the same again.
    replay_last(checkpoint)
    run()
    assert taken() == [(0, "1"), (0, "2"), (0, "3"), (1, "7"), (1, "8")] and I.feed_events(spark, log).count() == len(events)
    land(folder, "e", "f", 3, [(9, "2024-01-08 00:00:00", "x", 0)], "r1")
    run(cut="2024-01-04")
    assert (2, "9") in taken()


def replay_last(checkpoint):
    """Forget that the last batch was committed, as after a crash."""
    folder = checkpoint + "/commits"
    last = max(int(n) for n in os.listdir(folder) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{folder}/{name}"):
            os.unlink(f"{folder}/{name}")


def test_a_post_counts_as_it_was_read_last(spark, folder):
    land(folder, "a", "f", 2, [(1, "2024-01-05 00:00:00", "a later page", 0)])
    land(folder, "b", "f", 1, [(1, "2024-01-05 00:00:00", "an earlier page", 0)])
    I.stream_ingest(spark, folder + "/landing", folder + "/log", folder + "/cp").awaitTermination()
    assert values(I.compact_archive(spark, folder + "/archive", folder + "/log"), "title") == [("a later page",)]


def test_stream_dedupe_reads_touched_buckets_and_replays(spark, folder):
    source, target, checkpoint = folder + "/in", folder + "/out", folder + "/cp"
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    run = lambda: I.stream_dedupe(spark, source, schema, target, checkpoint, buckets=16).awaitTermination()
    got = lambda: sorted(values(spark.read.schema(schema).json(target), "id", "n"))
    spark.createDataFrame([(str(i % 50), i) for i in range(100)] + [("", 1), (None, 2)], schema).coalesce(1).write.mode("append").json(source)
    run()
    first = [(str(i), i) for i in range(50)]
    assert got() == sorted(first)
    spark.createDataFrame([("7", 700), ("new", 1)], schema).coalesce(1).write.mode("append").json(source)
    run()
    assert got() == sorted([*first, ("new", 1)])
    ledger = I.IdLedger(spark, target + "/_ids", "id", 16)
    batch = spark.createDataFrame([("7", 1)], schema)
    files = ledger.known(batch, 9).inputFiles()
    assert files and len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    replay_last(checkpoint)
    run()
    assert got() == sorted([*first, ("new", 1)]) and I.read_table(spark, target + "/_ids").count() == 51
    # A crash after the rows and before the ids: the replay writes the same rows and records them.
    fresh = I.IdLedger(spark, folder + "/ids2", "id", 4)
    I.write_new_rows(batch, 0, fresh, folder + "/out2")
    fresh.record(spark.createDataFrame([("other", 1)], schema), 0)
    assert {r["id"] for r in I.read_table(spark, folder + "/ids2").collect()} == {"7"}
    I.write_new_rows(batch, 0, fresh, folder + "/out2")
    I.write_new_rows(batch, 1, fresh, folder + "/out2")
    assert values(spark.read.schema(schema).json(folder + "/out2"), "id", "n") == [("7", 1)]


def test_a_target_without_a_ledger_gets_one(spark, folder):
    schema = T.StructType([T.StructField("id", T.StringType())])
    spark.createDataFrame([("a",), ("b",)], schema).write.json(folder + "/out/batch=0")
    spark.createDataFrame([("b",), ("c",)], schema).write.json(folder + "/in")
    I.stream_dedupe(spark, folder + "/in", schema, folder + "/out", folder + "/cp", buckets=4).awaitTermination()
    assert {r["id"] for r in I.read_table(spark, folder + "/out/_ids").collect()} >= {"a", "b"}


class FakeHandle:
    """Value states and timers of one key, kept in dictionaries."""

    def __init__(self):
        self.values, self.ttl, self.timers = {}, {}, []

    def getValueState(self, name, schema, ttl=None):
        self.ttl[name] = ttl
        values_ = self.values

        class State:
            def exists(self):
                return name in values_

            def get(self):
                return values_[name]

            def update(self, value):
                values_[name] = value

            def clear(self):
                values_.pop(name, None)

        return State()

    def registerTimer(self, at):
        self.timers.append(at)


def test_evidence_order_and_tombstones():
    import pandas as pd

    from postmart.streaming.status import RunTracker

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    def polls(*rows):
        return pd.DataFrame(rows, columns=["at", "status", "decided_by"])

    def tracker():
        t, handle = RunTracker(50, 700), FakeHandle()
        t.init(handle)
        return t, handle, lambda *frames: [tuple(r) for out in t.handleInputRows(("r",), iter(frames), Clock()) for r in out.itertuples(index=False)]

    t, handle, feed = tracker()
    assert feed(polls((5, "running", "listing"))) == [] and handle.timers == [1050] and handle.ttl == {"run": None, "ended": 700}
    assert feed(polls((3, "running", "old news"))) == [] and handle.values["run"] == ("running", "listing", 2, 5)
    # The earliest end counts, whichever batch it is in.
    assert feed(polls((9, "failed", "result")), polls((8, "done", "stats"), (7, "running", "none"))) == [("r", "done", "stats", 5)]
    assert feed(polls((1, "failed", "late"))) == [] and "run" not in handle.values
    assert list(t.handleExpiredTimer(("r",), Clock(), None)) == []
    t, handle, feed = tracker()
    feed(polls((5, "running", "listing")))
    assert [tuple(r) for out in t.handleExpiredTimer(("r",), Clock(), None) for r in out.itertuples(index=False)] == [("r", "timeout", "listing", 1)]
    assert feed(polls((6, "done", "stats"))) == []


def test_landed_pages_are_derived_once(spark, monkeypatch):
    """The queries land their pages in several parts; what is landed is stored first, so the sources are read once."""
    from workload import q_sinks
    from workload.views import Views

    stored = []
    monkeypatch.setattr(q_sinks, "cut_lineage", lambda df: stored.append(cut_lineage(df)) or stored[-1])
    q_sinks._walked(Views(spark, "/root/testdata/sf0.001"))
    assert [set(df.columns) for df in stored] == [{"feed", "reading", "page", "payload"}]

"""How often inputs are read, where hot keys go, and where a reading ends."""

from pyspark.sql import functions as F

from postmart.operators import aggregates as A, filters, joins as J, windows as W
from postmart.operators.skew import heavy_keys, join_facts
from postmart.plans.runs import reconcile_status, run_evidence


def stored(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def scans(df):
    """Files read by the plan that ran; what an exchange is reused for is not read again."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def feed(spark, folder):
    rows = [("big" if i % 3 else f"f{i % 5}", i, i // 20 + 1, f"id{i}", f"2024-01-{28 - i // 100:02d} 00:00:00", i % 50 == 0) for i in range(2000)]
    return stored(spark, folder, "feed", spark.createDataFrame(rows, "feed string, pos bigint, page bigint, id string, published_at string, is_top boolean"))


def test_take_until_reads_its_input_twice_at_most(spark, folder):
    assert scans(filters.take_until(feed(spark, folder), "feed", "pos", until="2024-01-20")) <= 2


def test_page_progress_reads_each_input_once(spark, folder):
    rows = feed(spark, folder)
    pages = stored(spark, folder, "pages", rows.select("feed", "page").distinct())
    progress = W.page_progress(rows, pages)
    assert scans(progress) == 2
    got = {(r["feed"], r["page"]): r["items_seen"] for r in progress.collect()}
    assert got[("big", 100)] == rows.where("feed = 'big'").count()


def batch(spark):
    columns = "line_no bigint, id string, logical_key string, body string"
    rows = [(i, None if i % 10 == 0 else ("same" if i % 3 == 0 else f"n{i}"), "hot" if i % 2 else f"k{i % 7}", f"text {i}") for i in range(400)]
    rows += [(900, "n1", "own", "known id"), (901, "x", "old", "known key"), (902, "y", None, "no key"), (903, "z", "", "blank"), (904, "zz", "", "blank again"), (905, "", "fresh", "no id")]
    existing = spark.createDataFrame([("n1", "hers"), ("q", "old"), (None, "k3"), ("", "k4"), ("q", "")], "id string, logical_key string")
    return spark.createDataFrame(rows, columns), existing


def test_import_reads_each_side_twice_at_most_and_matches_a_loop(spark, folder):
    rows, existing = batch(spark)
    got = {r["line_no"]: r["outcome"] for r in W.mark_import(rows.repartition(5), existing).collect()}
    ids, keys, want = {r[0] for r in existing.collect() if r[0]}, {r[1] for r in existing.collect() if r[1]}, {}
    for r in sorted(rows.collect()):
        if not r["id"]:
            want[r["line_no"]] = None
        elif r["id"] in ids or r["logical_key"] in keys or r["logical_key"] is None:
            want[r["line_no"]] = "skipped"
        else:
            keys.add(r["logical_key"])
            want[r["line_no"]] = "imported"
    assert got == want
    new = W.skip_existing_import(stored(spark, folder, "rows", rows), stored(spark, folder, "existing", existing))
    assert scans(new) <= 4
    assert {r["line_no"] for r in new.collect()} == {k for k, v in want.items() if v == "imported"}
    assert new.columns == rows.columns


def test_hot_keys_are_split_and_facts_repeated_within_bounds(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id")
    facts = left.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for rows in ("n", None):
        given = facts if rows else facts.drop("n")
        heavy = {r["k"]: r["__salts"] for r in heavy_keys(left, given, "k", rows, F.col("k").isNotNull()).collect()}
        assert heavy["hot"] > 1 and sum(heavy.values()) <= 2 * parts
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            joined = join_facts(left, given, "k", ["id"], rows=rows)
            where = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p"), "top").groupBy("p").count().collect()
            assert len(where) > 1 and sum(r["count"] for r in where) == left.where("k = 'hot'").count()
            assert joined.where("top IS NULL").count() == 0 and joined.count() == 20_000
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_asked_for_often_resolve_every_time(spark):
    runs = spark.createDataFrame([(0, "a", "L1", None), (1, "b", "a", "s")], "pos bigint, id string, list_id string, source_id string")
    ids = spark.createDataFrame([("a",)] * 50 + [("s",), ("none",), (None,)], "wanted string")
    got = sorted((str(r["wanted"]), str(r["id"])) for r in J.resolve_run(ids, runs).collect())
    assert got == [("None", "None")] + [("a", "a")] * 50 + [("none", "None"), ("s", "b")]


def test_evidence_is_one_row_per_run(spark):
    metrics = "run_id string, annual_algo_return double, sharpe double"
    stats = spark.createDataFrame([("r1", 0.1, 1.0), ("r2", None, 1.0), ("own", 0.2, 2.0)], metrics)
    results = spark.createDataFrame([("r2", 2), ("r3", 99)], "run_id string, state bigint")
    logs = spark.createDataFrame([("r2", "x")] * 30 + [("r4", "y")], "run_id string, line string")
    known = {r["run_id"]: (r["core"], r["has_errors"]) for r in run_evidence(stats, results, logs).collect()}
    assert known == {"r1": (True, None), "r2": (False, True), "own": (True, None), "r3": (None, None), "r4": (None, True)}
    listing = spark.createDataFrame([(i, "own", f"w{i}", None, "done") for i in range(40)], "pos bigint, id string, list_id string, source_id string, status string")
    wanted = spark.createDataFrame([(f"w{i}",) for i in range(40)], "wanted string")
    got = reconcile_status(wanted, stats, listing, results, logs).collect()
    assert {(r["resolved_id"], r["status"], r["decided_by"]) for r in got} == {("own", "done", "listing stats")} and len(got) == 40


def test_an_empty_page_ends_a_reading(spark):
    pages = spark.createDataFrame(
        [("a", p, 100 + p, f"t{p}") for p in (1, 2, 3, 4)] + [("b", 1, None, "u1")] + [("c", p, 7, f"v{p}") for p in (1, 2)], "feed string, page bigint, total_count bigint, curr_time string")
    marked = spark.createDataFrame(
        [("a", 1, 0, False, None), ("a", 1, 1, False, None), ("a", 2, 2, False, None), ("a", 4, 3, True, "until"), ("c", 1, 0, False, None), ("c", 1, 1, True, "until"), ("c", 2, 2, True, "until")],
        "feed string, page bigint, pos bigint, is_old boolean, stop_kind string")
    got = {r["feed"]: (r["pages_read"], r["total_count"], r["curr_time"], r["stopped_by_until"], r["items_seen"]) for r in A.feed_summary(pages, marked).collect()}
    assert got == {"a": (2, 101, "t3", False, 3), "b": (0, None, "u1", False, 0), "c": (1, 7, "v1", True, 1)}

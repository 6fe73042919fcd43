"""Feed stop rules against a plain loop, and the status ladder against a truth table."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from postmart.operators import filters, joins as J, windows as W
from postmart.operators.aggregates import feed_summary
from postmart.plans.runs import reconcile_status, status_ladder
from postmart.plans.serve import list_posts
from tests.conftest import values


def loop(rows, since_id=None, until=None):
    """rows: (id, time, pinned) newest first; the ids a reader would emit."""
    out = []
    for post, time, pinned in rows:
        if since_id and post == since_id:
            break
        if until and time and time < until:
            if pinned:
                continue
            break
        out.append(post)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_take_until_equals_loop(spark, seed):
    rng = random.Random(seed)
    feeds = {}
    for feed in ("x", "y"):
        feeds[feed] = [(str(i), f"2024-01-{rng.randint(1, 28):02d} 00:00:00" if rng.random() > 0.1 else rng.choice(["", "soon"]), rng.random() < 0.3) for i in range(60)]
    flat = [(f, p, i, t, top) for f, rows in feeds.items() for p, (i, t, top) in enumerate(rows)]
    df = spark.createDataFrame(flat, "feed string, pos bigint, id string, published_at string, is_top boolean").repartition(3)
    for since_id, until in (("30", None), (None, "2024-01-05"), ("12", "2024-01-03 00:00:00"), (None, None)):
        cut = until if until is None or len(until) > 10 else until + " 00:00:00"
        got = {}
        for f, p, i in values(filters.take_until(df, "feed", "pos", since_id, until), "feed", "pos", "id"):
            got.setdefault(f, []).append((p, i))
        for f, rows in feeds.items():
            parsable = [(i, t if t.startswith("2024") else None, top) for i, t, top in rows]
            assert [i for _, i in sorted(got.get(f, []))] == loop(parsable, since_id, cut), (f, since_id, until)


def test_rows_at_the_cut_are_read_again(spark):
    df = spark.createDataFrame([("f", 0, "a", "2024-01-02 00:00:00", False)], "feed string, pos bigint, id string, published_at string, is_top boolean")
    assert filters.take_until(df, "feed", "pos", until="2024-01-02").count() == 1


@pytest.mark.parametrize("bad", ["", "  ", "2024-13-01", "yesterday", "2024-01-01 25:00:00", "01-02-2024"])
def test_bad_until_is_an_error(bad):
    with pytest.raises(ValueError):
        filters.parse_until(bad)


def test_feed_summary_counts_the_stopped_page(spark):
    rows = [("f", 1, 0, "a", "2024-01-09", False), ("f", 1, 1, "old pin", "2020-01-01", True), ("f", 2, 0, "b", "2024-01-08", False),
            ("f", 2, 1, "end", "2023-01-01", False), ("f", 3, 0, "never", "2024-01-07", False)]
    df = spark.createDataFrame(rows, "feed string, page bigint, pos bigint, id string, published_at string, is_top boolean")
    pages = spark.createDataFrame([("f", 1, None, "t1"), ("f", 2, 40, "t2"), ("f", 3, 50, "t3")], "feed string, page bigint, total_count bigint, curr_time string")
    s = feed_summary(pages, filters.mark_feed_stop(df, until="2024-01-01")).first()
    assert (s["pages_read"], s["items_seen"], s["total_count"], s["curr_time"], s["stopped_by_until"], s["stopped_by_since_id"]) == (2, 2, 40, "t2", True, False)


def decide(core, listed, listed_core, result, errors):
    """Independent restatement of the precedence of evidence."""
    ended = lambda s: "failed" if s == "cancelled" and errors else s
    if core:
        return "done"
    provisional = False
    if listed is not None:
        if listed == "done":
            if listed_core:
                return "done"
            provisional = True
        elif listed in ("failed", "cancelled"):
            return ended(listed)
    if result == "done" and listed is None:
        return "done"
    if result in ("failed", "cancelled") and listed != "running":
        return ended(result)
    return "done" if provisional else "running"


def test_status_ladder_truth_table(spark):
    cases = list(itertools.product(
        (False, True), (None, "done", "failed", "cancelled", "running", "7"), (False, True), ("", "running", "failed", "done", "cancelled"), (False, True)))
    df = spark.createDataFrame(cases, "core boolean, listed string, lc boolean, result string, errors boolean")
    ladder = status_ladder(F.col("core"), F.col("listed"), F.col("lc"), F.col("result"), F.col("errors"))
    for row in df.select("*", ladder["status"].alias("status")).collect():
        assert row["status"] == decide(*row[:5]), row


def test_reconcile_follows_the_listed_id(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "wanted string")
    stats = spark.createDataFrame([("inner-a", 1.0, 0.0), ("b", None, 2.0)], "run_id string, annual_algo_return double, sharpe double")
    listing = spark.createDataFrame(
        [(1, "inner-a", "a", "", "done"), (2, "b", "x", "", "cancelled"), (3, "", "c", "src-c", "done"), (4, "b", "", "", "done")],
        "pos bigint, id string, list_id string, source_id string, status string")
    results = spark.createDataFrame([("c", "1"), ("d", "3")], "run_id string, state string")
    logs = spark.createDataFrame([("b", "boom"), ("b", "boom"), ("zzz", "x")], "run_id string, line string")
    got = {r["wanted"]: (r["resolved_id"], r["status"], r["decided_by"]) for r in reconcile_status(runs, stats, listing, results, logs).collect()}
    assert got == {"a": ("inner-a", "done", "listing stats"), "b": ("b", "failed", "listing"), "c": ("src-c", "failed", "result"), "d": ("d", "cancelled", "result")}


def test_logs_stop_at_the_first_empty_page(spark):
    pages = spark.createDataFrame(
        [("r", 1, ["a", "b"], False), ("r", 2, ["c"], False), ("r", 3, [], False), ("r", 4, ["late"], False), ("s", 1, ["x"], True), ("s", 2, ["y"], False), ("t", 1, None, None)],
        "run_id string, page bigint, lines array<string>, is_last boolean")
    assert sorted(values(W.assemble_log(pages, 5), "run_id", "offset", "line")) == [("r", 5, "a"), ("r", 6, "b"), ("r", 7, "c"), ("s", 5, "x")]
    got = {r["run_id"]: (r["pages_read"], r["next_offset"], r["is_last"]) for r in W.log_cursor(pages, 5).collect()}
    assert got == {"r": (3, 8, False), "s": (1, 6, True), "t": (1, 5, False)}


def test_new_item_falls_back_to_the_newest(spark):
    schema = "id string, updated_at string, pos bigint"
    after = spark.createDataFrame([("1", "2024", 0), ("2", "2025", 1), ("3", "2023", 2), ("", "2026", 3)], schema)
    assert J.find_new_item(spark.createDataFrame([("2", "", 0)], schema), after).first()["id"] == "1"
    assert J.find_new_item(after, after.where("id <> ''")).first()["id"] == "2"


def test_stats_enrichment_never_drops_a_post(spark):
    posts = spark.createDataFrame([("1", "b1", None, None), ("2", "", "old", None), ("3", "b3", "old", None), ("4", "b4", "old", "e")], "id string, backtest_id string, stats string, stats_error string")
    stats = spark.createDataFrame([("b1", "s", None), ("b3", None, "down"), ("", "ghost", None)], "backtest_id string, stats string, stats_error string")
    got = {r["id"]: (r["stats"], r["stats_error"]) for r in J.enrich_stats(posts, stats).collect()}
    assert got == {"1": ("s", None), "2": ("old", None), "3": ("old", "down"), "4": ("old", "no stats payload")}


def test_listing_parameters(spark):
    index = spark.createDataFrame(
        [("1", "100% gain", "x", "2024-01-02 10:00:00", 2.0, 1.0, 0, "|A|", 0), ("2", "Ünder", "y", "2024-01-03 00:00:00", None, 3.0, 1, "|B|A|", 0), ("3", "dup", "z", "2024-01-04 00:00:00", 1.0, 9.0, 0, "", 1)],
        "id string, title string, content_preview string, published_at string, period_years double, sharpe double, is_original_candidate int, labels_text string, is_hidden_duplicate int")
    index = index.withColumn("logical_key", F.lit("k")).withColumn("annual_return", F.lit(0.5))
    archives = spark.createDataFrame([("1", "downloaded", "c"), ("2", "cloning", None)], "post_id string, status string, cloned_strategy_id string")
    runs = spark.createDataFrame([(5, "1", "failed"), (9, "1", "done")], "id bigint, post_id string, status string")
    labels = spark.createDataFrame([("1", "b"), ("1", "a")], "post_id string, label string")

    def ids(**params):
        listing = list_posts(index, archives, runs, labels, **params)
        rows = [r["id"] for r in listing.page.collect()]
        assert listing.total.first()[0] >= len(rows)
        return rows

    assert ids() == ["2", "1"]
    assert ids(include_duplicates="1") == ["3", "2", "1"]
    assert ids(published_to="2024-01-02") == [] and ids(published_to="2024-01-02 10:00:00") == ["1"]
    assert ids(min_period_years="2") == ["1"] and ids(max_sharpe="1") == ["1"] and ids(min_sharpe="0") == ["2", "1"]
    assert ids(label="原创候选") == ["2"] and ids(label="A") == ["2", "1"] and ids(label="B") == ["2"]
    assert ids(downloaded="1") == ["1"] and ids(downloaded="0") == ["2"] and ids(backtested="1") == ["1"] and ids(backtested="x") == ["2", "1"]
    assert ids(q="0%G") == ["1"] and ids(q="nope") == [] and ids(q="\\") == []
    assert ids(sort="published_asc") == ["1", "2"] and ids(sort="period_desc") == ["1", "2"]
    assert ids(page_size=1, page=2) == ["1"] and ids(page=9) == []
    row = list_posts(index, archives, runs, labels).page.where("id = '1'").first()
    assert (row["download_status"], row["last_backtest_run_id"], row["last_backtest_status"], row["labels"]) == ("downloaded", 9, "done", ["a", "b"])


def test_find_new_item_ties_go_by_position(spark, folder):
    """Items of one day with ids of several lengths: the query and its SQL take the first position, not the first text."""
    import duckdb

    from workload import load

    queries, sql = load()
    spark.sql("SELECT id AS o_orderkey, TIMESTAMP_NTZ'2024-01-01' AS o_orderdate FROM VALUES (8L), (9L), (13L), (101L) t(id)").write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    got = values(queries["find_new_item"](spark, folder), "id")
    assert got == con.execute(sql["find_new_item"]).fetchall() == [("9",)]

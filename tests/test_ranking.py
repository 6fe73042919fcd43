"""Bucket-wise positions, skewed joins and deep pages equal their plain forms, hot groups included."""

import random

import pytest
from pyspark.sql import Window, functions as F

from postmart.operators import ranking as R, sorting as S
from postmart.operators.skew import join_facts


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(("hot" if i % 3 else f"k{rng.randrange(40)}"), i, rng.randrange(10), f"t{rng.randrange(30):02d}") for i in range(900)]
    return spark.createDataFrame(rows, "g string, id bigint, v bigint, t string").repartition(4).cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("descending", [False, True])
def test_split_row_number(skewed, descending):
    order = [F.desc("id")] if descending else [F.asc("id")]
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    split = R.split_row_number(skewed, ["g"], order, F.floor(F.col("id") / 50), "n", descending=descending)
    assert same(plain.select("id", "n"), split.select("id", "n"))


def test_split_running_sum(skewed):
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("s", F.sum("v").over(w))
    assert same(plain.select("id", "s"), R.split_running_sum(skewed, ["g"], "id", "v", "s", width=64).select("id", "s"))


def test_global_rank_with_ties(skewed):
    order = [("v", True), ("t", False), ("id", False)]
    w = Window.orderBy(F.desc("v"), F.asc("t"), F.asc("id"))
    plain = skewed.withColumn("rank", F.row_number().over(w).cast("bigint"))
    assert same(plain.select("id", "rank"), R.global_rank(skewed, order, ranges=7).select("id", "rank"))


@pytest.mark.parametrize("hot_rows", [1, 10, 1_000_000])
@pytest.mark.parametrize("counted", [True, False])
def test_join_facts(skewed, hot_rows, counted):
    facts = skewed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).where(F.col("g") != "k3")
    plain = skewed.join(facts.drop("n"), "g", "left").select("g", "id", "top")
    rows = "n" if counted else None
    got = join_facts(skewed, facts if counted else facts.drop("n"), "g", ["id"], rows=rows, hot_rows=hot_rows)
    assert same(plain, got.select("g", "id", "top"))


def test_join_facts_spreads_nulls_and_never_matches_them(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("", 4)], "k string, id bigint")
    facts = spark.createDataFrame([("a", "x"), ("", "never")], "k string, f string")
    got = join_facts(left, facts, "k", ["id"], never=F.col("k") == "", hot_rows=1)
    assert sorted((r["id"], r["f"]) for r in got.collect()) == [(1, None), (2, None), (3, "x"), (4, None)]


@pytest.mark.parametrize("sort", ["published_desc", "published_asc", "sharpe_desc", "period_desc", "nonsense"])
def test_pages_partition_the_result(spark, sort):
    rows = [(f"{i:03d}", f"2024-01-{1 + i % 5:02d}", None if i % 7 == 0 else float(i % 4), None, float(i % 3)) for i in range(95)]
    df = spark.createDataFrame(rows, "id string, published_at string, sharpe double, annual_return double, period_years double")
    want = [r["id"] for r in S.sort_posts(df, sort).collect()]
    index = S.PageIndex(df, sort)
    jumped = [[r["id"] for r in S.page_posts(df, p, 20, sort, index).collect()] for p in (1, 2, 3, 4, 5, 6, 9)]
    assert [i for page in jumped for i in page] == want and jumped[5:] == [[], []]
    assert [r["id"] for r in S.page_posts(df, 3, 20, sort).collect()] == want[40:60]
    walked, cursor = [], None
    while page := S.page_after(df, cursor, 30, sort).collect():
        walked += [r["id"] for r in page]
        cursor = S.Cursor(page[-1][index._column], page[-1]["id"])
    assert walked == want
    assert S.page_posts(df.limit(0), 2, 20, sort).count() == 0


def test_page_clamps():
    assert S.clamp_page(None, None) == (1, 50)
    assert S.clamp_page("-3", "999") == (1, 200)
    assert S.clamp_page(2, -5) == (2, 1)

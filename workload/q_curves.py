"""Simulations: listings, day records, curves, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmart.functions import scalars as X
from postmart.operators import aggregates as A, windows as W
from postmart.operators.normalize import series_to_points
from postmart.sources import payloads as S
from workload.registry import query


def curve_payloads(v):
    """Curve pages as JSON; the benchmark is the curve at half height, one minute later."""
    s = v.series()
    line = lambda shift, scale: F.struct(
        F.transform("time", lambda t: t + shift).alias("time"), F.transform("value", lambda x: x * scale).alias("value"))
    result = F.struct("count", "offset", line(0, 1.0).alias("overallReturn"), line(60000, 0.5).alias("benchmark"))
    data = F.struct(F.lit("2").alias("state"), result.alias("result"))
    return s.select("series_id", "page", F.to_json(F.struct(F.lit("00000").alias("code"), data.alias("data"))).alias("payload"))


@query("scan_series_pages", """
SELECT series_id, page, '2' AS state, (page - 1) * 10 AS "offset", count(*) AS count, sum(ms) AS sum_time, round(sum(value), 4) AS sum_value,
 sum(ms) + 60000 * count(*) AS sum_benchmark_time FROM points_v GROUP BY series_id, page""")
def _(v):
    pages = S.scan_series_pages(curve_payloads(v))
    total = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x)
    return pages.select(
        "series_id", "page", "state", "offset", "count", total("time", "bigint").alias("sum_time"),
        F.round(total("value", "double"), 4).alias("sum_value"), total("benchmark_time", "bigint").alias("sum_benchmark_time"))


@query("series_to_points", """
SELECT series_id, page, i, ms AS time, value, ms + 60000 AS benchmark_time, value * 0.5 AS benchmark_value FROM points_v""")
def _(v):
    return series_to_points(S.scan_series_pages(curve_payloads(v)), ["series_id", "page"])


_SQL_PAGES = """
WITH p AS (SELECT series_id, page, CASE WHEN series_id % 10 = 3 AND page = 4 THEN 31 ELSE (page - 1) * 10 END AS "offset", count(*) AS count FROM points_v
 GROUP BY series_id, page HAVING NOT (series_id % 10 = 5 AND page = 2)),
w AS (SELECT *, lag(page) OVER x AS before, lag("offset" + count) OVER x AS upto FROM p WINDOW x AS (PARTITION BY series_id ORDER BY page))
"""


@query("check_offsets", _SQL_PAGES + """
SELECT series_id, page, "offset", count, CASE WHEN page = 1 THEN 0 WHEN before = page - 1 THEN upto END AS expected_offset,
 CASE WHEN page > 1 AND coalesce(before, -1) <> page - 1 THEN 'missing page'
 WHEN "offset" <> CASE WHEN page = 1 THEN 0 ELSE upto END THEN 'offset did not move forward' ELSE 'ok' END AS verdict FROM w""")
def _(v):
    """Some series jump at page 4, others lack page 2."""
    i, page = F.col("series_id") % 10, F.col("page")
    pages = v.series().where(~((i == 5) & (page == 2))).select(
        "series_id", "page", F.when((i == 3) & (page == 4), 31).otherwise(F.col("offset")).alias("offset"), "count")
    return W.check_offsets(pages)


def day_payloads(v, kind: str):
    """Payloads of simulations and requested days, at most 1024 rows each."""
    key = S.DAY_RECORD_KEYS[kind]
    row = F.struct("item_no", F.col("record_time").alias("date" if kind == "positions" else "time"))
    slot = F.floor(F.col("item_no") / 1024).alias("slot")
    days = v.days().groupBy("sim_id", "requested_date", slot).agg(F.collect_list(row).alias(key), F.bool_or("is_limit").alias("isLimit"))
    data = F.struct(key, F.when(F.col("isLimit"), "True").otherwise("0").alias("isLimit"))
    return days.select("sim_id", "requested_date", F.to_json(F.struct(F.lit("0").alias("status"), data.alias("data"))).alias("payload"))


@query("scan_day_records", """
SELECT d.sim_id, k.kind, d.requested_date, d.record_time, d.item_no AS order_key, (SELECT bool_or(x.is_limit) FROM days_v x WHERE x.sim_id = d.sim_id AND x.requested_date = d.requested_date AND x.item_no // 1024 = d.item_no // 1024) AS is_limit
FROM days_v d, (VALUES ('positions'), ('orders')) k(kind)""")
def _(v):
    parts = [S.scan_day_records(day_payloads(v, kind), kind) for kind in S.DAY_RECORD_KEYS]
    both = parts[0].unionByName(parts[1])
    return both.select("sim_id", "kind", "requested_date", "record_time", X.vget("item", "item_no", "bigint").alias("order_key"), "is_limit")


@query("day_summary", """
SELECT sim_id, 'orders' AS kind, requested_date, string_agg(DISTINCT record_time, ',' ORDER BY record_time) AS record_dates, count(*) AS n_items,
 NOT bool_or(is_limit) AS complete FROM days_v GROUP BY sim_id, requested_date""")
def _(v):
    records = S.scan_day_records(day_payloads(v, "orders"), "orders")
    return A.day_summary(records).withColumn("record_dates", F.array_join("record_dates", ","))


@query("records_complete", """
SELECT sim_id, 'orders' AS kind, NOT bool_or(is_limit) AS complete, count(DISTINCT requested_date) AS n_days FROM days_v GROUP BY sim_id""")
def _(v):
    return A.records_complete(A.day_summary(v.days().withColumn("kind", F.lit("orders"))))


@query("page_integrity", """
WITH r AS (SELECT c_nationkey AS listing, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS cnt FROM customer),
s AS (SELECT listing, count(*) AS cnt, count(DISTINCT (n - 1) // 20) AS pages FROM r GROUP BY listing)
SELECT listing, pages + CASE WHEN listing % 5 = 3 THEN 1 ELSE 0 END AS n_pages, cnt AS n_items, cnt + CASE WHEN listing % 5 IN (2, 3) THEN 1 ELSE 0 END AS total,
 CASE WHEN listing % 5 = 1 THEN 1 ELSE 0 END AS repeated_ids,
 CASE listing % 5 WHEN 1 THEN 'repeated id' WHEN 2 THEN 'total not reached' WHEN 3 THEN 'empty page before the total' WHEN 4 THEN 'row without id' ELSE 'ok' END AS verdict FROM s""")
def _(v):
    """Customers of a nation as a paged listing, with one kind of damage for each fifth of the nations."""
    from postmart.operators.ranking import range_bucket, split_row_number

    c = v.table("customer").select(F.col("c_nationkey").alias("listing"), "c_custkey")
    ranged = range_bucket(c, F.struct("c_custkey"))
    placed = split_row_number(ranged, ["listing"], [F.asc("c_custkey")], F.col("__range"), "n")
    kind, n = F.col("listing") % 5, F.col("n")
    raw = F.when((kind == 1) & (n == 2), F.lit("twin")).when((kind == 1) & (n == 1), F.lit("twin")).when((kind == 4) & (n == 3), "")
    row = F.struct(raw.alias("mark"))
    rows = placed.select(
        "listing", (F.floor((n - 1) / 20) + 1).alias("page"), "n",
        F.struct(F.coalesce(row["mark"], F.col("c_custkey").cast("string")).alias("backtestId")).alias("row"))
    counts = c.groupBy("listing").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.col("cnt") + F.when(F.col("listing") % 5 == 2, 1).when(F.col("listing") % 5 == 3, 1).otherwise(0)
    paged = rows.groupBy("listing", "page").agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("r")).select("listing", "page", F.col("r.row").alias("liveArr"))
    last = counts.where(F.col("listing") % 5 == 3).select("listing", (F.floor((F.col("cnt") - 1) / 20) + 2).alias("page"))
    empty = last.withColumn("liveArr", F.array().cast(paged.schema["liveArr"].dataType))
    pages = paged.unionByName(empty).join(counts, "listing")
    data = F.struct("liveArr", total.cast("string").alias("totalCount"))
    payloads = pages.select("listing", "page", F.to_json(F.struct(F.lit("00000").alias("code"), data.alias("data"))).alias("payload"))
    return A.page_integrity(*S.scan_simulation_pages(payloads))

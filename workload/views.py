"""The driver tables seen as posts, runs, feeds, curves and replies - once for Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmart.functions.labels import LabelTerms
from postmart.functions.scalars import DEFAULT_POST_URL
from postmart.operators.ranking import split_row_number

# Feed pages of 50 rows, curve pages of 10 points.
FEED_PAGE, CURVE_PAGE = 50, 10


# White space as the library squashes it, spelled for RE2.
SQL_WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_SQUASH = lambda e: f"trim(regexp_replace({e}, '{SQL_WS}+', ' ', 'g'))"
SQL_STRIP = lambda e: f"regexp_replace({e}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"

# Label vocabulary that occurs in the driver's invented prose.
TERMS = LabelTerms(
    positive=["the", "and", "und", "der", "que", "les", "ing", "tion"],
    tuning=["password", "secret"],
    combo=["icense", "opyright"],
    code=["http", "@"],
)


def wall_millis(column: str):
    """Milliseconds since 1970 of a zone-free timestamp, whatever the session zone is."""
    seconds = F.extract(F.lit("SECOND"), F.col(column)).cast("decimal(8,6)")
    whole = F.unix_date(F.to_date(column)).cast("bigint") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
    return whole * 1000 + F.floor(seconds * 1000)


class Views:
    """Lazily built frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def posts(self) -> DataFrame:
        docs = self.table("documents").join(self.table("labels").select("doc_id", "quality"), "doc_id", "left")
        n, i = F.col("n_chars"), F.col("doc_id")
        days = F.when(i % 7 != 0, n % 1500)
        published = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), n.cast("int"))
        return docs.select(
            i.cast("string").alias("id"),
            F.lit("post").alias("title"),
            F.concat(F.lit(DEFAULT_POST_URL), i.cast("string")).alias("url"),
            published.cast("string").alias("published_at"),
            published.cast("string").alias("updated_at"),
            F.col("lang").alias("author_name"),
            F.col("text").alias("content"),
            F.substring("text", 1, 500).alias("content_preview"),
            n.alias("view_count"),
            (i % 97).alias("like_count"),
            (n % 13).alias("reply_count"),
            F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("bt"), i.cast("string"))).alias("backtest_id"),
            F.lit("").alias("backtest_name"),
            days.alias("trading_days"),
            F.round(days / 250.0, 2).alias("period_years"),
            F.when(i % 4 != 0, (n % 900).cast("double") / 100.0).alias("annual_return"),
            F.when(i % 5 != 0, (n % 700).cast("double") / 100.0).alias("sharpe"),
            ((i % 60).cast("double") / 100.0).alias("max_drawdown"),
            (i % 211).alias("clone_count"),
            F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("is_original_candidate"),
            F.lit("archive").alias("source"),
            F.lit("").alias("raw_json"),
            F.lit("2024-01-01 00:00:00").alias("created_at"),
            F.lit("2024-01-01 00:00:00").alias("refreshed_at"),
        )

    def candidates(self) -> DataFrame:
        return self.table("labels").where(F.col("quality") == 1).select(F.col("doc_id").cast("string").alias("id"))

    def runs(self) -> DataFrame:
        e = self.table("events")
        day = F.substring(F.col("ts").cast("string"), 1, 10)
        return e.select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("post_id"),
            F.col("event_type").alias("status"), day.alias("start_date"), day.alias("end_date"),
            F.col("value").alias("annual_return"), F.round(F.col("value") / 10.0, 3).alias("sharpe"),
        )

    def archives(self) -> DataFrame:
        buyers = self.table("events").where(F.col("event_type") == "purchase").select("user_id").distinct()
        return buyers.select(
            F.col("user_id").cast("string").alias("post_id"), F.lit("downloaded").alias("status"),
            F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("cloned_strategy_id"),
        )

    def versions(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
            F.nullif("l_returnflag", F.lit("N")).alias("a"),
            F.when(F.col("l_linenumber") % 2 != 0, F.col("l_quantity")).alias("b"),
            F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("c"),
        )

    VERSION_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]

    def feed(self) -> DataFrame:
        e = self.table("events").select(
            F.col("event_type").alias("feed"), F.col("event_id").cast("string").alias("id"), "event_id", "ts",
            F.substring(F.col("ts").cast("string"), 1, 19).alias("published_at"),
            (F.get_json_object("props", "$.k").cast("int") > 95).alias("is_top"),
        )
        # Positions are found hour by hour, so a feed is never one task.
        hour = F.substring(F.col("ts").cast("string"), 1, 13)
        placed = split_row_number(
            e, ["feed"], [F.desc("ts"), F.asc("event_id")], hour, "pos", descending=True
        )
        return placed.withColumn("page", F.floor((F.col("pos") - 1) / FEED_PAGE) + 1).drop("ts")

    def series(self) -> DataFrame:
        """Curve pages per user: offsets, counts and parallel arrays of at most ten points."""
        e = self.table("events").select("user_id", "ts", "value")
        hour = F.substring(F.col("ts").cast("string"), 1, 13)
        placed = split_row_number(e, ["user_id"], [F.asc("ts")], hour, "n")
        page = (F.floor((F.col("n") - 1) / CURVE_PAGE) + 1).alias("page")
        ms = wall_millis("ts")
        return (
            placed.select("user_id", page, "n", ms.alias("ms"), "value")
            .groupBy("user_id", "page")
            .agg(F.array_sort(F.collect_list(F.struct("n", "ms", "value"))).alias("p"))
            .select(
                F.col("user_id").alias("series_id"), "page",
                ((F.col("page") - 1) * CURVE_PAGE).alias("offset"),
                F.size("p").cast("bigint").alias("count"),
                F.col("p.ms").alias("time"), F.col("p.value").alias("value"),
            )
        )

    def days(self) -> DataFrame:
        o = self.table("orders")
        date = F.to_date("o_orderdate")
        return o.select(
            (F.col("o_custkey") % 50).alias("sim_id"), date.cast("string").alias("requested_date"),
            F.date_sub(date, (F.col("o_orderkey") % 2).cast("int")).cast("string").alias("record_time"),
            (F.col("o_orderkey") % 500 == 0).alias("is_limit"), F.col("o_orderkey").alias("item_no"),
        )


def _hits(terms: list[str]) -> str:
    return " + ".join(f"CAST(contains(content, '{t}') AS INTEGER)" for t in terms)


SQL_VIEWS = {
    "features_v": f"""
SELECT id, length(content) AS n, {_hits(TERMS.positive)} AS positive, {_hits(TERMS.tuning)} AS tuning,
       {_hits(TERMS.combo)} AS combo, {_hits(TERMS.code)} AS code, period_years AS period, sharpe,
       is_original_candidate AS candidate
FROM posts_v
""",
    "labels_v": """
SELECT id AS post_id, '原创候选' AS label, 1.0::DOUBLE AS score, '命中原创候选数据集' AS reason FROM features_v WHERE candidate = 1
UNION ALL SELECT id, '详细思路', positive, '正文长度 ' || n || '，策略描述关键词 ' || positive || ' 个' FROM features_v WHERE n >= 350 AND positive >= 3
UNION ALL SELECT id, '简单调参', tuning, '正文包含调参类描述' FROM features_v WHERE tuning > 0
UNION ALL SELECT id, '简单组合', combo, '正文包含组合/拼接类描述' FROM features_v WHERE combo > 0
UNION ALL SELECT id, '代码为主', 1, '正文包含策略代码' FROM features_v WHERE code > 0
UNION ALL SELECT id, '回测大于1年', period, '回测约 ' || period || ' 年' FROM features_v WHERE period > 1
UNION ALL SELECT id, '回测大于3年', period, '回测约 ' || period || ' 年' FROM features_v WHERE period > 3
UNION ALL SELECT id, '夏普偏高', sharpe, '夏普 ' || sharpe FROM features_v WHERE sharpe > 2
UNION ALL SELECT id, '疑似过拟合', sharpe, '夏普 ' || sharpe || ' 异常偏高' FROM features_v WHERE sharpe > 5
UNION ALL SELECT id, '信息不足', n, '正文长度 ' || n FROM features_v WHERE n < 200
""",
    "labels_text_v": """
SELECT post_id, '|' || string_agg(label, '|' ORDER BY label) || '|' AS labels_text FROM labels_v GROUP BY post_id
""",
    "posts_v": f"""
SELECT CAST(d.doc_id AS VARCHAR) AS id, 'post' AS title,
       '{DEFAULT_POST_URL}' || d.doc_id AS url,
       strftime(TIMESTAMP '2023-01-01' + to_hours(d.n_chars), '%Y-%m-%d %H:%M:%S') AS published_at,
       strftime(TIMESTAMP '2023-01-01' + to_hours(d.n_chars), '%Y-%m-%d %H:%M:%S') AS updated_at,
       d.lang AS author_name, d.text AS content, substring(d.text, 1, 500) AS content_preview,
       d.n_chars AS view_count, d.doc_id % 97 AS like_count, d.n_chars % 13 AS reply_count,
       CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'bt' || d.doc_id END AS backtest_id, '' AS backtest_name,
       CASE WHEN d.doc_id % 7 <> 0 THEN d.n_chars % 1500 END AS trading_days,
       CASE WHEN d.doc_id % 7 <> 0 THEN round(CAST(d.n_chars % 1500 AS DOUBLE) / 250.0, 2) END AS period_years,
       CASE WHEN d.doc_id % 4 <> 0 THEN CAST(d.n_chars % 900 AS DOUBLE) / 100.0 END AS annual_return,
       CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.n_chars % 700 AS DOUBLE) / 100.0 END AS sharpe,
       CAST(d.doc_id % 60 AS DOUBLE) / 100.0 AS max_drawdown, d.doc_id % 211 AS clone_count,
       CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS is_original_candidate
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
    "candidates_v": "SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1",
    "runs_v": """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS post_id, event_type AS status,
       strftime(ts, '%Y-%m-%d') AS start_date, strftime(ts, '%Y-%m-%d') AS end_date,
       value AS annual_return, round(value / 10.0, 3) AS sharpe
FROM events
""",
    "archives_v": """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS post_id, 'downloaded' AS status, 'st' || user_id AS cloned_strategy_id
FROM events WHERE event_type = 'purchase'
""",
    "keyed_v": f"""
SELECT p.*, {SQL_SQUASH("author_name")} || chr(31) || {SQL_SQUASH("title")} || chr(31) || {SQL_SQUASH("published_at")}
       || chr(31) || CASE WHEN {SQL_STRIP("content_preview")} = '' THEN '' ELSE sha1({SQL_STRIP("content_preview")}) END
       AS logical_key
FROM posts_v p
""",
    "marked_v": """
SELECT k.*, row_number() OVER w AS place, first_value(id) OVER w AS best_id
FROM keyed_v k
WINDOW w AS (PARTITION BY logical_key
             ORDER BY CASE WHEN backtest_id <> '' THEN 1 ELSE 0 END DESC, clone_count DESC, like_count DESC, id DESC)
""",
    "index_v": """
SELECT id, title, url, published_at, updated_at, author_name, content, content_preview, view_count, like_count, reply_count,
       backtest_id, backtest_name, trading_days, period_years, annual_return, sharpe, max_drawdown, clone_count,
       is_original_candidate, logical_key, CASE WHEN place > 1 THEN 1 ELSE 0 END AS is_hidden_duplicate,
       CASE WHEN place > 1 THEN best_id END AS duplicate_of
FROM marked_v
""",
    "versions_v": """
SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, nullif(l_returnflag, 'N') AS a,
       CASE WHEN l_linenumber % 2 <> 0 THEN l_quantity END AS b,
       CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS c
FROM lineitem
""",
    "feed_v": f"""
SELECT f.*, (pos - 1) // {FEED_PAGE} + 1 AS page FROM (
  SELECT event_type AS feed, CAST(event_id AS VARCHAR) AS id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at,
         CAST(json_extract(props, '$.k') AS INTEGER) > 95 AS is_top,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS pos
  FROM events) f
""",
    "points_v": f"""
SELECT user_id AS series_id, (n - 1) // {CURVE_PAGE} + 1 AS page, (n - 1) % {CURVE_PAGE} AS i, ms, value FROM (
  SELECT user_id, epoch_us(ts) // 1000 AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) s
""",
    "days_v": """
SELECT o_custkey % 50 AS sim_id, strftime(o_orderdate, '%Y-%m-%d') AS requested_date,
       strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 2 AS INTEGER), '%Y-%m-%d') AS record_time,
       o_orderkey % 500 = 0 AS is_limit, o_orderkey AS item_no
FROM orders
""",
}

"""Column expressions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmart.functions import scalars as X
from postmart.functions.labels import label_posts
from workload.registry import query
from workload.views import SQL_SQUASH, TERMS, wall_millis


def _numbers(v):
    """Number texts of every kind: whole, fractional, blank, words, missing, padded."""
    line = F.col("l_linenumber").cast("string")
    text = (
        F.when(F.col("l_partkey") % 6 == 0, line)
        .when(F.col("l_partkey") % 6 == 1, F.concat(line, F.lit(".5")))
        .when(F.col("l_partkey") % 6 == 2, F.lit(""))
        .when(F.col("l_partkey") % 6 == 3, F.lit("abc"))
        .when(F.col("l_partkey") % 6 == 5, F.concat(F.lit(" "), (F.col("l_suppkey") % 3).cast("string"), F.lit(" ")))
    )
    return v.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", text.alias("t"))


_SQL_NUMBERS = """
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN CAST(l_linenumber AS VARCHAR)
  WHEN 1 THEN l_linenumber || '.5' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 5 THEN ' ' || (l_suppkey % 3) || ' ' END AS t
  FROM lineitem)
"""
_WHOLE = r"CASE WHEN regexp_full_match(trim(t), '[+-]?\d+') THEN CAST(trim(t) AS BIGINT) END"


@query("int_strict", _SQL_NUMBERS + f"""
SELECT l_orderkey, l_partkey, l_suppkey, t, {_WHOLE} AS value, coalesce({_WHOLE}, 0) AS or_zero FROM t""")
def _(v):
    return _numbers(v).select("*", X.int_strict("t").alias("value"), X.int_strict("t", 0).alias("or_zero"))


@query("int_trunc", _SQL_NUMBERS + """
SELECT l_orderkey, l_partkey, l_suppkey, t, CAST(trunc(TRY_CAST(t AS DOUBLE)) AS BIGINT) AS value FROM t""")
def _(v):
    return _numbers(v).select("*", X.int_trunc("t").alias("value"))


@query("float_or_null", _SQL_NUMBERS + """
SELECT l_orderkey, l_partkey, l_suppkey, t, TRY_CAST(t AS DOUBLE) AS value FROM t""")
def _(v):
    return _numbers(v).select("*", X.float_or_null("t").alias("value"))


@query("flag01", _SQL_NUMBERS + f"""
SELECT l_orderkey, l_partkey, l_suppkey, t, coalesce({_WHOLE} <> 0, false) AS value FROM t""")
def _(v):
    return _numbers(v).select("*", X.flag01("t").alias("value"))


_SQL_TIMES = """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate + to_seconds(o_custkey), '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN '' END AS t FROM orders)
"""


@query("parse_time", _SQL_TIMES + """
SELECT o_orderkey, t, strftime(try_strptime(t, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d']), '%Y-%m-%d %H:%M:%S') AS value FROM t""")
def _(v):
    key, date = F.col("o_orderkey") % 5, F.col("o_orderdate")
    day = F.substring(date.cast("string"), 1, 10)
    text = (
        F.when(key == 0, (date + F.make_dt_interval(secs=F.col("o_custkey").cast("decimal(18,6)"))).cast("string"))
        .when(key == 1, day).when(key == 2, F.replace(day, F.lit("-"), F.lit("/"))).when(key == 3, "")
    )
    t = v.table("orders").select("o_orderkey", text.alias("t"))
    return t.select("*", X.parse_time("t").cast("string").alias("value"))


@query("strip_controls", r"""
SELECT doc_id, md5(regexp_replace(text || chr(7) || chr(9) || chr(127) || chr(133) || 'x', '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')) AS cleaned
FROM documents""")
def _(v):
    dirty = F.concat("text", F.lit("\x07\t\x7f\x85x"))
    return v.table("documents").select("doc_id", F.md5(X.strip_controls(dirty).cast("binary")).alias("cleaned"))


@query("logical_key", "SELECT id, logical_key FROM keyed_v")
def _(v):
    key = X.logical_key("author_name", "title", "published_at", "content_preview")
    return v.posts().select("id", key.alias("logical_key"))


@query("squash_ws", f"SELECT doc_id, md5({SQL_SQUASH('text')}) AS squashed FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(X.squash_ws("text").cast("binary")).alias("squashed"))


def _sql_param(expr: str, name: str) -> str:
    return f"url_decode(nullif(regexp_extract(regexp_extract({expr}, '^[^?#]*\\?([^#]*)', 1), '(?:^|&){name}=([^&]+)', 1), ''))"


@query("url_param", f"SELECT page_id, url, {_sql_param('url', 'page')} AS page, {_sql_param('url', 'ref')} AS ref FROM pages")
def _(v):
    return v.table("pages").select("page_id", "url", X.url_param("url", "page").alias("page"), X.url_param("url", "ref").alias("ref"))


@query("default_url", f"""
SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '{X.DEFAULT_POST_URL}' || id ELSE 'kept-' || id END AS url FROM posts_v""")
def _(v):
    own = F.when(F.col("id").cast("bigint") % 4 == 0, "").otherwise(F.concat(F.lit("kept-"), "id"))
    return v.posts().select("id", X.default_url(own, "id").alias("url"))


@query("map_run_status", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed'
  WHEN event_type IN ('click', 'signup') THEN 'cancelled'
  ELSE CASE event_id % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' WHEN 3 THEN 'cancelled'
       ELSE CAST(event_id % 6 AS VARCHAR) END END AS status FROM events""")
def _(v):
    words = [("done", ["purch"]), ("failed", ["error"]), ("cancelled", ["click", "sign"])]
    status = X.map_run_status((F.col("event_id") % 6).cast("string"), "event_type", words)
    return v.table("events").select("event_id", status.alias("status"))


@query("split_date_range", r"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ~ ' || strftime(o_orderdate + to_days(30), '%Y-%m-%d')
  WHEN 1 THEN 'from ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN ' ' || o_orderstatus || ' - ' || o_orderpriority || ' ' ELSE o_orderstatus END AS t FROM orders),
d AS (SELECT *, regexp_extract_all(t, '\d{4}-\d{2}-\d{2}') AS dates, string_split(t, ' - ') AS parts FROM t)
SELECT o_orderkey, CASE WHEN len(dates) >= 1 THEN dates[1] WHEN len(parts) >= 2 THEN trim(parts[1]) ELSE t END AS start_date,
  CASE WHEN len(dates) >= 2 THEN dates[2] WHEN len(dates) = 1 THEN '' WHEN len(parts) >= 2 THEN trim(parts[-1]) ELSE '' END AS end_date FROM d""")
def _(v):
    key, date = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    text = (
        F.when(key == 0, F.concat(date.cast("string"), F.lit(" ~ "), F.date_add(date, 30).cast("string")))
        .when(key == 1, F.concat(F.lit("from "), date.cast("string")))
        .when(key == 2, F.concat(F.lit(" "), "o_orderstatus", F.lit(" - "), "o_orderpriority", F.lit(" ")))
        .otherwise(F.col("o_orderstatus"))
    )
    r = X.split_date_range(text)
    return v.table("orders").select("o_orderkey", r["start"].alias("start_date"), r["end"].alias("end_date"))


@query("keyword_hits", "SELECT id, positive + 0 AS hits FROM features_v")
def _(v):
    return v.posts().select("id", X.keyword_hits("content", TERMS.positive).alias("hits"))


@query("label_posts", "SELECT post_id, label, score, reason FROM labels_v")
def _(v):
    return label_posts(v.posts(), TERMS)


@query("preview", """
SELECT id, md5(substring(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN content ELSE url END, 1, 500)) AS preview FROM posts_v""")
def _(v):
    own = F.when(F.col("id").cast("bigint") % 2 == 0, "").otherwise(F.col("url"))
    return v.posts().select("id", F.md5(X.preview(own, "content").cast("binary")).alias("preview"))


@query("period_years", "SELECT doc_id, round(CAST(n_chars AS DOUBLE) / 250.0, 2) AS years FROM documents")
def _(v):
    return v.table("documents").select("doc_id", X.period_years("n_chars").alias("years"))


@query("day_spine", """
SELECT o_orderkey, strftime(unnest(generate_series(o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)), INTERVAL 1 DAY)), '%Y-%m-%d') AS day
FROM orders""")
def _(v):
    start = F.to_date("o_orderdate")
    days = X.day_spine(start, F.date_add(start, (F.col("o_orderkey") % 5).cast("int")))
    return v.table("orders").select("o_orderkey", F.explode(days).alias("d")).select("o_orderkey", F.col("d").cast("string").alias("day"))


@query("truncation_flag", "SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS truncated FROM orders")
def _(v):
    text = F.element_at(F.array(*map(F.lit, ["True", "FALSE", "0", "1"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return v.table("orders").select("o_orderkey", X.truncation_flag(text).alias("truncated"))


@query("business_today", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events")
def _(v):
    return v.table("events").select("event_id", X.business_today("ts").cast("string").alias("day"))


@query("epoch_ms", "SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shown, epoch_us(ts) // 1000 AS ms FROM events")
def _(v):
    ms = wall_millis("ts")
    return v.table("events").select(
        "event_id", F.substring(X.curve_time(ms).cast("string"), 1, 19).alias("shown"),
        F.unix_millis(X.epoch_ms(ms)).alias("ms"),
    )


@query("to_ratio", """
SELECT event_id, CASE WHEN event_type = 'view' THEN value / 100.0 ELSE value END AS ratio FROM events""")
def _(v):
    unit = F.when(F.col("event_type") == "view", "percent").otherwise("ratio")
    return v.table("events").select("event_id", X.to_ratio("value", unit).alias("ratio"))


@query("is_blank", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a IS NULL AS a_blank, b IS NULL AS b_blank, c IS NULL OR c = '' AS c_blank FROM versions_v""")
def _(v):
    df = v.versions()
    flags = [X.is_blank(c, df.schema[c].dataType).alias(f"{c}_blank") for c in "abc"]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *flags)


@query("normalize_tags", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END || ':' || source || '|:' AS tags FROM documents""")
def _(v):
    named = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("lang").alias("tagKey"), F.col("source").alias("name"))))
    named = named.otherwise(F.to_json(F.struct(F.col("n_chars").alias("tagId"), F.col("source").alias("name"))))
    text = F.concat(F.lit("[7,"), named, F.lit(',"x",{}]'))
    tags = X.normalize_tags(X.vget(F.try_parse_json(text), "", "array<variant>"))
    joined = F.array_join(F.transform(tags, lambda t: F.concat(t["id"], F.lit(":"), t["name"])), "|")
    return v.table("documents").select("doc_id", joined.alias("tags"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", X.content_hash("text").alias("hash"))


@query("redact", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(line), 'authorization|cookie|token|password') THEN '<redacted>' ELSE line END AS line FROM l""")
def _(v):
    lines = v.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", X.redact("line").alias("line"))

"""Archive maintenance: normalising, merging, upserting, importing."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from postmart.functions import scalars as X
from postmart.functions.labels import label_posts
from postmart.operators import aggregates as A, filters, joins as J, merge as M, normalize as N, sets as U, sorting as S, windows as W
from workload.registry import query
from workload.views import TERMS, Views


def _archive(v: Views):
    """Posts in the nested archive shape; every fifth row lacks a time of detail, every fourth an address."""
    i = F.col("id").cast("bigint")
    stats = F.struct(
        F.col("trading_days").cast("double").alias("trading_days"),
        F.col("annual_return").alias("annual_algo_return"),
        F.col("sharpe").alias("sharpe"),
        F.col("max_drawdown").alias("max_drawdown"),
    )
    rows = v.posts().select(
        "id", "title", F.when(i % 4 != 0, F.col("url")).otherwise("").alias("url"),
        F.when(i % 2 == 0, F.col("content")).otherwise("").alias("content"),
        F.when(i % 2 != 0, F.col("content_preview")).otherwise("").alias("content_preview"),
        F.struct(F.lit("").alias("id"), F.col("author_name").alias("name")).alias("author"),
        "published_at", F.lit("").alias("updated_at"), "view_count", "like_count", "reply_count",
        F.struct(F.col("backtest_id").alias("id"), F.col("backtest_name").alias("name"), "clone_count", stats.alias("stats")).alias("backtest"),
        F.when(i % 5 != 0, F.concat(F.lit("d"), "id")).alias("detail_fetched_at"),
    )
    return N.conform(rows)


@query("normalize_archive_post", f"""
SELECT id, title, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '{X.DEFAULT_POST_URL}' || id ELSE url END AS url, published_at,
 CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN '' ELSE 'd' || id END AS updated_at, author_name,
 CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN md5(content) ELSE md5('') END AS content, md5(content_preview) AS content_preview,
 view_count, like_count, reply_count, backtest_id, backtest_name, trading_days, period_years,
 nullif(annual_return, 0) AS annual_return, sharpe, max_drawdown, clone_count, is_original_candidate, 'archive' AS source, '' AS raw_json,
 '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS refreshed_at FROM posts_v""")
def _(v):
    rows = N.normalize_archive_post(_archive(v), v.candidates(), "2024-01-01 00:00:00")
    return rows.select(*[F.md5(F.col(c).cast("binary")).alias(c) if c in ("content", "content_preview") else c for c in rows.columns])


@query("canonicalize_existing", f"""
SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '{X.DEFAULT_POST_URL}' || id ELSE url END AS url,
 backtest_id, backtest_name, clone_count, sharpe,
 CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN 'd' || id WHEN CAST(id AS BIGINT) % 2 = 0 AND content <> '' THEN '' END AS detail_fetched_at FROM posts_v""")
def _(v):
    return N.canonicalize_existing(_archive(v)).select(
        "id", "url", F.col("backtest.id").alias("backtest_id"), F.col("backtest.name").alias("backtest_name"),
        F.col("backtest.clone_count").alias("clone_count"), F.col("backtest.stats.sharpe").alias("sharpe"), "detail_fetched_at",
    )


@query("compact_post", """
SELECT id, title, url, published_at, '' AS updated_at, '' AS last_active_at, '' AS last_reply_at, md5(content_preview) AS content_preview,
 coalesce(nullif(reply_count, 5), 0) AS reply_count, view_count, like_count, 0 AS collection_count, false AS is_top, false AS is_best,
 backtest_id, clone_count, '' AS pic_url, author_name, lang_tag FROM (SELECT *, author_name || '-tag' AS lang_tag FROM posts_v) p""")
def _(v):
    feed = v.posts().select(
        "id", "title", "url", "published_at", "content_preview", F.nullif("reply_count", F.lit(5)).alias("reply_count"),
        "view_count", "like_count", F.struct(F.lit("").alias("id"), F.col("author_name").alias("name")).alias("author"),
        F.struct(F.col("backtest_id").alias("id"), "clone_count").alias("backtest"),
        F.array(F.struct(F.lit("").alias("id"), F.concat("author_name", F.lit("-tag")).alias("name"))).alias("tags"),
    )
    out = N.compact_post(feed)
    plain = [c for c in out.columns if c not in ("content_preview", "backtest", "author", "tags")]
    return out.select(
        *plain, F.md5(F.col("content_preview").cast("binary")).alias("content_preview"),
        F.col("backtest.id").alias("backtest_id"), F.col("backtest.clone_count").alias("clone_count"),
        F.col("backtest.pic_url").alias("pic_url"), F.col("author.name").alias("author_name"), F.col("tags")[0]["name"].alias("lang_tag"),
    )


@query("canonical_from_detail", """
SELECT CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN id ELSE 'req' || id END AS id, id AS internal_post_id, title, md5(content) AS content, true AS stamped FROM posts_v""")
def _(v):
    asked = F.when(F.col("id").cast("bigint") % 3 == 0, "").otherwise(F.concat(F.lit("req"), "id"))
    detail = v.posts().select("id", asked.alias("requested_id"), "title", F.md5(F.col("content").cast("binary")).alias("content"))
    return N.canonical_from_detail(detail).select(
        "id", "internal_post_id", "title", "content", F.col("detail_fetched_at").isNotNull().alias("stamped")
    )


@query("pick_stats", """
SELECT id, sharpe, max_drawdown, CAST(1 + (sharpe IS NOT NULL)::INT AS INTEGER) AS kept FROM posts_v""")
def _(v):
    entries = {"sharpe": "sharpe", "max_drawdown": "max_drawdown", "noise": "annual_return", "Sharpe": "annual_return"}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in entries.items()])
    present = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    picked = N.pick_stats(v.posts().select("id", present.alias("stats")))
    return picked.select(
        "id", F.try_element_at("stats", F.lit("sharpe")).alias("sharpe"),
        F.try_element_at("stats", F.lit("max_drawdown")).alias("max_drawdown"), F.size("stats").alias("kept"),
    )


@query("merge_versions", """
SELECT l_orderkey, arg_max(a, ord) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, ord) FILTER (WHERE b IS NOT NULL) AS b,
 coalesce(arg_max(c, ord) FILTER (WHERE c <> ''), max(c)) AS c, arg_max(a, ord) FILTER (WHERE a IS NOT NULL) AS n_a,
 arg_max(b, ord) FILTER (WHERE b IS NOT NULL) AS n_b, nullif(arg_max(coalesce(a, '-'), ord) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL), '-') AS s_a,
 arg_max(coalesce(b, -1), ord) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL) AS s_b
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS ord FROM versions_v) t GROUP BY l_orderkey""")
def _(v):
    """Flat fields, a struct merged per field, and statistics replaced whole."""
    rows = v.versions().withColumn("author", F.struct("a", "b")).withColumn(
        "stats", F.struct("a", F.col("b").alias("b"))
    )
    merged = M.merge_versions(rows, "l_orderkey", Views.VERSION_ORDER)
    # A whole statistics record may have a NULL inside; -1 keeps "absent" apart from "not chosen".
    return merged.select(
        "l_orderkey", "a", "b", "c", F.col("author.a").alias("n_a"), F.col("author.b").alias("n_b"),
        F.col("stats.a").alias("s_a"), F.when(F.col("stats").isNotNull(), F.coalesce("stats.b", F.lit(-1.0))).alias("s_b"),
    )


@query("union_seeds", """
WITH s AS (SELECT 0 AS source_rank, l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, a, NULL AS c FROM versions_v
 UNION ALL SELECT 1, l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, a, c FROM versions_v WHERE l_linenumber <= 3)
SELECT l_orderkey, arg_max(a, ord) FILTER (WHERE a IS NOT NULL) AS a, coalesce(arg_max(c, ord) FILTER (WHERE c <> ''), max(c)) AS c
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY source_rank, l_shipdate, l_linenumber, l_partkey, l_suppkey) AS ord FROM s) t
GROUP BY l_orderkey""")
def _(v):
    """Source order outranks age: the second seed file wins although its lines are not newer."""
    rows = v.versions()
    first, second = rows.drop("b", "c"), rows.where(F.col("l_linenumber") <= 3).drop("b")
    seeds = U.union_seeds([first, second, first])
    return M.merge_versions(seeds, "l_orderkey", ["source_rank", *Views.VERSION_ORDER])


@query("merge_into", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS name,
 CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 5000 THEN 0.0 ELSE c_acctbal END AS balance FROM customer
UNION ALL SELECT 'new' || s_suppkey, s_name, s_acctbal FROM supplier""")
def _(v):
    """Blank text in the newer row leaves the old one; zero overwrites."""
    c, s = v.table("customer"), v.table("supplier")
    key = F.col("c_custkey").cast("string").alias("id")
    archive = c.select(key, F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    changed = c.where(F.col("c_custkey") % 3 == 0).select(
        key, F.concat("c_name", F.lit("!")).alias("name"), F.when(F.col("c_acctbal") > 5000, 0.0).alias("balance")
    )
    blank = c.where(F.col("c_custkey") % 3 == 1).select(key, F.lit("").alias("name"), F.lit(None).cast("double").alias("balance"))
    fresh = s.select(F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return M.merge_into(archive, changed.unionByName(blank).unionByName(fresh))


_SQL_UPSERT = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN upper(c_mktsegment) ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 4 < 2 THEN -1.0 ELSE c_acctbal END AS balance, 'old' AS created_at FROM customer
UNION ALL SELECT -1 - s_suppkey, 'S', s_acctbal, 'new' FROM supplier"""


def upsert_sides(v):
    c, s = v.table("customer"), v.table("supplier")
    key = F.col("c_custkey")
    target = c.select(key.alias("id"), F.lower("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.lit("old").alias("created_at"))
    target = target.withColumn("segment", F.upper("segment"))
    incoming = c.where(key % 4 < 2).select(
        key.alias("id"), F.when(key % 4 == 1, F.upper("c_mktsegment")).alias("segment"), F.lit(-1.0).alias("balance"), F.lit("new").alias("created_at")
    ).unionByName(s.select((-1 - F.col("s_suppkey")).alias("id"), F.lit("S").alias("segment"), F.col("s_acctbal").alias("balance"), F.lit("new").alias("created_at")))
    return target, incoming


@query("upsert_table", _SQL_UPSERT)
def _(v):
    target, incoming = upsert_sides(v)
    return M.upsert_rows(target, incoming, "id")


@query("enrich_stats", """
SELECT id, CASE WHEN backtest_id = '' THEN NULL WHEN CAST(id AS BIGINT) % 4 = 1 THEN view_count END AS stats,
 CASE WHEN backtest_id = '' THEN NULL WHEN CAST(id AS BIGINT) % 4 = 1 THEN NULL WHEN CAST(id AS BIGINT) % 4 = 2 THEN 'boom' ELSE 'no stats payload' END AS stats_error FROM posts_v""")
def _(v):
    posts = v.posts()
    i = F.col("id").cast("bigint")
    stats = posts.where((F.col("backtest_id") != "") & (i % 4).isin(1, 2)).select(
        "backtest_id", F.when(i % 4 == 1, F.col("view_count")).alias("stats"), F.when(i % 4 == 2, "boom").alias("stats_error")
    )
    base = posts.select("id", "backtest_id", F.lit(None).cast("bigint").alias("stats"), F.lit(None).cast("string").alias("stats_error"))
    return J.enrich_stats(base, stats).select("id", "stats", "stats_error")


@query("resume_anti", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(v):
    done = v.table("lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast("string").alias("id"))
    rows = v.table("orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    return J.resume_anti(rows, done).select("o_orderkey")


@query("latest_published_at", "SELECT max(published_at) AS latest FROM posts_v")
def _(v):
    return A.latest_published_at(v.posts())


@query("high_watermark", """
WITH cut AS (
  SELECT coalesce(max(published_at), '2024-01-02 00:00:00') AS t FROM feed_v
  JOIN (SELECT feed, max(pos) AS n FROM feed_v GROUP BY feed) USING (feed) WHERE pos * 20 > n
)
SELECT feed, id, published_at FROM feed_v, cut WHERE published_at >= t""")
def _(v):
    """The newest archived time overrides any cut the caller asked for.  The oldest 95 % of each feed are archived."""
    from postmart.streaming.ingest import high_watermark

    feed = v.feed().withColumn("is_top", F.lit(False))
    ends = feed.groupBy("feed").agg(F.max("pos").alias("n"))
    archive = feed.join(ends, "feed").where(F.col("pos") * 20 > F.col("n"))
    cut = high_watermark(archive, until="2024-01-02")
    return filters.take_until(feed, "feed", "pos", until=cut).select("feed", "id", "published_at")


@query("select_missing", """
SELECT id, 'detail' AS what FROM posts_v WHERE CAST(id AS BIGINT) % 5 = 0 UNION ALL
SELECT id, 'stats' FROM posts_v WHERE backtest_id <> '' AND sharpe IS NULL""")
def _(v):
    archive = _archive(v).select(
        "id", "detail_fetched_at", F.col("backtest.id").alias("backtest_id"), F.col("backtest.stats.sharpe").isNotNull().alias("has_stats")
    )
    parts = [filters.select_missing(archive, w).select("id", F.lit(w).alias("what")) for w in ("detail", "stats")]
    return parts[0].unionByName(parts[1])


@query("newest_missing", """
SELECT id, published_at FROM posts_v WHERE CAST(id AS BIGINT) % 5 = 0 ORDER BY published_at DESC, id LIMIT 25""")
def _(v):
    archive = _archive(v).select("id", "detail_fetched_at", "published_at")
    return S.newest_missing(filters.select_missing(archive, "detail"), 25).select("id", "published_at")


@query("count_changed", """
SELECT count(*) FILTER (WHERE c_custkey % 3 = 0 OR c_custkey % 10 = 1) AS changed FROM customer""")
def _(v):
    c = v.table("customer")
    key = F.col("c_custkey")
    before = c.where(key % 10 != 1).select(key.alias("id"), "c_name", "c_acctbal")
    after = c.select(key.alias("id"), F.when(key % 3 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")).alias("c_name"), "c_acctbal")
    return M.count_changed(before, after)



_SQL_IMPORT = """
WITH batch AS (SELECT *, CAST(id AS BIGINT) AS line_no FROM keyed_v),
existing AS (SELECT id, logical_key FROM keyed_v WHERE CAST(id AS BIGINT) % 10 = 3),
open_rows AS (SELECT b.*, min(line_no) OVER (PARTITION BY logical_key) AS first_line FROM batch b
  WHERE id NOT IN (SELECT id FROM existing) AND logical_key NOT IN (SELECT logical_key FROM existing))
"""


def _batch(v):
    keyed = N.build_post_index(v.posts()).select("id", "logical_key", F.col("id").cast("bigint").alias("line_no"))
    return keyed, keyed.where(F.col("line_no") % 10 == 3).select("id", "logical_key")


@query("skip_existing_import", _SQL_IMPORT + "SELECT id, logical_key FROM open_rows WHERE line_no = first_line")
def _(v):
    rows, existing = _batch(v)
    return W.skip_existing_import(rows, existing).select("id", "logical_key")


@query("import_summary", _SQL_IMPORT + """
SELECT (SELECT count(*) FROM batch) AS seen, (SELECT count(*) FROM open_rows WHERE line_no = first_line) AS imported,
 (SELECT count(*) FROM batch) - (SELECT count(*) FROM open_rows WHERE line_no = first_line) AS skipped,
 (SELECT count(*) FROM candidates_v) AS candidate_ids, (SELECT count(*) FROM labels_v) AS labels,
 (SELECT count(*) FROM index_v WHERE is_hidden_duplicate = 1) AS hidden_duplicates""")
def _(v):
    rows, existing = _batch(v)
    posts = v.posts()
    hidden = W.mark_duplicates(N.build_post_index(posts))
    return A.import_summary(W.mark_import(rows, existing), v.candidates(), label_posts(posts, TERMS), hidden)


@query("distinct_ids", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events")
def _(v):
    return U.distinct_ids(v.table("events"), "user_id")


@query("ids_except", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'")
def _(v):
    after = v.table("customer").select(F.col("c_custkey").alias("id"))
    before = v.table("orders").where(F.col("o_orderstatus") == "P")
    return U.ids_except(after, before.select(F.col("o_custkey").alias("id")))


@query("page_overlap", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(v):
    o = v.table("orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return U.page_overlap(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "P"))

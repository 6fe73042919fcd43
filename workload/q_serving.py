"""The post listing, its filters, joins, sorts and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmart.functions.labels import CANDIDATE_LABEL, label_posts
from postmart.operators import aggregates as A, filters, joins as J, sorting as S, windows as W
from postmart.operators.normalize import build_post_index
from postmart.plans.serve import list_posts, refresh_labels, reindex
from postmart.session import cut_lineage
from workload.registry import query
from workload.views import TERMS

_PAGE_COLUMNS = """p.id, p.title, p.url, p.published_at, p.updated_at, p.author_name, md5(p.content_preview) AS content_preview, p.view_count,
 p.like_count, p.reply_count, p.backtest_id, p.backtest_name, p.trading_days, p.period_years, p.annual_return, p.sharpe,
 p.max_drawdown, p.clone_count, p.is_original_candidate, p.is_hidden_duplicate, p.duplicate_of"""


def _sql_listing(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"""
WITH lt AS (SELECT p.*, coalesce(t.labels_text, '') AS labels_text FROM index_v p LEFT JOIN labels_text_v t ON t.post_id = p.id),
page AS (SELECT * FROM lt p WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}),
last_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY id DESC) AS rn FROM runs_v) r WHERE rn = 1)
SELECT {_PAGE_COLUMNS}, a.status AS download_status, a.cloned_strategy_id, r.id AS last_backtest_run_id,
 r.status AS last_backtest_status, r.start_date AS last_backtest_start, r.end_date AS last_backtest_end,
 r.annual_return AS last_backtest_annual_return, r.sharpe AS last_backtest_sharpe,
 coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM labels_v l WHERE l.post_id = p.id), '') AS labels,
 (SELECT count(*) FROM lt p WHERE {where}) AS total
FROM page p LEFT JOIN archives_v a ON a.post_id = p.id LEFT JOIN last_run r ON r.post_id = p.id"""


def _listing(v, **params):
    """The page with labels as text and the total on every row, so that one result shows both."""
    posts = v.posts()
    # For the listing, index and labels are stored tables; here they are derived from the documents and
    # the index is stored first.
    index = cut_lineage(reindex(posts, TERMS))
    names = F.explode(F.split(F.trim(F.col("labels_text"), F.lit("|")), r"\|"))
    labels = index.where(F.col("labels_text") != "").select(F.col("id").alias("post_id"), names.alias("label"))
    listing = list_posts(index, v.archives(), v.runs(), labels, **params)
    page = listing.page.withColumn("labels", F.array_join("labels", "|"))
    page = page.withColumn("content_preview", F.md5(F.col("content_preview").cast("binary")))
    return page.withColumn("total", listing.total.scalar())


@query("list_posts", _sql_listing("p.is_hidden_duplicate = 0", "published_at DESC, id DESC", 50))
def _(v):
    return _listing(v)


@query("list_posts_filtered", _sql_listing(
    "p.is_hidden_duplicate = 0 AND p.period_years >= 1 AND p.sharpe >= 1.5 AND p.sharpe <= 6 AND contains(p.labels_text, '|夏普偏高|') "
    "AND p.published_at >= '2023-01-05' AND p.published_at <= '2024-06-01'", "sharpe DESC NULLS LAST, id DESC", 20, 20))
def _(v):
    return _listing(v, min_period_years="1", min_sharpe="1.5", max_sharpe="6", label="夏普偏高", sort="sharpe_desc",
                    published_from="2023-01-05", published_to="2024-06-01", page=2, page_size=20)


@query("list_posts_search", _sql_listing(
    "(p.title ILIKE '%the%' OR p.content_preview ILIKE '%the%') AND NOT EXISTS (SELECT 1 FROM runs_v r WHERE r.post_id = p.id) "
    "AND NOT EXISTS (SELECT 1 FROM archives_v a WHERE a.post_id = p.id AND a.status = 'downloaded')",
    "published_at ASC NULLS FIRST, id ASC", 200))
def _(v):
    return _listing(v, q=" the ", include_duplicates="1", backtested="0", downloaded="0", sort="published_asc", page_size=500)


_INDEX_OUT = """id, title, url, published_at, updated_at, author_name, md5(content_preview) AS content_preview, view_count, like_count,
 reply_count, backtest_id, backtest_name, trading_days, period_years, annual_return, sharpe, max_drawdown, clone_count,
 is_original_candidate, is_hidden_duplicate, duplicate_of, logical_key"""


def _short(df):
    return df.withColumn("content_preview", F.md5(F.col("content_preview").cast("binary")))


@query("reindex", f"""
SELECT {_INDEX_OUT}, coalesce(t.labels_text, '') AS labels_text FROM index_v p LEFT JOIN labels_text_v t ON t.post_id = p.id""")
def _(v):
    return _short(reindex(v.posts(), TERMS))


@query("build_post_index", f"""
SELECT id, title, url, published_at, updated_at, author_name, md5(content_preview) AS content_preview, view_count, like_count,
 reply_count, backtest_id, backtest_name, trading_days, period_years, annual_return, sharpe, max_drawdown, clone_count,
 is_original_candidate, 0 AS is_hidden_duplicate, CAST(NULL AS VARCHAR) AS duplicate_of, logical_key,
 CASE WHEN is_original_candidate = 1 THEN '|{CANDIDATE_LABEL}|' ELSE '' END AS labels_text FROM keyed_v""")
def _(v):
    return _short(build_post_index(v.posts()))


@query("mark_duplicates", "SELECT id, logical_key, is_hidden_duplicate, duplicate_of FROM index_v")
def _(v):
    return W.mark_duplicates(build_post_index(v.posts())).select("id", "logical_key", "is_hidden_duplicate", "duplicate_of")


@query("duplicate_keys", "SELECT logical_key, count(*) AS n FROM keyed_v WHERE logical_key <> '' GROUP BY logical_key HAVING count(*) > 1")
def _(v):
    return A.duplicate_keys(build_post_index(v.posts()))


@query("hide_duplicates", "SELECT id FROM index_v WHERE is_hidden_duplicate = 0")
def _(v):
    return filters.hide_duplicates(W.mark_duplicates(build_post_index(v.posts()))).select("id")


@query("filter_popular", "SELECT id, clone_count, like_count FROM posts_v WHERE coalesce(clone_count, 0) > 100 AND coalesce(like_count, 0) > 50")
def _(v):
    return filters.filter_popular(v.posts()).select("id", "clone_count", "like_count")


@query("search_posts", "SELECT id FROM posts_v WHERE title ILIKE '%e_t%' OR content_preview ILIKE '%e_t%'")
def _(v):
    return filters.search_posts(v.posts(), "e_t").select("id")


@query("filter_ranges", """
SELECT id, published_at, period_years, sharpe FROM posts_v WHERE published_at >= '2023-01-10' AND published_at <= '2024-01-02'
AND period_years >= 0.5 AND sharpe >= 1 AND sharpe <= 6.5""")
def _(v):
    kept = filters.filter_ranges(v.posts(), "2023-01-10", "2024-01-02", "0.5", "1", "6.5")
    return kept.select("id", "published_at", "period_years", "sharpe")


@query("filter_downloaded", """
SELECT id, EXISTS (SELECT 1 FROM archives_v a WHERE a.post_id = p.id AND a.status = 'downloaded') AS downloaded FROM posts_v p""")
def _(v):
    ids = v.posts().select("id")
    sides = [filters.filter_downloaded(ids, v.archives(), flag).withColumn("downloaded", F.lit(flag == "1")) for flag in "10"]
    return sides[0].unionByName(sides[1])


@query("filter_backtested", "SELECT id, EXISTS (SELECT 1 FROM runs_v r WHERE r.post_id = p.id) AS backtested FROM posts_v p")
def _(v):
    ids = v.posts().select("id")
    sides = [filters.filter_backtested(ids, v.runs(), flag).withColumn("backtested", F.lit(flag == "1")) for flag in "10"]
    return sides[0].unionByName(sides[1])


@query("filter_label", f"""
SELECT id, '{CANDIDATE_LABEL}' AS label FROM posts_v WHERE is_original_candidate = 1
UNION ALL SELECT post_id, '疑似过拟合' FROM labels_v WHERE label = '疑似过拟合'""")
def _(v):
    index = reindex(v.posts(), TERMS)
    labelled = [filters.filter_label(index, l).select("id", F.lit(l).alias("label")) for l in (CANDIDATE_LABEL, "疑似过拟合")]
    return labelled[0].unionByName(labelled[1])


@query("filter_status", "SELECT id, post_id, status FROM runs_v WHERE status = 'error'")
def _(v):
    return filters.filter_status(v.runs(), "error").select("id", "post_id", "status")


@query("join_archives", """
SELECT p.id, a.status AS download_status, a.cloned_strategy_id FROM posts_v p LEFT JOIN archives_v a ON a.post_id = p.id""")
def _(v):
    return J.join_archives(v.posts().select("id"), v.archives())


@query("join_latest_run", """
SELECT p.id, r.id AS last_backtest_run_id, r.status AS last_backtest_status, r.start_date AS last_backtest_start,
 r.end_date AS last_backtest_end, r.annual_return AS last_backtest_annual_return, r.sharpe AS last_backtest_sharpe
FROM posts_v p LEFT JOIN runs_v r ON r.post_id = p.id AND r.id = (SELECT max(x.id) FROM runs_v x WHERE x.post_id = p.id)""")
def _(v):
    return J.join_latest_run(v.posts().select("id"), v.runs())


@query("latest_per_group", """
SELECT id, post_id, status FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY id DESC) AS rn FROM runs_v) r WHERE rn = 1""")
def _(v):
    return W.latest_per_group(v.runs().select("id", "post_id", "status"), "post_id", "id")


@query("flag_candidates", "SELECT id, is_original_candidate FROM posts_v")
def _(v):
    return J.flag_candidates(v.posts().select("id"), v.candidates())


@query("attach_labels", """
SELECT p.id, coalesce(string_agg(l.label, '|' ORDER BY l.label), '') AS labels FROM posts_v p LEFT JOIN labels_v l ON l.post_id = p.id GROUP BY p.id""")
def _(v):
    posts = v.posts()
    joined = J.attach_labels(posts.select("id"), label_posts(posts, TERMS))
    return joined.select("id", F.array_join("labels", "|").alias("labels"))


@query("labels_text", "SELECT post_id, labels_text FROM labels_text_v")
def _(v):
    return A.labels_text(label_posts(v.posts(), TERMS))


@query("refresh_labels", f"""
SELECT id, coalesce(t.labels_text, CASE WHEN is_original_candidate = 1 THEN '|{CANDIDATE_LABEL}|' ELSE '' END) AS labels_text
FROM posts_v p LEFT JOIN labels_text_v t ON t.post_id = p.id""")
def _(v):
    posts = v.posts()
    return refresh_labels(build_post_index(posts), label_posts(posts, TERMS)).select("id", "labels_text")


@query("post_detail", """
SELECT p.id, md5(p.content) AS content, a.status AS archive_status,
 coalesce((SELECT string_agg(l.label || '=' || l.reason, '|' ORDER BY l.label) FROM labels_v l WHERE l.post_id = p.id), '') AS labels
FROM posts_v p LEFT JOIN archives_v a ON a.post_id = p.id""")
def _(v):
    posts = v.posts()
    detail = J.post_detail(posts, label_posts(posts, TERMS), v.archives(), v.runs()).posts
    labels = F.array_join(F.transform("labels", lambda x: F.concat(x["label"], F.lit("="), x["reason"])), "|")
    return detail.select(
        "id", F.md5(F.col("content").cast("binary")).alias("content"), F.col("archive.status").alias("archive_status"),
        F.coalesce(labels, F.lit("")).alias("labels"),
    )


@query("post_detail_runs", "SELECT r.* FROM runs_v r JOIN posts_v p ON p.id = r.post_id WHERE p.sharpe IS NOT NULL")
def _(v):
    posts = v.posts().where(F.col("sharpe").isNotNull())
    return J.post_detail(posts, label_posts(posts, TERMS), v.archives(), v.runs()).runs


@query("count_matching", "SELECT count(*) AS total FROM posts_v WHERE sharpe >= 2 AND published_at >= '2023-01-10'")
def _(v):
    return A.count_matching(filters.filter_ranges(v.posts(), published_from="2023-01-10", min_sharpe="2"))


@query("index_parity", """
SELECT (SELECT count(*) FROM posts_v) AS posts, (SELECT count(*) FROM posts_v WHERE sharpe IS NOT NULL) AS indexed,
 (SELECT count(*) FROM posts_v WHERE sharpe IS NULL) > 0 AS rebuild""")
def _(v):
    posts = v.posts()
    return A.index_parity(posts, build_post_index(posts).where(F.col("sharpe").isNotNull()))


def _in_place(df):
    """Adds the place of each row in the order the frame comes in."""
    from postmart.operators.ranking import global_rank
    from postmart.session import cut_lineage

    stored = cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
    return global_rank(stored, [("__at", False)], "place").drop("__at")


@query("sort_posts", """
SELECT id, published_at, sharpe, annual_return, period_years, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, id DESC) AS place FROM posts_v""")
def _(v):
    return _in_place(S.sort_posts(v.posts(), "sharpe_desc").select("id", "published_at", "sharpe", "annual_return", "period_years"))


@query("page_posts", """
SELECT id, published_at FROM posts_v ORDER BY published_at DESC, id DESC LIMIT 20 OFFSET 40""")
def _(v):
    return S.page_posts(v.posts(), 3, 20).select("id", "published_at")


@query("sort_popular", """
SELECT id, clone_count, like_count, published_at, row_number() OVER (ORDER BY clone_count DESC, like_count DESC, published_at, id) AS place
FROM posts_v WHERE clone_count > 100 AND like_count > 50""")
def _(v):
    return _in_place(S.sort_popular(filters.filter_popular(v.posts())).select("id", "clone_count", "like_count", "published_at"))


@query("rank_output", """
SELECT id, clone_count, like_count, published_at,
 row_number() OVER (ORDER BY clone_count DESC, like_count DESC, published_at, id) AS rank
FROM posts_v WHERE clone_count > 100 AND like_count > 50""")
def _(v):
    return W.rank_output(filters.filter_popular(v.posts())).select("id", "clone_count", "like_count", "published_at", "rank")


@query("list_items", """
SELECT c_custkey, name, updated_at FROM (SELECT c_custkey, c_mktsegment || c_name AS name, c_mktsegment AS updated_at FROM customer) c
ORDER BY updated_at DESC, c_custkey LIMIT 50""")
def _(v):
    items = v.table("customer").select(
        "c_custkey", F.concat("c_mktsegment", "c_name").alias("name"), F.col("c_mktsegment").alias("updated_at")
    )
    return S.list_items(items, "updated", 50, position="c_custkey")

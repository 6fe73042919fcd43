"""Feed pages, replies, increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmart.functions import scalars as X
from postmart.operators import aggregates as A, filters, normalize as N, windows as W
from postmart.sources import payloads as S
from workload.registry import query
from workload.views import FEED_PAGE

_CUT = "2024-01-20"


def _raw_post():
    """A raw feed row as the site sends it: numbers and flags as text, loose extra shapes."""
    i = F.col("event_id")
    user = F.when(i % 7 != 0, F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("userId"), F.col("event_type").alias("alias")))
    return F.struct(
        F.col("id").alias("postId"), F.concat(F.lit("t "), "id").alias("title"), F.col("published_at").alias("addTime"),
        F.when(F.col("is_top"), "1").otherwise("0").alias("isTop"), (i % 50).cast("string").alias("viewCount"),
        F.when(i % 3 == 0, "x").otherwise((i % 9).cast("string")).alias("likeCount"),
        F.concat(F.lit("b"), "id").alias("backtestId"), (i % 5).cast("string").alias("backtestCloneCount"), user.alias("user"),
        F.array(F.struct(F.col("event_type").alias("tagKey"), F.lit("n").alias("name"))).alias("tagInfo"),
    )


def _feed_rows(v):
    return v.feed().withColumn("event_type", F.col("feed")).join(v.table("events").select("event_id", "user_id"), "event_id")


def feed_payloads(v):
    """One JSON payload per feed page (at most 50 rows), pages 7, 17, … of each feed rejected."""
    pages = (
        _feed_rows(v).select("feed", "page", "pos", _raw_post().alias("raw"))
        .groupBy("feed", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("rows"), F.count(F.lit(1)).alias("n"))
    )
    data = F.struct(
        F.col("rows.raw").alias("list"), F.concat(F.lit("now "), F.col("page").cast("string")).alias("currTime"),
        (F.col("page") + 1000).cast("string").alias("totalCount"),
    )
    code = F.when(F.col("page") % 10 == 7, "10001").otherwise("00000")
    return pages.select("feed", "page", F.to_json(F.struct(code.alias("code"), F.lit("busy").alias("msg"), data.alias("data"))).alias("payload"))


@query("scan_feed_pages", """
SELECT feed, page, (pos - 1) % 50 AS pos, 't ' || id AS title, page + 1000 AS total_count, 'now ' || page AS curr_time FROM feed_v WHERE page % 10 <> 7""")
def _(v):
    items = S.scan_feed_pages(feed_payloads(v), on_reject="skip")
    return items.select("feed", "page", "pos", X.vget("item", "title").alias("title"), "total_count", "curr_time")


@query("reject_feed_pages", "SELECT DISTINCT feed, page, 'busy' AS reject_reason FROM feed_v WHERE page % 10 = 7")
def _(v):
    bad = S.inspect_pages(feed_payloads(v)).where(F.col("reject_reason").isNotNull())
    return bad.select("feed", "page", "reject_reason")


_SQL_POST = f"""
SELECT f.feed, f.id, 't ' || f.id AS title, '{X.DEFAULT_POST_URL}' || f.id AS url,
 CASE WHEN f.event_id % 7 <> 0 THEN 'u' || e.user_id ELSE '' END AS author_id, CASE WHEN f.event_id % 7 <> 0 THEN f.feed ELSE '' END AS author_name,
 f.published_at, f.is_top, f.event_id % 50 AS view_count, CASE WHEN f.event_id % 3 = 0 THEN 0 ELSE f.event_id % 9 END AS like_count,
 'b' || f.id AS backtest_id, f.event_id % 5 AS clone_count, f.feed || ':n' AS tags
FROM feed_v f JOIN events e ON e.event_id = f.event_id"""


@query("normalize_feed_post", _SQL_POST)
def _(v):
    raw = _feed_rows(v).select("feed", F.try_parse_json(F.to_json(_raw_post())).alias("item"))
    return N.normalize_feed_post(raw).select(
        "feed", "id", "title", "url", F.col("author.id").alias("author_id"), F.col("author.name").alias("author_name"),
        "published_at", "is_top", "view_count", "like_count", F.col("backtest.id").alias("backtest_id"),
        F.col("backtest.clone_count").alias("clone_count"),
        F.array_join(F.transform("tags", lambda t: F.concat(t["id"], F.lit(":"), t["name"])), "|").alias("tags"),
    )


@query("normalize_post_detail", f"""
SELECT 'r' || doc_id AS requested_id, CAST(doc_id AS VARCHAR) AS id, '{X.DEFAULT_POST_URL}r' || doc_id AS url, md5(text) AS content,
 CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id ELSE 'top' || doc_id END AS author_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS author_name,
 n_chars AS view_count, doc_id % 3 <> 0 AS is_rich, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 END AS type, 'B' || doc_id AS backtest_id,
 CASE doc_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '{{"n":' || doc_id || '}}' ELSE '[' || doc_id || ']' END AS bounty FROM documents""")
def _(v):
    i = F.col("doc_id")
    author = F.when(i % 2 == 0, F.struct(F.concat(F.lit("a"), i.cast("string")).alias("userId"), F.col("lang").alias("alias")))
    body = F.to_json(F.struct(
        i.alias("postId"), F.col("text").alias("content"), author.alias("author"), F.concat(F.lit("top"), i.cast("string")).alias("userId"),
        F.col("n_chars").alias("viewCount"), (i % 3).cast("string").alias("isRich"), F.when(i % 4 != 0, i % 4).alias("type"),
        F.concat(F.lit("B"), i.cast("string")).alias("backtestId"), F.lit("BB").alias("bountyMark"),
    ))
    bounty = F.when(i % 3 == 0, '"none"').when(i % 3 == 1, F.format_string('{"n":%d}', i)).otherwise(F.format_string("[%d]", i))
    text = F.replace(body, F.lit('"bountyMark":"BB"'), F.concat(F.lit('"bounty":'), bounty))
    raw = v.table("documents").select(F.concat(F.lit("r"), i.cast("string")).alias("requested_id"), F.try_parse_json(text).alias("data"))
    return N.normalize_post_detail(raw).select(
        "requested_id", "id", "url", F.md5(F.col("content").cast("binary")).alias("content"), F.col("author.id").alias("author_id"),
        F.col("author.name").alias("author_name"), "view_count", "is_rich", "type", F.col("backtest.id").alias("backtest_id"), "bounty",
    )


def reply_payloads(v):
    """Reply pages: one per conversation turn, the turn as the page number, two replies on each."""
    reply = lambda mark: F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(mark)).alias("replyId"),
        F.col("text").alias("content"), F.struct(F.col("role").alias("alias")).alias("user"),
    )
    data = F.struct(
        F.array(reply("a"), reply("b")).alias("replyArr"), F.when(F.col("turn") > 0, (F.col("turn") + 100).cast("string")).alias("totalCount"),
        (F.col("turn") % 2 == 0).alias("isFaq"), F.lit(False).alias("canChooseBest"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("currTime"), F.when(F.col("turn") == 1, reply("won")).alias("bountyReply"),
    )
    return v.table("conversations").select(
        F.col("conv_id").alias("post_id"), F.col("turn").alias("page"),
        F.to_json(F.struct(F.lit("00000").alias("code"), data.alias("data"))).alias("payload"),
    )


@query("scan_reply_pages", """
SELECT conv_id AS post_id, turn AS page, u.pos AS pos, conv_id || '-' || turn || '-' || u.mark AS reply_id, md5(text) AS content
FROM conversations, (VALUES (0, 'a'), (1, 'b')) u(pos, mark)""")
def _(v):
    rows = S.scan_reply_pages(reply_payloads(v))
    return rows.select("post_id", "page", "pos", X.vget("reply", "replyId").alias("reply_id"),
                       F.md5(X.vget("reply", "content").cast("binary")).alias("content"))


@query("scan_bounty_replies", "SELECT conv_id AS post_id, turn AS page, conv_id || '-' || turn || '-won' AS reply_id FROM conversations WHERE turn = 1")
def _(v):
    rows = S.scan_bounty_replies(reply_payloads(v))
    return rows.select("post_id", "page", X.vget("reply", "replyId").alias("reply_id"))


@query("reply_summary", """
SELECT conv_id AS post_id, count(*) AS pages_read, 2 * count(*) AS n_replies, min(turn) FILTER (WHERE turn > 0) + 100 AS total_count,
 false AS can_choose_best, max(turn) % 2 = 0 AS is_faq, 't' || max(turn) AS curr_time FROM conversations GROUP BY conv_id""")
def _(v):
    return S.reply_summary(reply_payloads(v))


@query("flatten_reply_tree", """
WITH r AS (SELECT conv_id, turn, conv_id || '-' || turn AS rid, role, text, string_split(text, chr(10)) AS lines FROM conversations),
l AS (SELECT conv_id, turn, rid, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM r),
s AS (SELECT conv_id, turn, rid || '.' || i AS lid, string_split(line, '. ') AS parts, i FROM l),
p AS (SELECT conv_id, turn, lid, unnest(parts) AS part, unnest(range(len(parts))) AS j FROM s)
SELECT conv_id AS post_id, rid AS reply_id, '' AS parent_reply_id, 0 AS depth, md5(text) AS content, role AS author_name, turn AS remaining_count FROM r
UNION ALL SELECT conv_id, rid || '.' || i, rid, 1, md5(line), '', 0 FROM l
UNION ALL SELECT conv_id, lid || '.' || j, lid, 2, md5(part), '', 0 FROM p""")
def _(v):
    """Every turn is a reply; its lines are sub-replies (object form) and their sentences (bare list) the
    level below."""
    rid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    dot = lambda a, b: F.concat(a, F.lit("."), b.cast("string"))
    sentences = lambda lid, line: F.transform(
        F.split(line, r"\. "), lambda part, j: F.struct(dot(lid, j).alias("replyId"), part.alias("content")))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        dot(F.col("rid"), i).alias("replyId"), line.alias("content"), sentences(dot(F.col("rid"), i), line).alias("subReply")))
    reply = F.struct(
        F.col("rid").alias("replyId"), F.col("text").alias("content"), F.struct(F.col("role").alias("alias")).alias("user"),
        F.struct(lines.alias("list"), F.col("turn").cast("string").alias("leaveCount")).alias("subReply"),
    )
    raw = v.table("conversations").withColumn("rid", rid).select(
        F.col("conv_id").alias("post_id"), F.try_parse_json(F.to_json(reply)).alias("reply"))
    return N.flatten_reply_tree(raw).select(
        "post_id", "reply_id", "parent_reply_id", "depth", F.md5(F.col("content").cast("binary")).alias("content"), "author_name", "remaining_count")


_SQL_STOP = f"""
WITH marked AS (SELECT *, published_at < '{_CUT} 00:00:00' AS is_old, CASE WHEN published_at < '{_CUT} 00:00:00' AND NOT is_top THEN 'until' END AS stop_kind FROM feed_v),
stop AS (SELECT feed, min(pos) AS stop_pos, min(page) AS stop_page FROM marked WHERE stop_kind IS NOT NULL GROUP BY feed),
kept AS (SELECT m.* FROM marked m LEFT JOIN stop s ON s.feed = m.feed WHERE (s.stop_pos IS NULL OR m.pos < s.stop_pos) AND NOT m.is_old)
"""


@query("take_until", _SQL_STOP + "SELECT feed, id, pos FROM kept")
def _(v):
    return filters.take_until(v.feed(), "feed", "pos", until=_CUT).select("feed", "id", "pos")


@query("late_rows", _SQL_STOP + """
SELECT feed, id, pos, CASE WHEN is_top THEN 'ignored' ELSE 'end of increment' END AS fate FROM marked WHERE is_old""")
def _(v):
    from postmart.streaming.ingest import late_rows

    return late_rows(v.feed(), _CUT).select("feed", "id", "pos", "fate")


@query("page_progress", _SQL_STOP + """
SELECT p.feed, p.page, count(k.id) AS page_items, sum(count(k.id)) OVER (PARTITION BY p.feed ORDER BY p.page) AS items_seen
FROM (SELECT DISTINCT m.feed, m.page FROM marked m LEFT JOIN stop s ON s.feed = m.feed WHERE s.stop_page IS NULL OR m.page <= s.stop_page) p
LEFT JOIN kept k ON k.feed = p.feed AND k.page = p.page GROUP BY p.feed, p.page""")
def _(v):
    feed = v.feed()
    marked = filters.mark_feed_stop(feed, until=_CUT)
    stops = marked.where(F.col("stop_kind").isNotNull()).groupBy("feed").agg(F.min("page").alias("stop_page"))
    pages = feed.select("feed", "page").distinct().join(stops, "feed", "left").where(
        F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page")))
    return W.page_progress(filters.take_until(feed, "feed", "pos", until=_CUT), pages)


@query("feed_summary", _SQL_STOP + """
SELECT m.feed, count(DISTINCT CASE WHEN s.stop_page IS NULL OR m.page <= s.stop_page THEN m.page END) AS pages_read, 1001 AS total_count,
 'now ' || max(CASE WHEN s.stop_page IS NULL OR m.page <= s.stop_page THEN m.page END) AS curr_time, max(s.stop_pos) IS NOT NULL AS stopped_by_until,
 false AS stopped_by_since_id, (SELECT count(*) FROM kept k WHERE k.feed = m.feed) AS items_seen
FROM marked m LEFT JOIN stop s ON s.feed = m.feed GROUP BY m.feed""")
def _(v):
    feed = v.feed()
    pages = feed.select("feed", "page").distinct().select(
        "feed", "page", (F.col("page") + 1000).alias("total_count"), F.concat(F.lit("now "), F.col("page").cast("string")).alias("curr_time"))
    return A.feed_summary(pages, filters.mark_feed_stop(feed, until=_CUT))


@query("take_since_id", """
SELECT f.feed, f.id FROM feed_v f LEFT JOIN (SELECT feed, min(pos) AS stop_pos FROM feed_v WHERE id = '1234' GROUP BY feed) s ON s.feed = f.feed
WHERE s.stop_pos IS NULL OR f.pos < s.stop_pos""")
def _(v):
    return filters.take_until(v.feed(), "feed", "pos", since_id="1234").select("feed", "id")

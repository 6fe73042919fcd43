"""Counts, summaries and integrity verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postmart.functions.scalars import is_blank, parse_time, url_param
from postmart.operators.ranking import split_running_sum
from postmart.operators.skew import join_facts


def count_matching(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def duplicate_keys(df: DataFrame, key: str = "logical_key") -> DataFrame:
    """Non-blank keys that more than one row carries, with their row count."""
    counts = df.where(~is_blank(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1)


def latest_published_at(df: DataFrame) -> DataFrame:
    """One row: the newest parseable time as text, '' when there is none."""
    newest = F.max(parse_time("published_at"))
    return df.agg(F.coalesce(F.substring(newest.cast("string"), 1, 19), F.lit("")).alias("latest"))


def import_summary(marked: DataFrame, candidates: DataFrame, labels: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row of counters: ``marked`` are the incoming rows with an ``outcome`` of 'imported' or
    'skipped' (rows without id have neither)."""
    counts = marked.agg(
        F.count_if(F.col("outcome").isNotNull()).alias("seen"),
        F.count_if(F.col("outcome") == "imported").alias("imported"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar()
    return counts.select(
        "*",
        one(candidates.distinct(), "n").alias("candidate_ids"),
        one(labels, "n").alias("labels"),
        one(hidden.where(F.col("is_hidden_duplicate").cast("boolean")), "n").alias("hidden_duplicates"),
    )


def labels_text(labels: DataFrame) -> DataFrame:
    """(post_id, labels_text): sorted distinct labels between pipes, for substring filters."""
    names = F.array_sort(F.collect_set("label"))
    return labels.groupBy("post_id").agg(F.concat(F.lit("|"), F.array_join(names, "|"), F.lit("|")).alias("labels_text"))


def day_summary(records: DataFrame, keys=("sim_id", "kind", "requested_date")) -> DataFrame:
    """Per requested day: the distinct record dates found (sorted, at most one per calendar day), the
    row count and whether the day came back untruncated.  Days without rows still have one input row
    with NULL ``record_time``."""
    date = F.when(~is_blank("record_time"), F.substring("record_time", 1, 10))
    return records.groupBy(*keys).agg(
        F.array_sort(F.collect_set(date)).alias("record_dates"),
        F.count("item_no").alias("n_items"),
        F.bool_and(~F.col("is_limit")).alias("complete"),
    )


def records_complete(days: DataFrame, keys=("sim_id", "kind")) -> DataFrame:
    return days.groupBy(*keys).agg(F.bool_and("complete").alias("complete"), F.count(F.lit(1)).alias("n_days"))


def page_integrity(pages: DataFrame, items: DataFrame, listing: str = "listing") -> DataFrame:
    """Verdict on a paged listing: 'ok', or the first thing that is wrong with it.

    ``pages``: (listing, page, total), every page requested, also empty ones.
    ``items``: (listing, page, id).  Ids must be present and unique within and across pages, every page
    must state a total, no page may be empty while rows are outstanding, and the rows collected must
    reach the total."""
    sizes = items.groupBy(listing, "page").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_blank("id")).alias("no_id")
    )
    per_page = pages.join(sizes, [listing, "page"], "left").fillna(0, ["n", "no_id"])
    running = split_running_sum(per_page, [listing], "page", "n", "collected")
    paging = running.groupBy(listing).agg(
        F.sum("n").alias("n_items"),
        F.count(F.lit(1)).alias("n_pages"),
        F.max_by("total", "page").alias("total"),
        F.sum("no_id").alias("no_id"),
        F.count_if(F.col("total").isNull()).alias("no_total"),
        F.count_if((F.col("n") == 0) & (F.col("collected") < F.col("total"))).alias("early_empty"),
        F.bool_or(F.col("collected") >= F.col("total")).alias("reached"),
    )
    repeated = (
        items.where(~is_blank("id")).groupBy(listing, "id").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).groupBy(listing).agg(F.count(F.lit(1)).alias("repeated_ids"))
    )
    verdict = (
        F.when(F.col("no_id") > 0, "row without id")
        .when(F.col("no_total") > 0, "page without total")
        .when(F.col("repeated_ids") > 0, "repeated id")
        .when(F.col("early_empty") > 0, "empty page before the total")
        .when(~F.col("reached"), "total not reached")
        .otherwise("ok")
    )
    joined = paging.join(repeated, listing, "left").fillna(0, ["repeated_ids"])
    return joined.select(listing, "n_pages", "n_items", "total", "repeated_ids", verdict.alias("verdict"))


def feed_summary(pages: DataFrame, marked: DataFrame, feed: str = "feed") -> DataFrame:
    """Closing numbers of one feed reading.

    ``pages``: (feed, page, total_count, curr_time) as landed.  ``marked``: rows with ``page``, ``pos``,
    ``is_old`` and ``stop_kind`` (see ``mark_feed_stop``).  A reading ends on the page of the first stop, or at
    the first page without rows, whichever comes first: the empty page still states total and time but does
    not count as read, and what lies behind it was never seen."""
    first_stop = F.when(F.col("stop_kind").isNotNull(), F.struct("page", "pos", "stop_kind"))
    stops = marked.groupBy(feed).agg(F.count(F.lit(1)).alias("n"), F.min(first_stop).alias("stop"))
    with_rows = marked.groupBy(feed, "page").agg(F.count(F.lit(1)).alias("n_rows"))
    sized = pages.join(with_rows, [feed, "page"], "left")
    ends = sized.groupBy(feed).agg(F.count(F.lit(1)).alias("n_pages"), F.min(F.when(F.col("n_rows").isNull(), F.col("page"))).alias("end_page"))
    open_end, met = F.col("end_page").isNull(), F.col("stop.page") < F.col("end_page")
    facts = ends.join(stops, feed, "left").select(feed, "n_pages", "n", "end_page", F.when(open_end | met, F.col("stop")).alias("stop"))
    upto = (F.col("stop").isNull() | (F.col("page") <= F.col("stop.page"))) & (open_end | (F.col("page") <= F.col("end_page")))
    read = join_facts(sized, facts.drop("n"), feed, ["page"], rows="n_pages").where(upto)
    page_side = read.groupBy(feed).agg(
        F.count("n_rows").alias("pages_read"),
        F.min_by("total_count", F.when(F.col("total_count").isNotNull(), F.col("page"))).alias("total_count"),
        F.max_by("curr_time", F.when(F.col("curr_time").isNotNull(), F.col("page"))).alias("curr_time"),
        F.coalesce(F.bool_or(F.col("stop.stop_kind") == "until"), F.lit(False)).alias("stopped_by_until"),
        F.coalesce(F.bool_or(F.col("stop.stop_kind") == "since_id"), F.lit(False)).alias("stopped_by_since_id"),
    )
    before = F.col("stop").isNull() | (F.struct("page", "pos") < F.struct("stop.page", "stop.pos"))
    before &= open_end | (F.col("page") < F.col("end_page"))
    seen = (
        join_facts(marked, facts.drop("n_pages"), feed, ["page", "pos"], rows="n").where(before & ~F.col("is_old"))
        .groupBy(feed).agg(F.count(F.lit(1)).alias("items_seen"))
    )
    return page_side.join(seen, feed, "left").fillna(0, ["items_seen"])


def max_listing_page(df: DataFrame, html: str, path: str | None = None, name: str = "page") -> DataFrame:
    """Add ``max_page``: the largest whole ``page`` parameter among the links (to ``path``), at least 1."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit("href=[\"']([^\"']+)[\"']"), 1)

    def number(link):
        # Entity-encoded separators stand for plain ones inside an attribute.
        link = F.replace(link, F.lit("&amp;"), F.lit("&"))
        value = url_param(link, name).try_cast("bigint")
        if path is None:
            return value
        return F.when(F.regexp_extract(link, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1) == path, value)

    return df.withColumn("max_page", F.greatest(F.lit(1).cast("bigint"), F.array_max(F.transform(hrefs, number))))


def index_parity(posts: DataFrame, index: DataFrame) -> DataFrame:
    """One row: both row counts and whether the index has to be rebuilt."""
    counts = posts.agg(F.count(F.lit(1)).alias("posts")).select(
        "posts", index.agg(F.count(F.lit(1)).alias("n")).scalar().alias("indexed")
    )
    return counts.withColumn("rebuild", (F.col("posts") > 0) & (F.col("posts") != F.col("indexed")))

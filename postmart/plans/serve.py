"""The post listing and the index it reads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from postmart.functions.labels import LabelTerms, labels_as_text, with_labels
from postmart.operators import filters
from postmart.operators.aggregates import count_matching, labels_text
from postmart.operators.joins import attach_labels, join_archives, join_latest_run
from postmart.operators.normalize import build_post_index
from postmart.operators.sorting import clamp_page, page_posts, sort_columns
from postmart.operators.windows import mark_duplicates
from postmart.session import cut_lineage


def reindex(posts: DataFrame, terms: LabelTerms | None = None) -> DataFrame:
    """Typed posts to the serving index: logical key, label text, duplicate marks.

    Labels are computed in the row, so the only shuffle is the one that finds duplicates, and it never
    carries the content."""
    labelled = with_labels(posts, "__labels", terms).withColumn("__labels", labels_as_text(F.col("__labels")))
    return mark_duplicates(build_post_index(labelled, "__labels"))


def refresh_labels(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Rewrite the label text of posts with fired rules; others keep theirs."""
    fresh = labels_text(labels).select(F.col("post_id").alias("id"), F.col("labels_text").alias("__fresh"))
    joined = index.join(fresh, "id", "left")
    return joined.withColumn("labels_text", F.coalesce("__fresh", "labels_text")).select(*index.columns)


class Listing(NamedTuple):
    """One page of posts, and a one-row frame with the number of matching posts."""

    page: DataFrame
    total: DataFrame


def matching_posts(index: DataFrame, archives: DataFrame, runs: DataFrame, params: dict) -> DataFrame:
    """All filters of a listing request, cheapest first."""
    rows = filters.hide_duplicates(index, str(params.get("include_duplicates") or "") == "1")
    rows = filters.filter_ranges(
        rows, *[params.get(p) for p in ("published_from", "published_to", "min_period_years", "min_sharpe", "max_sharpe")]
    )
    rows = filters.filter_label(rows, params.get("label"))
    rows = filters.search_posts(rows, params.get("q"))
    rows = filters.filter_downloaded(rows, archives, params.get("downloaded"))
    return filters.filter_backtested(rows, runs, params.get("backtested"))


def list_posts(index: DataFrame, archives: DataFrame, runs: DataFrame, labels: DataFrame, **params) -> Listing:
    """Filtered, sorted page of posts with download state, newest run and labels.

    Parameters: q, include_duplicates, published_from, published_to, min_period_years, min_sharpe,
    max_sharpe, downloaded, backtested, label, sort, page, page_size.

    The page is cut before anything is joined to it: archive, run and labels are 1:0..1 and cannot change
    which posts are on it.  A page has at most 200 rows; it is materialised once and its ids are broadcast
    to the other tables, which are reduced in place during their scan instead of being shuffled whole."""
    matching = matching_posts(index, archives, runs, params)
    page, size = clamp_page(params.get("page"), params.get("page_size"))
    sort = params.get("sort")
    rows = cut_lineage(page_posts(matching, page, size, sort).drop("labels_text", "logical_key"))
    ids = F.broadcast(rows.select(F.col("id").alias("post_id")))
    on_page = lambda df: df.join(ids, "post_id", "left_semi")
    shown = join_archives(rows, on_page(archives))
    shown = join_latest_run(shown, on_page(runs))
    shown = attach_labels(shown, on_page(labels))
    return Listing(shown.orderBy(*sort_columns(sort)), count_matching(matching))

"""Operators that are windows in a row store.  Where only the winner of a group is needed they are
map-side-combined aggregates here; running totals go through :mod:`postmart.operators.ranking`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postmart.functions.scalars import is_blank
from postmart.operators.ranking import global_rank, split_running_sum
from postmart.operators.skew import join_facts


def mark_duplicates(index: DataFrame, hot_rows: int = 0) -> DataFrame:
    """Hide all but the best post of every logical key.

    Best = has a backtest, most clones, most likes, highest id.  One aggregate finds (best id, count) per
    key, combined on the map side; only keys with more than one post - normally few - are joined back,
    and the rows of a huge group are spread over all tasks (:func:`join_facts`).  No task ever holds or
    sorts a whole group."""
    rank = F.struct(
        (~is_blank("backtest_id")).alias("has_backtest"),
        F.coalesce("clone_count", F.lit(0)).alias("clones"),
        F.coalesce("like_count", F.lit(0)).alias("likes"),
        F.col("id").alias("id"),
    )
    # Blank keys are kept out inside the aggregate: a filter on the key would be pushed below and make
    # a key that is computed in the same plan be computed twice.
    best = (
        index.groupBy("logical_key")
        .agg(F.max(F.when(~is_blank("logical_key"), rank)).alias("best"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("best").isNotNull())
        .select("logical_key", "n", F.col("best.id").alias("__best_id"))
    )
    joined = join_facts(index, best, "logical_key", ["id"], rows="n", hot_rows=hot_rows)
    hidden = F.col("__best_id").isNotNull() & (F.col("__best_id") != F.col("id"))
    return joined.select(
        *[c for c in index.columns if c not in ("is_hidden_duplicate", "duplicate_of")],
        hidden.cast("int").alias("is_hidden_duplicate"),
        F.when(hidden, F.col("__best_id")).alias("duplicate_of"),
    )


def latest_per_group(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("row")).select("row.*")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first occurrence of each key along ``order``."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(first.alias("row")).select("row.*")


def page_progress(rows: DataFrame, pages: DataFrame, feed: str = "feed") -> DataFrame:
    """Per page read: rows emitted on it and rows emitted so far.  ``rows`` are the emitted rows;
    ``pages`` the pages read, since a page may emit nothing."""
    per_page = rows.groupBy(feed, "page").agg(F.count(F.lit(1)).alias("page_items"))
    counted = pages.select(feed, "page").join(per_page, [feed, "page"], "left").fillna(0, ["page_items"])
    return split_running_sum(counted, [feed], "page", "page_items", "items_seen")


def check_offsets(pages: DataFrame, series: str = "series_id", start: int = 0) -> DataFrame:
    """Per page of a paged series: 'ok', or why paging did not move forward.

    ``pages``: (series, page numbered from 1, offset, count).  A page must start where the one before
    it ended; an end page (count 0) may state any offset.  The neighbour is fetched with an equi-join on (series, page), which spreads one huge
    series over all tasks; a window over the series would not."""
    previous = pages.select(
        series, (F.col("page") + 1).alias("page"),
        (F.col("offset") + F.col("count")).alias("expected"), F.col("count").alias("previous_count"),
    )
    joined = pages.join(previous, [series, "page"], "left")
    expected = F.when(F.col("page") == 1, F.lit(start).cast("bigint")).otherwise(F.col("expected"))
    verdict = (
        F.when(F.col("count").isNull() | (F.col("count") < 0), "bad count")
        .when((F.col("page") > 1) & F.col("expected").isNull(), "missing page")
        .when((F.col("page") > 1) & (F.col("previous_count") <= 0), "page after the end")
        .when((F.col("count") > 0) & (F.coalesce("offset", expected) != expected), "offset did not move forward")
        .otherwise("ok")
    )
    return joined.select(series, "page", "offset", "count", expected.alias("expected_offset"), verdict.alias("verdict"))


def open_series(pages: DataFrame, series: str = "series_id") -> DataFrame:
    """Series without an end page: their last page still has points, so more may follow."""
    last = pages.groupBy(series).agg(F.max_by("count", "page").alias("count"))
    return last.where(F.coalesce("count", F.lit(1)) != 0).select(series)


def assemble_log(pages: DataFrame, start: int = 0, run: str = "run_id") -> DataFrame:
    """Lines of each run's log with their absolute offset.

    ``pages``: (run, page, lines array, is_last), unique by (run, page).  Offsets come from a running total
    over page sizes alone; the text is joined to them once, by (run, page), and never in one task."""
    sizes = pages.select(run, "page", _n_lines(), "is_last")
    placed = split_running_sum(_until_stop(sizes, run).select(run, "page", "n_lines"), [run], "page", "n_lines", "upto")
    first = placed.select(run, "page", (F.col("upto") - F.col("n_lines") + F.lit(start)).alias("first"))
    lines = pages.select(run, "page", "lines").join(first, [run, "page"])
    return lines.select(run, "page", "first", F.posexplode("lines").alias("i", "line")).select(
        run, "page", (F.col("first") + F.col("i")).alias("offset"), "line"
    )


def _n_lines():
    return F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).alias("n_lines")


def log_cursor(pages: DataFrame, start: int = 0, run: str = "run_id") -> DataFrame:
    """Per run: pages read, lines read, the offset to continue from and whether the log is complete."""
    return _until_stop(pages.select(run, "page", _n_lines(), "is_last"), run).groupBy(run).agg(
        F.count(F.lit(1)).alias("pages_read"),
        F.sum("n_lines").alias("n_lines"),
        (F.sum("n_lines") + F.lit(start)).alias("next_offset"),
        F.max_by(F.coalesce("is_last", F.lit(False)), "page").alias("is_last"),
    )


def _until_stop(sized: DataFrame, run: str) -> DataFrame:
    """Pages up to the last one read: the first empty page, or the first that says it is the last."""
    stop = (F.col("n_lines") == 0) | F.coalesce("is_last", F.lit(False))
    stops = sized.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min(F.when(stop, F.col("page"))).alias("stop_page")
    )
    tagged = join_facts(sized, stops, run, ["page"], rows="n_pages")
    return tagged.where(F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page"))).drop("stop_page")


def rank_output(df: DataFrame) -> DataFrame:
    """Popular posts with their 1-based place: clones and likes descending, then time, then id."""
    order = [("clone_count", True), ("like_count", True), ("published_at", False), ("id", False)]
    return global_rank(df, order, "rank")


def new_lines(rows: DataFrame, existing: DataFrame, line: str = "line_no") -> DataFrame:
    """(logical_key, line) of the rows of a batch that are new: the first line of each key that is not known,
    among the rows whose id is not known.

    Lines are reduced to one per (id, key) and then to one per key before and after the known ids are taken
    out, both combined on the map side, so a repeated id, a repeated key or blank ids never meet in one task."""
    ids = existing.where(~is_blank("id")).select("id").distinct()
    keys = existing.where(~is_blank("logical_key")).select("logical_key").distinct()
    firsts = rows.where(~is_blank("id")).groupBy("id", "logical_key").agg(F.min(line).alias(line))
    firsts = firsts.join(ids, "id", "left_anti").groupBy("logical_key").agg(F.min(line).alias(line))
    return firsts.join(keys, "logical_key", "left_anti")


def mark_import(rows: DataFrame, existing: DataFrame, line: str = "line_no") -> DataFrame:
    """Add ``outcome``: 'skipped' for known ids, for known logical keys and for keys an earlier line of
    the same batch brought in; 'imported' otherwise; NULL for rows without id.

    Rows skipped by id do not use up their key.  The rows themselves are joined once, by (key, line), which
    spreads a huge key over all tasks."""
    first = new_lines(rows, existing, line).withColumn("__first", F.lit(True))
    outcome = F.when(~is_blank("id"), F.when(F.col("__first"), "imported").otherwise("skipped"))
    return rows.join(first, ["logical_key", line], "left").select(*rows.columns, outcome.alias("outcome"))


def skip_existing_import(rows: DataFrame, existing: DataFrame, line: str = "line_no") -> DataFrame:
    """The rows of a batch that are really new."""
    return rows.where(~is_blank("id")).join(new_lines(rows, existing, line), ["logical_key", line], "left_semi").select(*rows.columns)

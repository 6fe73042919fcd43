"""Row filters of the serving table, the archive and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postmart.functions.labels import CANDIDATE_LABEL
from postmart.functions.scalars import is_blank, parse_time
from postmart.operators.skew import join_facts


def filter_popular(df: DataFrame, min_clone: int = 100, min_like: int = 50) -> DataFrame:
    """Posts strictly above both counters; a missing counter counts as zero."""
    clones, likes = F.coalesce("clone_count", F.lit(0)), F.coalesce("like_count", F.lit(0))
    return df.where((clones > min_clone) & (likes > min_like))


def search_posts(df: DataFrame, q: str | None) -> DataFrame:
    """Case-insensitive substring search in title or preview; ``%`` and ``_`` in q stay wildcards."""
    q = (q or "").strip()
    if not q:
        return df
    # An unpaired escape character is an error in Spark's LIKE, so a backslash is matched literally.
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    return df.where(F.col("title").ilike(pattern) | F.col("content_preview").ilike(pattern))


def hide_duplicates(df: DataFrame, include: bool = False) -> DataFrame:
    return df if include else df.where(~F.col("is_hidden_duplicate").cast("boolean"))


def filter_ranges(
    df: DataFrame,
    published_from: str | None = None,
    published_to: str | None = None,
    min_period_years: float | None = None,
    min_sharpe: float | None = None,
    max_sharpe: float | None = None,
) -> DataFrame:
    """Inclusive bounds; a NULL value never passes.  Times compare as text, as they are stored.
    Text bounds that are empty, and numeric bounds that are '' or None, do not filter."""
    if published_from:
        df = df.where(F.col("published_at") >= published_from)
    if published_to:
        df = df.where(F.col("published_at") <= published_to)
    for column, bound, above in (
        ("period_years", min_period_years, True), ("sharpe", min_sharpe, True), ("sharpe", max_sharpe, False),
    ):
        # A bound of number 0 counts as "not given"; the text "0" is a real bound.
        if bound:
            value = F.lit(float(bound))
            df = df.where(F.col(column) >= value if above else F.col(column) <= value)
    return df


def _membership(df: DataFrame, ids: DataFrame, flag: str | None) -> DataFrame:
    if flag not in ("0", "1"):
        return df
    return df.join(ids, "id", "left_semi" if flag == "1" else "left_anti")


def filter_downloaded(df: DataFrame, archives: DataFrame, flag: str | None) -> DataFrame:
    """'1' keeps posts with a downloaded strategy, '0' the others, anything else keeps all."""
    ids = archives.where(F.col("status") == "downloaded").select(F.col("post_id").alias("id")).distinct()
    return _membership(df, ids, flag)


def filter_backtested(df: DataFrame, runs: DataFrame, flag: str | None) -> DataFrame:
    """'1' keeps posts with any run, '0' posts without.  The run side is reduced to distinct post ids
    before the shuffle, so a post with a huge number of runs is one row per map task."""
    return _membership(df, runs.select(F.col("post_id").alias("id")).distinct(), flag)


def filter_label(df: DataFrame, label: str | None) -> DataFrame:
    """The candidate label tests the flag column; every other label tests the delimited label text."""
    if not label:
        return df
    if label == CANDIDATE_LABEL:
        return df.where(F.col("is_original_candidate").cast("int") == 1)
    return df.where(F.col("labels_text").contains(f"|{label}|"))


def filter_status(df: DataFrame, status: str = "all") -> DataFrame:
    return df if status == "all" else df.where(F.col("status") == status)


def missing_detail() -> Column:
    return ~is_blank("id") & is_blank("detail_fetched_at")


def missing_stats(has_stats: Column) -> Column:
    return ~is_blank("backtest_id") & ~has_stats


def select_missing(df: DataFrame, what: str) -> DataFrame:
    """Rows that still need a 'detail' fetch, or a 'stats' fetch (``has_stats`` boolean column)."""
    if what == "detail":
        return df.where(missing_detail())
    if what == "stats":
        return df.where(missing_stats(F.coalesce("has_stats", F.lit(False))))
    raise ValueError("what must be 'detail' or 'stats'")


CORE_METRICS = ["annual_algo_return", "sharpe"]
ANY_METRICS = ["annual_algo_return", "algorithm_return", "max_drawdown", "sharpe", "trading_days"]


def has_core_metrics(prefix: str = "") -> Column:
    return F.col(f"{prefix}annual_algo_return").isNotNull() & F.col(f"{prefix}sharpe").isNotNull()


def has_any_metrics(prefix: str = "") -> Column:
    return F.coalesce(*[F.col(f"{prefix}{name}").cast("string") for name in ANY_METRICS]).isNotNull()


def metrics_core(df: DataFrame) -> DataFrame:
    return df.where(has_core_metrics())


def metrics_any(df: DataFrame) -> DataFrame:
    return df.where(has_any_metrics())


def parse_until(until: str | None):
    """Check a cut time given as text; returns it as a literal column, or None without a cut."""
    if until is None:
        return None
    from datetime import datetime

    text = until.strip()
    try:
        value = datetime.fromisoformat(text) if len(text) != 10 else datetime.strptime(text, "%Y-%m-%d")
    except ValueError as exc:
        raise ValueError("until must be yyyy-MM-dd or yyyy-MM-dd HH:mm:ss") from exc
    if value.tzinfo is not None:
        raise ValueError("until must not carry a zone")
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def mark_feed_stop(
    df: DataFrame, since_id: str | None = None, until: str | Column | None = None
) -> DataFrame:
    """Add ``is_old`` and ``stop_kind`` ('since_id', 'until' or NULL) to every feed row."""
    cut = parse_until(until) if isinstance(until, str) or until is None else until
    old = F.lit(False) if cut is None else F.coalesce(parse_time("published_at", strip=True) < cut, F.lit(False))
    hit = F.lit(False) if not since_id else F.coalesce(F.col("id") == since_id, F.lit(False))
    kind = F.when(hit, "since_id").when(F.col("is_old") & ~F.col("is_top"), "until")
    return df.withColumn("is_old", old).withColumn("stop_kind", kind)


def take_until(
    df: DataFrame, feed: str, pos: str, since_id: str | None = None, until: str | Column | None = None
) -> DataFrame:
    """Newest-first prefix of each feed.  A feed ends at ``since_id``, or at the first unpinned row older
    than ``until``; older pinned rows are left out without ending it.

    Two passes instead of a window: the stop position is a map-side-combined ``min`` per feed, and the
    row filter joins that one row per feed back, with the rows of big feeds spread over all tasks."""
    marked = mark_feed_stop(df, since_id, until)
    stops = marked.groupBy(feed).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("stop_kind").isNotNull(), F.col(pos))).alias("stop_pos"),
    )
    kept = join_facts(marked, stops, feed, [pos], rows="n").where(
        (F.col("stop_pos").isNull() | (F.col(pos) < F.col("stop_pos"))) & ~F.col("is_old")
    )
    return kept.select(*df.columns)

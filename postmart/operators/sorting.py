"""Total orders, limits and pages.  Every order ends with the id, so results are deterministic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from postmart.operators.ranking import range_bucket

DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 50, 200

_SORTS = {
    "published_asc": ("published_at", False),
    "sharpe_desc": ("sharpe", True),
    "annual_desc": ("annual_return", True),
    "period_desc": ("period_years", True),
}


def sort_columns(sort: str | None) -> list:
    """The id follows the direction of the leading column, so that a descending order is exactly the
    reverse of the ascending one."""
    column, descending = _SORTS.get(sort or "", ("published_at", True))
    if descending:
        return [F.col(column).desc_nulls_last(), F.col("id").desc()]
    return [F.col(column).asc_nulls_first(), F.col("id").asc()]


def sort_posts(df: DataFrame, sort: str | None = "published_desc") -> DataFrame:
    """Known names: published_asc, sharpe_desc, annual_desc, period_desc; all others mean newest first."""
    return df.orderBy(*sort_columns(sort))


def clamp_page(page=None, page_size=None) -> tuple[int, int]:
    return max(1, int(page or 1)), min(MAX_PAGE_SIZE, max(1, int(page_size or DEFAULT_PAGE_SIZE)))


class Cursor(NamedTuple):
    """The last row that was shown: its sort value and its id."""

    value: object
    id: str


def after(cursor: Cursor, sort: str | None) -> Column:
    """Rows behind the cursor in the order of ``sort``."""
    name, descending = _SORTS.get(sort or "", ("published_at", True))
    value, key = F.col(name), F.col("id")
    later = key < cursor.id if descending else key > cursor.id
    if cursor.value is None:
        return (value.isNull() & later) if descending else (value.isNotNull() | later)
    same = (value == F.lit(cursor.value)) & later
    rest = (value < F.lit(cursor.value)) | value.isNull() if descending else value > F.lit(cursor.value)
    return F.coalesce(same | rest, F.lit(False))


def page_after(df: DataFrame, cursor: Cursor | None = None, page_size=DEFAULT_PAGE_SIZE, sort: str | None = "published_desc") -> DataFrame:
    """The page behind a cursor: a filter that reaches the scan, and a top-k of one page, however deep it is."""
    rows = df if cursor is None else df.where(after(cursor, sort))
    return rows.orderBy(*sort_columns(sort)).limit(clamp_page(1, page_size)[1])


class PageIndex:
    """Where the pages of an order begin: rows counted by ranges of the order, once, as many ranges as the session has
    shuffle partitions.  A jump reads the one range that its page begins in."""

    def __init__(self, df: DataFrame, sort: str | None = "published_desc"):
        self.sort, (column, self.descending) = sort, _SORTS.get(sort or "", ("published_at", True))
        self._column = column
        self._ranged = range_bucket(df, F.struct(F.col(column).alias("k"), F.col("id").alias("i")))
        sizes = self._ranged.groupBy("__range").count().collect()
        self.sizes = sorted(((r["__range"], r["count"]) for r in sizes), reverse=self.descending)

    def cursor(self, position: int) -> Cursor | None:
        """Cursor at the row of a 1-based position; behind the end of the order, at its last row."""
        total = sum(n for _, n in self.sizes)
        position, begin = min(position, total), 0
        if position < 1:
            return None
        for number, n in self.sizes:
            if position <= begin + n:
                break
            begin += n
        place = F.row_number().over(Window.partitionBy("__range").orderBy(*sort_columns(self.sort)))
        rows = self._ranged.where(F.col("__range") == number).select("__range", "id", F.col(self._column).alias("v"), place.alias("n"))
        found = rows.where(F.col("n") == position - begin).first()
        return Cursor(found["v"], found["id"])


def page_posts(df: DataFrame, page=1, page_size=DEFAULT_PAGE_SIZE, sort: str | None = "published_desc", index: PageIndex | None = None) -> DataFrame:
    """One page of the total order by number: a jump to the cursor before it, then the page behind the cursor.

    ``index``: kept from an earlier page of the same rows; without one it is made for this page.  Walking from page to
    page needs none, see ``page_after``."""
    page, page_size = clamp_page(page, page_size)
    first = (page - 1) * page_size
    cursor = (index or PageIndex(df, sort)).cursor(first) if first else None
    return page_after(df, cursor, page_size, sort)


def sort_popular(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("clone_count"), F.desc("like_count"), F.asc("published_at"), F.asc("id"))


def newest_missing(missing: DataFrame, n: int | None = None) -> DataFrame:
    """The newest ``n`` rows that still lack something; all of them without ``n``."""
    ordered = missing.orderBy(F.coalesce("published_at", F.lit("")).desc(), F.asc("id"))
    return ordered if n is None else ordered.limit(n)


def list_items(
    df: DataFrame, sort: str = "updated", limit: int = 50, all_items: bool = False, position: str = "pos"
) -> DataFrame:
    """'name' ascending, 'updated' newest first, 'created' in input order (``position``)."""
    order = {
        "name": [F.coalesce("name", F.lit("")).asc(), F.col(position).asc()],
        "updated": [F.coalesce("updated_at", F.lit("")).desc(), F.col(position).asc()],
    }.get(sort, [F.col(position).asc()])
    ordered = df.orderBy(*order)
    return ordered if all_items else ordered.limit(limit)

"""Positions and running totals that never put one whole group into one task.

A plain ``row_number() over (partition by g order by k)`` sends all of group ``g`` to one task.  Here
every group is cut into consecutive order ranges first (``bucket`` grows with the sort order): rows are
counted per (group, bucket) with map-side combining, the bucket counts are accumulated, and the
fine-grained window runs per (group, bucket).  Results equal the plain window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_BUCKET, _BASE = "__bucket", "__base"


def _bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(_BUCKET, bucket)


def _with_base(df: DataFrame, part: list[str], total: Column, descending: bool) -> DataFrame:
    """Attach to each row the accumulated total of all earlier buckets of its group."""
    order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        df.groupBy(*part, _BUCKET)
        .agg(total.alias("__n"))
        .select(*part, _BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_BASE))
    )
    keys = [*part, _BUCKET]
    left, right = df.alias("l"), sums.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, on).select("l.*", f"r.{_BASE}")


def split_row_number(
    df: DataFrame, part: list[str], order: list[Column], bucket: Column, name: str, descending: bool = False
) -> DataFrame:
    """1-based position of each row in its group.  ``bucket`` must be non-null and monotone in ``order``
    (growing, or shrinking when ``descending``)."""
    rows = _with_base(_bucketed(df, bucket), part, F.count(F.lit(1)), descending)
    inside = Window.partitionBy(*part, _BUCKET).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(inside).cast("bigint") + F.col(_BASE)).drop(_BUCKET, _BASE)


def split_running_sum(
    df: DataFrame, part: list[str], order: str, value: str, name: str, width: int = 4096
) -> DataFrame:
    """Inclusive running total of ``value`` along the whole-number column ``order`` (unique per group)."""
    inside = Window.partitionBy(*part, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fine = _bucketed(df, F.floor(F.col(order) / width)).withColumn(name, F.sum(value).over(inside))
    # A bucket's total is its last running total, so both uses of the window need the same columns of ``df``
    # (all, where it has no others) and share one exchange: ``df`` is evaluated once.
    placed = _with_base(fine, part, F.max_by(name, order), False)
    return placed.withColumn(name, F.col(name) + F.col(_BASE)).drop(_BUCKET, _BASE)


def range_bucket(df: DataFrame, key: Column, ranges: int | None = None) -> DataFrame:
    """Add ``__range``: which of about ``ranges`` slices of the ascending order of ``key`` a row is in, by
    default as many as the session has shuffle partitions.

    The cut points come from a hash-chosen sample of bounded size, so they only steer how evenly the
    work spreads; the slice of a row is an exact comparison with the cut points and any choice of cut
    points gives correct positions.  ``key`` should be unique per row so that ties cannot pile up."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (
        df.select(key.alias("k"))
        .orderBy(F.xxhash64("k"))
        .limit(64 * ranges)
        .agg(F.array_sort(F.collect_list("k")).alias("ks"))
        .select(
            F.filter("ks", lambda x, i: i % F.greatest(F.ceil(F.size("ks") / ranges), F.lit(1)) == 0).alias("cuts")
        )
    )
    with_cuts = df.withColumn("__cuts", points.scalar())
    return with_cuts.withColumn("__range", F.size(F.filter("__cuts", lambda x: x <= key))).drop("__cuts")


def global_rank(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """1-based position of every row in a total order, without a single-partition window.

    NULL comes first in ascending and last in descending columns.  ``order`` lists (numeric or string column, descending?).  Numeric columns may be descending; a
    string column must be ascending unless it is the leading one."""
    key_parts = []
    for i, (column, descending) in enumerate(order):
        if descending and dict(df.dtypes)[column] == "string":
            raise ValueError("string sort columns must be ascending")
        if descending:
            key_parts.append(F.col(column).isNull().alias(f"n{i}"))
        value = F.negative(F.coalesce(F.col(column), F.lit(0))) if descending else F.col(column)
        key_parts.append(value.alias(f"k{i}"))
    key = F.struct(*key_parts)
    sorted_by = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    ranged = range_bucket(df, key, ranges)
    return split_row_number(ranged, [], sorted_by, F.col("__range"), name).drop("__range")

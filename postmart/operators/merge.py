"""Folding many partial versions of a record into one row, and upserting into a keyed table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from postmart.functions.scalars import DEFAULT_POST_URL, default_url, is_blank
from postmart.operators.skew import join_facts
from postmart.session import cut_lineage

# A struct by this name is replaced as a whole, and only by one with content; every other struct
# merges field by field.
WHOLE_STRUCTS = ("stats",)
# JSON text that is overwritten only by text with content: an empty list or object is blank here.
JSON_TEXTS = ("bounty",)


def has_content(col: Column, dtype: T.StructType) -> Column:
    """Whether any field of a struct is present."""
    return F.coalesce(reduce(or_, [col[f.name].isNotNull() for f in dtype.fields]), F.lit(False))


def _blank(value: Column, dtype: T.DataType, json_text: bool = False) -> Column:
    if isinstance(dtype, T.StructType):
        return ~has_content(value, dtype)
    if json_text:
        return is_blank(value, dtype) | F.regexp_replace(value, r"\s", "").isin("[]", "{}", "null", '""')
    return is_blank(value, dtype)


def _keeps_blank(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.ArrayType))


def _winner(value: Column, dtype: T.DataType, order: Column, json_text: bool = False) -> Column:
    """The last non-blank value along ``order``; failing that any blank one; NULL if never present."""
    last = F.max_by(value, F.when(~_blank(value, dtype, json_text), order))
    if _keeps_blank(dtype):
        # All remaining values are '' or [], so any of them will do.
        return F.coalesce(last, F.any_value(value, ignoreNulls=True))
    return last


def _alone(value: Column, dtype: T.DataType, name: str = "") -> Column:
    """What the merge makes of a field of a single version: the value, but no struct is missing, save the whole ones,
    which are missing without content, and no map is empty."""
    if isinstance(dtype, T.MapType):
        return F.when(~_blank(value, dtype), value)
    if not isinstance(dtype, T.StructType):
        return value
    if name in WHOLE_STRUCTS:
        return F.when(has_content(value, dtype), value)
    if any(isinstance(f.dataType, (T.StructType, T.MapType)) for f in dtype.fields):
        return F.struct(*[
            (F.when(has_content(value[f.name], f.dataType), value[f.name]) if isinstance(f.dataType, T.StructType) else _alone(value[f.name], f.dataType))
            .alias(f.name) for f in dtype.fields
        ])
    return F.coalesce(value, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dtype.fields]))


def merge_versions(
    df: DataFrame, key: str, order: list[str], base_url: str | None = DEFAULT_POST_URL
) -> DataFrame:
    """One row per key out of many partial versions, in one aggregation.

    Along ``order`` (unique per key) a non-blank value overwrites and a blank one only fills a gap; zero
    and false are values.  Structs merge per field, ``stats`` is replaced whole when it has content.
    Every output leaf is a ``max_by``, so each map task sends one partial row per key, however many
    versions a key has.  NULL stands for an absent field."""
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    fields = [f for f in df.schema.fields if f.name != key and f.name not in order]
    leaves: list[Column] = []
    rebuilt: list[Column] = []
    for f in fields:
        if isinstance(f.dataType, T.StructType) and f.name not in WHOLE_STRUCTS:
            parts = []
            for sub in f.dataType.fields:
                name = f"{f.name}__{sub.name}"
                leaves.append(_winner(F.col(f.name)[sub.name], sub.dataType, by).alias(name))
                parts.append(F.col(name).alias(sub.name))
            rebuilt.append(F.struct(*parts).alias(f.name))
        else:
            leaves.append(_winner(F.col(f.name), f.dataType, by, f.name in JSON_TEXTS).alias(f.name))
            rebuilt.append(F.col(f.name))
    merged = df.groupBy(key).agg(*leaves).select(key, *rebuilt)
    if base_url and "url" in merged.columns:
        merged = merged.withColumn("url", default_url("url", key, base_url))
    return merged


def merge_repeated(
    df: DataFrame, key: str, order: list[str], base_url: str | None = DEFAULT_POST_URL, tie: Column | None = None
) -> DataFrame:
    """``merge_versions`` where most keys have one version.

    Keys are counted first, on the key column alone.  Rows of a key with one version take no part in the aggregation,
    which carries a value and a place per field; they only get the form it would give them.  ``tie`` orders versions
    that ``order`` leaves equal and is computed for repeated keys only."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    repeated = cut_lineage(counts)
    marked = join_facts(df, repeated.withColumn("__many", F.lit(True)), key, order, rows="__n")
    many = F.col("__many").isNotNull() | F.col(key).isNull()
    versions, by = marked.where(many).drop("__many"), order
    if tie is not None:
        versions, by = versions.withColumn("__tie", tie), [*order, "__tie"]
    merged = merge_versions(versions, key, by, base_url)
    single = marked.where(~many).select(key, *[
        _alone(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields if f.name != key and f.name not in order
    ])
    if base_url and "url" in single.columns:
        single = single.withColumn("url", default_url("url", key, base_url))
    return merged.unionByName(single)


def merge_into(archive: DataFrame, incoming: DataFrame, key: str = "id", base_url: str | None = DEFAULT_POST_URL) -> DataFrame:
    """Merge a batch (unique per key) over the archive (unique per key), archive first."""
    both = archive.withColumn("__rank", F.lit(0)).unionByName(
        incoming.withColumn("__rank", F.lit(1)), allowMissingColumns=True
    )
    return merge_versions(both, key, ["__rank"], base_url)


def count_changed(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """How many keys are new or differ in any column.

    Rows travel as a key and a 128-bit hash of the other columns.  Counts changed keys.  A row-by-row import would count every row that altered its key's state; the
    two agree whenever a batch brings each key once."""
    columns = [c for c in after.columns if c != key]
    fingerprint = lambda df: df.select(key, F.unhex(F.md5(F.to_json(F.struct(*sorted(columns))))).alias("row"))
    old = fingerprint(before).withColumnRenamed("row", "old")
    new = fingerprint(after).withColumnRenamed("row", "new")
    changed = new.join(old, key, "left").where(~F.col("new").eqNullSafe(F.col("old")))
    return changed.agg(F.count(F.lit(1)).alias("changed"))


def upsert_rows(target: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Insert or overwrite by key (both sides unique).  An incoming row replaces every column, NULLs
    included, except ``keep``, which stays as first written; other target rows pass through."""
    old = target.select(F.col(key).alias("__key"), F.struct(*target.columns).alias("__old"))
    new = incoming.select(F.col(key).alias("__key"), F.struct(*incoming.columns).alias("__new"))
    both = old.join(new, "__key", "full")
    cells = []
    for name in target.columns:
        if name == key:
            cells.append(F.col("__key").alias(name))
        elif name not in incoming.columns:
            cells.append(F.col(f"__old.{name}").alias(name))
        elif name in keep:
            cells.append(F.coalesce(f"__old.{name}", f"__new.{name}").alias(name))
        else:
            cells.append(
                F.when(F.col("__new").isNotNull(), F.col(f"__new.{name}")).otherwise(F.col(f"__old.{name}")).alias(name)
            )
    return both.select(*cells)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Reduce a batch to the last row of each key before upserting it."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("row")).select("row.*")

"""Mixing sources to target weights: every document's number of copies by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from postmart.llm.common import Scratch, word_count

#: Rows (and bytes of text) that one rounding group holds at most on average; also the fan-in of the tree.
GROUP_ROWS = 4096
GROUP_BYTES = 16 << 20


def source_targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, NULL last, weigh ``weights`` over and over and share the sum of all sizes.
    A target stops at ``most`` times its source's size and the excess is shared again by weight, until none
    is above: with the sources ordered by size per weight, the first k are full, where k is the smallest
    number for which the rest's level reaches no further source's limit."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1)
    base = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open_weight")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    final = F.max("level").over(everything)
    target = F.coalesce(F.least(F.col("limit"), final * F.col("weight")), F.col("limit"))
    return ranked.select("source", "source_size", target.alias("target"))


def _draw(seed: int, *parts) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)), seed=seed) / 2**64


def round_group(sizes: np.ndarray, shares: np.ndarray, names: Sequence, seed: int, last: bool) -> tuple[np.ndarray, int]:
    """(shares after rounding, position of the one that is still fractional or -1).

    Two fractional documents at a time: size is moved from one to the other, up or down at random and with
    the chances that keep every expectation, until one of the two is 0 or 1.  The words taken stay the
    same at each step.  With ``last`` the remaining one goes to the nearer end, so that a source misses its
    target by half a document at most."""
    shares = shares.astype(float).copy()
    held = -1
    for j in range(len(shares)):
        if not 1e-9 < shares[j] < 1 - 1e-9:
            shares[j] = round(shares[j])
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, float(sizes[held]), float(sizes[j])
        up, down = min((1 - shares[i]) * a, shares[j] * b), min(shares[i] * a, (1 - shares[j]) * b)
        move = up if _draw(seed, names[i], names[j]) * (up + down) < down else -down
        shares[i], shares[j] = shares[i] + move / a, shares[j] - move / b
        for k in (i, j):
            if not 1e-9 < shares[k] < 1 - 1e-9:
                shares[k] = round(shares[k])
        held = i if 0 < shares[i] < 1 else j if 0 < shares[j] < 1 else -1
    if last and held >= 0:
        shares[held], held = float(shares[held] >= 0.5), -1
    return shares, held


def _rounded(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: each (source, bucket) is rounded in its own task."""
    schema = T.StructType([*rows.schema, T.StructField("open", T.BooleanType())])

    def settle(group: pa.Table) -> pa.Table:
        size, order, share = (group.column(c).to_numpy() for c in ("size", "order", "share"))
        ids = group.column("id").to_pylist()
        by = np.array(sorted(range(len(ids)), key=lambda i: (-size[i], order[i], ids[i] is None, ids[i])))
        names = [(order[i], ids[i], k) for k, i in enumerate(by)]
        shares, held = round_group(size[by], share[by], names, seed, last)
        share, is_open = np.empty(len(by)), np.zeros(len(by), bool)
        share[by] = shares
        if held >= 0:
            is_open[by[held]] = True
        at = group.schema.get_field_index("share")
        return group.set_column(at, "share", pa.array(share)).append_column("open", pa.array(is_open))

    return rows.groupBy("source", "bucket").applyInArrow(settle, schema)


def mix_copies(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``; the whole
    row as struct ``row`` if asked for.

    A document's expected copies are its source's target over its size, at most ``most``.  The whole part is
    taken as it is; the fractions of a source are rounded together by moving size between pairs
    (``round_group``).  Groups of a few thousand documents each leave at most one fraction open; the open ones
    of ``GROUP_ROWS`` groups meet on the next level, until one group per source is left.  A source of any
    size is cut into groups, so none is a hot key.  Draws depend on ids and the seed only: reruns agree.

    NULL texts and texts without words have size 0 and are taken 0 times unless they are the rule of the
    whole source.  NULL sources form one source, ids may be NULL or repeat (each row is rounded by itself), an
    empty table gives no rows, and columns may have any further names."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    base = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
        *([F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("bytes"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if with_rows else [F.lit(32).cast("bigint").alias("bytes")]),
    )
    if not with_rows:
        base = scratch.store(base, "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("source_bytes"))
    # One row per source, stored: its size is known when the join below is planned.
    facts = scratch.store(sums, "sources")
    buckets = F.greatest(F.ceil(F.col("rows") / GROUP_ROWS), F.ceil(F.col("source_bytes") / GROUP_BYTES)).cast("bigint")
    targets = scratch.store(source_targets(facts, weights, most).join(facts.select(F.col("source").alias("s"), buckets.alias("buckets")), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    most_buckets = targets.agg(F.max("buckets")).first()[0] or 1

    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    order = F.xxhash64(F.lit(seed), "id", "size")
    rows = base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.source", "id", "size", "source_size", "target", order.alias("order"),
        F.floor(expected).cast("bigint").alias("whole"),
        F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(F.lit(0.0)).alias("share"),
        F.pmod(order, "buckets").alias("bucket"),
        *(["row"] if with_rows else []),
    )
    done: list[DataFrame] = []
    level = 0
    while True:
        last = most_buckets <= 1
        rounded = scratch.store(_rounded(rows, seed + level, last), f"level{level}")
        if last:
            done.append(rounded)
            break
        done.append(rounded.where("NOT open"))
        rows = rounded.where("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / GROUP_ROWS))
        most_buckets, level = -(-most_buckets // GROUP_ROWS), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("share").cast("bigint"))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *(["row"] if with_rows else []),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it is taken, with its own columns."""
    taken = mix_copies(docs, with_rows=True, **options).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    )

"""Left join with one-row-per-key facts that stays balanced when a few keys own most of the rows.

The keys with most rows, as many as the session has shuffle partitions, are the only ones that can hold
more than a partition's fair share each.  Such a key is split into salts in proportion to its rows: its
rows are dealt to the salts by hash, its fact is repeated once per salt.  Over all keys that is less than
two salts per shuffle partition, whatever the size of the input, so both the list of keys that is broadcast
and the repetition are bounded by a setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_KEY, _SALT, _SALTS, _FACT = "__key", "__salt", "__salts", "__fact"


def heavy_keys(left: DataFrame, facts: DataFrame, key: str, rows: str | None, usable: Column, hot_rows: int = 0) -> DataFrame:
    """(key, ``__salts``) of the keys that need more than one salt.

    With ``rows`` the counts stand in ``facts``; ties are broken by the whole fact, so that this branch reads
    the same columns as the join does and Spark shares their exchange.  Without it one pass over the key column
    keeps a frequent-items sketch per task; a key that the sketch can miss or miscount has less than an eighth
    of a partition's share."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is None:
        found = left.where(usable).agg(F.call_function("approx_top_k", F.col(key), F.lit(parts), F.lit(16 * parts)).alias("top"))
        found = found.select(F.transform("top", lambda t: F.struct(t["item"].alias("k"), t["count"].alias("n"))).alias("top"))
    else:
        others = [c for c in facts.columns if c not in (key, rows)]
        top = facts.orderBy(F.desc(rows), F.xxhash64(key, *others)).limit(parts)
        found = top.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(rows).cast("bigint").alias("n"))).alias("top"))
    total = F.aggregate("top", F.lit(0).cast("bigint"), lambda sum_, t: sum_ + t["n"])
    each = found.select(total.alias("total"), F.explode("top").alias("t"))
    salts = F.ceil(F.col("t.n") * parts / F.col("total")).cast("int")
    return each.where((F.col("t.n") > hot_rows) & (salts > 1)).select(F.col("t.k").alias(key), salts.alias(_SALTS))


def join_facts(
    left: DataFrame,
    facts: DataFrame,
    key: str,
    spread: list[str],
    rows: str | None = None,
    never: Column | None = None,
    hot_rows: int = 0,
) -> DataFrame:
    """``left`` left-joined with ``facts`` (unique per ``key``); adds the other columns of ``facts``.

    ``spread`` names columns that tell the rows of one key apart.  ``rows`` names the column of ``facts`` with
    the number of left rows per key; without it the keys are counted by a sketch.  ``never`` marks rows that
    match nothing, such as blank keys, which would otherwise meet in one task.  Keys of at most ``hot_rows``
    rows are not split.  Neither counts nor salts have a say in the result."""
    values = [c for c in facts.columns if c not in (key, rows)]
    silent = F.col(key).isNull() if never is None else (F.col(key).isNull() | F.coalesce(never, F.lit(False)))
    facts = facts.where(F.col(key).isNotNull())
    if rows is not None:  # a fact that no row asks for need not travel; this also keeps the count in both branches
        facts = facts.where(F.coalesce(F.col(rows), F.lit(1)) > 0)
    heavy = F.broadcast(heavy_keys(left, facts, key, rows, ~silent, hot_rows))

    at = F.xxhash64(*spread, F.spark_partition_id())
    salted = left.join(heavy, key, "left").select(
        *[F.col(c) for c in left.columns],
        F.when(~silent, F.col(key)).alias(_KEY),
        F.when(silent, at).otherwise(F.pmod(at, F.coalesce(_SALTS, F.lit(1)))).alias(_SALT),
    )
    fact = facts.join(heavy, key, "left").select(
        F.col(key).alias(_KEY),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(_SALTS, F.lit(1)).cast("bigint") - 1)).alias(_SALT),
        F.struct(*values).alias(_FACT),
    )
    joined = salted.join(fact, [_KEY, _SALT], "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.col(f"{_FACT}.{v}").alias(v) for v in values])

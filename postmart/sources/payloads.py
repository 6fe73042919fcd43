"""Landed response payloads (JSON text, one per row) to typed rows.

Payloads are parsed once into VARIANT: their shapes vary by row, and a path lookup on a value of the
wrong shape is simply NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postmart.functions.scalars import flag01, float_or_null, int_json, int_strict, is_blank, is_object, truncation_flag, truthy_json, vget, vkind, vlist, vrecord
from postmart.operators.filters import ANY_METRICS, CORE_METRICS, has_any_metrics, has_core_metrics
from postmart.operators.skew import join_facts
from postmart.session import cut_lineage

OK_CODE = "00000"


def inspect_pages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse the envelope: adds ``data`` (variant, NULL when rejected) and ``reject_reason``."""
    envelope = vrecord(F.try_parse_json(payload), {"code": "string", "msg": "string", "data": "variant"})
    # Out of an array of one: a filter on what follows would otherwise move below and parse every page again.
    rest = [c for c in df.columns if c != payload]
    parsed = df.select(*rest, F.explode(F.array(envelope)).alias("__e"))
    reason = (
        F.when(F.col("__e").isNull(), "response is not an object")
        .when(
            F.coalesce(F.col("__e.code"), F.lit("")) != OK_CODE,
            F.coalesce(F.nullif(F.col("__e.msg"), F.lit("")), F.lit("request failed")),
        )
        .when(~is_object("__e.data"), "response has no data object")
    )
    checked = parsed.withColumn("reject_reason", reason)
    return checked.withColumn("data", F.when(F.col("reject_reason").isNull(), F.col("__e.data"))).drop("__e")


def _accepted(df: DataFrame, payload: str, on_reject: str) -> DataFrame:
    pages = inspect_pages(df, payload)
    if on_reject == "skip":
        return pages.where(F.col("reject_reason").isNull()).drop("reject_reason")
    if on_reject == "raise":
        guard = F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.col("reject_reason")).cast("boolean")).otherwise(True)
        return pages.where(guard).drop("reject_reason")
    raise ValueError("on_reject must be 'skip' or 'raise'")


def scan_feed_pages(df: DataFrame, payload: str = "payload", on_reject: str = "raise", keep_empty: bool = False) -> DataFrame:
    """Feed pages to row objects: (…, total_count, curr_time, pos, item), ``pos`` from 0 per page.
    Entries that are not objects are dropped but keep their place; with ``keep_empty`` they stay as rows without an
    item, and a page without entries is one such row."""
    pages = _accepted(df, payload, on_reject)
    rest = [c for c in pages.columns if c != "data"]
    fields = {"list": "array<variant>", "totalCount": "string", "currTime": "string"}
    listed = F.coalesce("__d.list", F.array().cast("array<variant>"))
    exploded = pages.withColumn("__d", vrecord("data", fields)).select(
        *rest,
        int_json("data", "totalCount", text=F.col("__d.totalCount")).alias("total_count"),
        F.col("__d.currTime").alias("curr_time"),
        (F.posexplode_outer if keep_empty else F.posexplode)(listed).alias("pos", "item"),
    )
    if keep_empty:
        return exploded.withColumn("item", F.when(is_object("item"), F.col("item")))
    return exploded.where(is_object("item"))


def _reply_pages(df: DataFrame, payload: str, on_reject: str) -> DataFrame:
    return _accepted(df, payload, on_reject)


def scan_reply_pages(df: DataFrame, payload: str = "payload", on_reject: str = "raise") -> DataFrame:
    """Reply pages to reply objects: (…, pos, reply)."""
    pages = _reply_pages(df, payload, on_reject)
    rest = [c for c in pages.columns if c != "data"]
    exploded = pages.select(*rest, F.posexplode(vlist("data", "replyArr")).alias("pos", "reply"))
    return exploded.where(vkind("reply") == "OBJECT")


def scan_bounty_replies(df: DataFrame, payload: str = "payload", on_reject: str = "raise") -> DataFrame:
    """The rewarded reply of each page that has one."""
    pages = _reply_pages(df, payload, on_reject)
    rest = [c for c in pages.columns if c != "data"]
    bounty = pages.select(*rest, vget("data", "bountyReply", "variant").alias("reply"))
    return bounty.where(vkind("reply") == "OBJECT")


def reply_summary(df: DataFrame, post: str = "post_id", page: str = "page", payload: str = "payload", on_reject: str = "raise") -> DataFrame:
    """Per post: pages read, the total of the first page that states one, flags and time of the last."""
    pages = _reply_pages(df, payload, on_reject)
    parts = pages.select(
        post, page,
        F.size(vlist("data", "replyArr")).alias("n"),
        int_json("data", "totalCount").alias("total"),
        truthy_json("data", "canChooseBest").alias("best"),
        truthy_json("data", "isFaq").alias("faq"),
        vget("data", "currTime").alias("time"),
    )
    at = F.col(page)
    return parts.groupBy(post).agg(
        F.count(F.lit(1)).alias("pages_read"),
        F.sum("n").alias("n_replies"),
        F.min_by("total", F.when(F.col("total").isNotNull(), at)).alias("total_count"),
        F.max_by("best", at).alias("can_choose_best"),
        F.max_by("faq", at).alias("is_faq"),
        F.coalesce(F.max_by("time", F.when(F.col("time").isNotNull(), at)), F.lit("")).alias("curr_time"),
    )


def stats_metrics(df: DataFrame, payload: str) -> DataFrame:
    """Metric columns of statistics payloads: ``data`` when the key exists, the payload itself otherwise."""
    v = F.try_parse_json(payload)
    parsed = df.withColumn("__v", v)
    parsed = parsed.withColumn("__m", F.coalesce(vget("__v", "data", "variant"), F.col("__v"))).drop(payload, "__v")
    names = list(dict.fromkeys(CORE_METRICS + ANY_METRICS))
    return parsed.select(
        *[c for c in parsed.columns if c != "__m"],
        *[float_or_null(vget("__m", name)).alias(name) for name in names],
    )


def scan_stats_payloads(df: DataFrame, inner_ids: DataFrame, payload: str = "payload") -> DataFrame:
    """Statistics per backtest id.  Where a payload holds no usable metric, the payload of the inner id
    (``inner_ids``: backtest_id, inner_id) is taken instead, but only with its core metrics present.

    ``df``: (backtest_id unique, payload).  Output: backtest_id, resolved_id and the metric columns."""
    # Three uses follow; parsing JSON three times costs more than one write of a few typed columns.
    own = cut_lineage(stats_metrics(df, payload))
    names = [c for c in own.columns if c != "backtest_id"]
    usable = has_any_metrics()
    retry = (
        own.where(~usable).select("backtest_id")
        .join(inner_ids.where(~is_blank("inner_id") & (F.col("inner_id") != F.col("backtest_id"))), "backtest_id")
    )
    inner = own.where(has_core_metrics()).select(F.col("backtest_id").alias("inner_id"), F.struct(*names).alias("m"))
    found = join_facts(retry, inner, "inner_id", ["backtest_id"]).where(F.col("m").isNotNull())
    joined = own.join(found.select("backtest_id", "inner_id", "m"), "backtest_id", "left")
    taken = F.col("m").isNotNull()
    return joined.select(
        "backtest_id",
        F.when(taken, F.col("inner_id")).otherwise(F.col("backtest_id")).alias("resolved_id"),
        *[F.when(taken, F.col(f"m.{n}")).otherwise(F.col(n)).alias(n) for n in names],
    )


DAY_RECORD_KEYS = {"positions": "position", "orders": "transaction"}


def _simulation_data(df: DataFrame, payload: str) -> DataFrame:
    """Envelope of simulation responses: code 00000 or 0 when present, status 0 when present."""
    parsed = df.withColumn("__v", F.try_parse_json(payload))
    code, status = vget("__v", "code"), vget("__v", "status")
    problem = (
        F.when(F.coalesce(vkind("__v"), F.lit("")) != "OBJECT", "response is not an object")
        .when(code.isin("401", "403"), "no access")
        .when(code.isNotNull() & ~code.isin(OK_CODE, "0"), F.coalesce(vget("__v", "msg"), F.lit("request failed")))
        .when(status.isNotNull() & (status != "0"), F.coalesce(vget("__v", "msg"), F.lit("request failed")))
        .when(F.coalesce(vkind(vget("__v", "data", "variant")), F.lit("")) != "OBJECT", "response has no data object")
    )
    data = F.when(problem.isNotNull(), F.raise_error(problem).cast("variant")).otherwise(vget("__v", "data", "variant"))
    return parsed.withColumn("data", data).drop("__v", payload)


def scan_day_records(df: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Day records of simulations, one row per record; a day without records gives one row with NULL
    ``item_no``.  The row list and the truncation flag are mandatory.

    ``df``: (sim_id, requested_date, payload).  Output adds kind, is_limit, item_no, record_time, item."""
    key = DAY_RECORD_KEYS.get(kind)
    if key is None:
        raise ValueError("kind must be 'positions' or 'orders'")
    days = _simulation_data(df, payload)
    rows = vget("data", key, "array<variant>")
    rows = F.when(rows.isNull(), F.raise_error(F.lit(f"day without a {key} list")).cast("array<variant>")).otherwise(rows)
    exploded = days.select(
        "sim_id", "requested_date", F.lit(kind).alias("kind"),
        truncation_flag(vget("data", "isLimit")).alias("is_limit"),
        F.posexplode_outer(rows).alias("item_no", "item"),
    )
    time = F.coalesce(F.nullif(vget("item", "date"), F.lit("")), vget("item", "time"))
    return exploded.select("sim_id", "kind", "requested_date", "is_limit", "item_no", time.alias("record_time"), "item")


def scan_simulation_pages(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Pages of a simulation listing: (pages with their total, rows), for ``page_integrity``.

    ``df``: (listing, page, payload)."""
    data = _simulation_data(df, payload)
    pages = data.select("listing", "page", int_json("data", "totalCount").alias("total"))
    rows = data.select("listing", "page", F.posexplode(vlist("data", "liveArr")).alias("pos", "row"))
    items = rows.select(
        "listing", "page", "pos", F.coalesce(vget("row", "backtestId"), F.lit("")).alias("id"),
        vget("row", "name").alias("name"), vget("row", "status").alias("status"),
    )
    return pages, items


def scan_series_pages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Curve pages to parallel arrays.  All four arrays must be as long as ``count``; state 0 without a
    result is an empty page.

    ``df``: (series_id, page, payload).  Output: series_id, page, state, offset, count, time, value,
    benchmark_time, benchmark_value."""
    data = _simulation_data(df, payload)
    state = vget("data", "state")
    result = vget("data", "result", "variant")
    empty = (F.coalesce(vkind(result), F.lit("VOID")) == "VOID") & (state == "0")
    broken = ~empty & (F.coalesce(vkind(result), F.lit("")) != "OBJECT")
    count = F.when(empty, F.lit(0).cast("bigint")).otherwise(int_json(result, "count"))
    staged = data.select(
        "series_id", "page", state.alias("state"),
        F.when(broken, F.raise_error(F.lit("page without a result")).cast("bigint")).otherwise(count).alias("count"),
        int_json(result, "offset").alias("offset"),
        vget(result, "overallReturn.time", "array<bigint>").alias("time"),
        vget(result, "overallReturn.value", "array<double>").alias("value"),
        vget(result, "benchmark.time", "array<bigint>").alias("benchmark_time"),
        vget(result, "benchmark.value", "array<double>").alias("benchmark_value"),
    )

    def checked(name: str, kind: str) -> Column:
        length = F.coalesce(F.size(name), F.lit(0))
        return (
            F.when(F.col("count").isNull(), F.raise_error(F.lit("page without a count")).cast(kind))
            .when((F.col("count") > 0) & (length != F.col("count")), F.raise_error(F.lit(f"{name} is not as long as count")).cast(kind))
            .otherwise(F.coalesce(name, F.array().cast(kind)))
        )

    kinds = {"time": "array<bigint>", "value": "array<double>", "benchmark_time": "array<bigint>", "benchmark_value": "array<double>"}
    return staged.select(
        "series_id", "page", "state", "offset", "count", *[checked(n, k).alias(n) for n, k in kinds.items()]
    )

"""Final status of strategy runs out of four kinds of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postmart.functions.scalars import RUN_STATE_CODES, nonblank
from postmart.operators.filters import has_core_metrics
from postmart.operators.joins import resolve_run
from postmart.operators.skew import join_facts

TERMINAL = ("done", "failed", "cancelled")


def result_status(state: Column) -> Column:
    """Status word of a numeric result state; '' for anything unknown."""
    codes = F.create_map(*[F.lit(x) for pair in RUN_STATE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.coalesce(state.cast("string"), F.lit(""))), F.lit(""))


def status_ladder(core: Column, listed: Column, listed_core: Column, result: Column, has_errors: Column) -> dict[str, Column]:
    """The precedence of evidence, as columns ``status`` and ``decided_by``.

    ``core``: own statistics are complete; ``listed``: status of the listing row, NULL without a row;
    ``listed_core``: statistics under the listing row's id are complete; ``result``: status of the result
    payload, '' when unknown; ``has_errors``: an error log exists."""
    has_row = listed.isNotNull()
    row_ended = F.coalesce(listed.isin("failed", "cancelled"), F.lit(False))
    row_done = F.coalesce(listed == "done", F.lit(False))
    row_running = F.coalesce(listed == "running", F.lit(False))
    result_ended = result.isin("failed", "cancelled") & ~row_running
    decided = (
        F.when(core, "stats")
        .when(row_done & listed_core, "listing stats")
        .when(row_ended, "listing")
        .when((result == "done") & ~has_row, "result")
        .when(result_ended, "result")
        .when(row_done, "listing without stats")
        .otherwise("none")
    )
    ended = lambda word: F.when((word == "cancelled") & has_errors, "failed").otherwise(word)
    status = (
        F.when(core | (row_done & listed_core), "done")
        .when(row_ended, ended(listed))
        .when((result == "done") & ~has_row, "done")
        .when(result_ended, ended(result))
        .when(row_done, "done")
        .otherwise("running")
    )
    return {"status": status, "decided_by": decided}


def run_evidence(stats: DataFrame, results: DataFrame, error_logs: DataFrame) -> DataFrame:
    """One row per run that any source knows: (run_id, core, result, has_errors), NULL where a source is silent.

    One aggregation over all sources, combined on the map side, with buffers of fixed width: a run with very
    many error lines is one row per task."""
    words = F.array(*[F.lit(w) for w in sorted(set(RUN_STATE_CODES.values()))])
    code = F.array_position(words, result_status(F.col("state")))
    sources = (
        stats.select("run_id", has_core_metrics().alias("core"))
        .unionByName(results.select("run_id", code.alias("code")), allowMissingColumns=True)
        .unionByName(error_logs.select("run_id", F.lit(True).alias("has_errors")), allowMissingColumns=True)
    )
    known = sources.groupBy("run_id").agg(F.max("core").alias("core"), F.max("code").alias("code"), F.max("has_errors").alias("has_errors"))
    word = F.when(F.col("code") > 0, F.get(words, F.col("code").cast("int") - 1))
    return known.select("run_id", "core", word.alias("result"), "has_errors")


def reconcile_status(
    runs: DataFrame, stats: DataFrame, listing: DataFrame, results: DataFrame, error_logs: DataFrame
) -> DataFrame:
    """One row per wanted run: (wanted, resolved_id, status, decided_by, terminal).

    ``runs``: (wanted).  ``stats``: (run_id unique, metric columns).  ``listing``: (pos, id, list_id,
    source_id, status).  ``results``: (run_id unique, state).  ``error_logs``: (run_id, …), any number of
    lines per run; only their existence matters.  Evidence is one row per run and joined twice: by the wanted
    id, which is unique, and by the resolved id, which many wanted ids may share and which is split if so."""
    row = resolve_run(runs, listing.select("pos", "id", "list_id", "source_id", "status")).select(
        "wanted",
        F.col("status").alias("listed"),
        F.coalesce(nonblank("id"), nonblank("source_id"), F.col("wanted")).alias("resolved_id"),
    )
    known = run_evidence(stats, results, error_logs)
    own = known.select(F.col("run_id").alias("wanted"), "core", "result")
    other = known.select(F.col("run_id").alias("resolved_id"), F.col("core").alias("listed_core"), "has_errors")
    joined = join_facts(row.join(own, "wanted", "left"), other, "resolved_id", ["wanted"])
    flag = lambda name: F.coalesce(name, F.lit(False))
    ladder = status_ladder(
        flag("core"), F.col("listed"), flag("listed_core"), F.coalesce("result", F.lit("")), flag("has_errors")
    )
    return joined.select(
        "wanted", "resolved_id", ladder["status"].alias("status"), ladder["decided_by"].alias("decided_by")
    ).withColumn("terminal", F.col("status").isin(*TERMINAL))

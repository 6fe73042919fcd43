"""Complete-or-nothing snapshot of simulations: listing, day records and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postmart.functions.scalars import day_spine, is_blank
from postmart.operators.aggregates import day_summary, page_integrity, records_complete
from postmart.operators.normalize import series_to_points
from postmart.operators.windows import check_offsets, open_series
from postmart.sinks.publish import publish_snapshot


KINDS = ("positions", "orders")


def expected_parts(listing_items: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a snapshot of the listed simulations needs: (sim_id, kind, requested_date) of every calendar day of each
    one's span, for both kinds of records, and (series_id) of each one's curve.

    ``spans``: (sim_id, start, end).  A listed simulation without a span has no days to ask for, but a curve."""
    listed = listing_items.where(~is_blank("id")).select(F.col("id").alias("sim_id")).distinct()
    asked = listed.join(spans.select(F.col("sim_id").cast("string").alias("sim_id"), "start", "end"), "sim_id")
    days = asked.select("sim_id", F.explode(day_spine("start", "end")).alias("day")).select("sim_id", F.col("day").cast("string").alias("requested_date"))
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind")
    return days.select("sim_id", kinds, "requested_date"), listed.select(F.col("sim_id").alias("series_id"))


def sync_snapshot(
    listing: tuple[DataFrame, DataFrame], records: DataFrame, series: DataFrame, spans: DataFrame, root: str, intraday: DataFrame | None = None,
) -> str:
    """Publish a snapshot of all listed simulations, or raise and leave the one that is published.

    Days and curves that have to be there follow from the listing and the spans."""
    days, curves = expected_parts(listing[1], spans)
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    parts = simulation_snapshot(*listing, text(records, "sim_id"), text(series, "series_id"), days, curves, intraday)
    return publish_snapshot(*parts, root)


def simulation_snapshot(
    listing_pages: DataFrame, listing_items: DataFrame, records: DataFrame, series: DataFrame,
    expected_days: DataFrame | None = None, expected_series: DataFrame | None = None, intraday: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The parts of a snapshot, and a frame with one row per reason not to publish it (empty = publish).

    ``records``: output of ``scan_day_records`` for positions and orders together; ``series``: output of
    ``scan_series_pages``.  Empty curves are complete; nothing is filled in or carried forward.

    ``expected_days`` (sim_id, kind, requested_date) and ``expected_series`` (series_id) are what was asked for:
    a day or a curve without any payload is a reason too.  A curve must end with an empty page, except the
    single pages of ``intraday`` (series_id)."""
    days = day_summary(records)
    listing = page_integrity(listing_pages, listing_items)
    offsets = check_offsets(series)
    problems = (
        listing.where(F.col("verdict") != "ok").select(F.concat(F.lit("listing: "), "verdict").alias("problem"))
        .unionByName(
            records_complete(days).where(~F.col("complete")).select(
                F.concat(F.col("kind"), F.lit(" truncated for "), F.col("sim_id").cast("string")).alias("problem")
            )
        )
        .unionByName(
            offsets.where(F.col("verdict") != "ok").select(
                F.concat(F.lit("curve "), F.col("series_id").cast("string"), F.lit(": "), "verdict").alias("problem")
            )
        )
    )
    unfinished = open_series(series)
    if intraday is not None:
        unfinished = unfinished.join(intraday.select("series_id").distinct(), "series_id", "left_anti")
    named = lambda what: F.concat(F.lit("curve "), F.col("series_id").cast("string"), F.lit(what)).alias("problem")
    problems = problems.unionByName(unfinished.select(named(": no end page")))
    if expected_series is not None:
        problems = problems.unionByName(expected_series.join(series, "series_id", "left_anti").select(named(" is missing")))
    if expected_days is not None:
        keys = ["sim_id", "kind", "requested_date"]
        gone = expected_days.select(*keys).distinct().join(days, keys, "left_anti")
        problems = problems.unionByName(
            gone.select(F.concat_ws(" ", "kind", F.lit("missing for"), F.col("sim_id").cast("string"), F.lit("on"), F.col("requested_date").cast("string")).alias("problem"))
        )
    parts = {
        "listing": listing_items,
        "records": records,
        "days": days,
        "points": series_to_points(series.where(F.col("count") > 0), ["series_id", "page"]),
    }
    return parts, problems

"""Progress events of a running ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(posts: DataFrame, name: str = "feed") -> DataFrame:
    """Count posts (and pinned or late ones, where marked) while they flow through a query."""
    there = F.col("is_item") if "is_item" in posts.columns else F.lit(True)
    counts = [F.count_if(there).alias("items")]
    if "page" in posts.columns:
        counts.append(F.max("page").alias("page"))
    if "is_old" in posts.columns:
        counts.append(F.count_if("is_old").alias("late"))
    return posts.observe(name, *counts)


class ProgressEvents(StreamingQueryListener):
    """Turns query progress into ``progress`` and ``done`` events with running totals."""

    def __init__(self, emit: Callable[[dict], None], name: str = "feed"):
        self.emit, self.name = emit, name
        self.items_seen: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.items_seen[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = (progress.observedMetrics or {}).get(self.name)
        if metrics is None:
            return
        row = metrics.asDict() if hasattr(metrics, "asDict") else dict(metrics)
        key = str(progress.id)
        self.items_seen[key] = self.items_seen.get(key, 0) + (row.get("items") or 0)
        self.emit({
            "type": "progress", "batch": progress.batchId, "page": row.get("page"), "page_items": row.get("items") or 0,
            "late": row.get("late") or 0, "items_seen": self.items_seen[key],
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.emit({"type": "done", "items_seen": self.items_seen.get(str(event.id), 0), "failed": event.exception is not None})


def progress_events(spark: SparkSession, emit: Callable[[dict], None], name: str = "feed") -> ProgressEvents:
    """Register a listener; remove it with ``spark.streams.removeListener``."""
    listener = ProgressEvents(emit, name)
    spark.streams.addListener(listener)
    return listener

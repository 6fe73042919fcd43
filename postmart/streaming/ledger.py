"""What a stream remembers between batches: the ids it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmart.sinks.manifest import BUCKETS, append_rows, read_manifest, read_table, touched_buckets


class IdLedger:
    """An append-only table of ids in hash buckets, each with the batch that wrote it.

    A batch reads only the buckets its own ids fall into.  The newest recorded batch is published together with its
    ids, so recording a batch a second time changes nothing."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets

    def _newest(self) -> int:
        manifest = read_manifest(self.spark, self.root)
        return -1 if manifest is None else int(manifest.marks.get("batch", -1))

    def exists(self) -> bool:
        return read_manifest(self.spark, self.root) is not None

    def known(self, rows: DataFrame, batch: int) -> DataFrame | None:
        """Recorded ids in the buckets of ``rows``, without those that an earlier attempt at ``batch`` recorded."""
        manifest = read_manifest(self.spark, self.root)
        if manifest is None:
            return None
        table = read_table(self.spark, self.root, touched_buckets(rows, self.key, manifest.buckets), manifest)
        return table.where(F.col("batch") != batch).select(self.key)

    def unknown(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose id no earlier batch has recorded.  Both sides are dealt by id; equal buckets meet."""
        known = self.known(rows, batch)
        return rows if known is None else rows.join(known, self.key, "left_anti")

    def record(self, ids: DataFrame, batch: int) -> None:
        if batch > self._newest():
            rows = ids.select(self.key, F.lit(batch).cast("bigint").alias("batch"))
            append_rows(rows, self.root, self.key, self.buckets, {"batch": str(batch)})

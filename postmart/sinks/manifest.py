"""Keyed tables in hash buckets whose versions are small manifest files.

::

    root/data/run=<id>/bucket=<k>/…    part files, never changed once written
    root/manifests/<version>.json      which folders make up the table

The bucket of a row follows from its key, so a batch says by itself which buckets it touches: only those are read,
written anew and named by the next manifest.  The next manifest is a file that must not exist yet, put in place by
one rename.  A job that dies before leaves the old version; of two writers that began from one version the
second fails; readers follow the manifest they opened, as folders stay for one more version."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from postmart.operators.merge import upsert_rows

#: Buckets of a new table.  A bucket should stay below a few hundred MB: 64 suit tables up to some 10 GB.
BUCKETS = 64
#: An appended bucket of more folders is written anew as one.
MOST_FOLDERS = 16


class ConcurrentWrite(RuntimeError):
    """Another writer has published the version this one was about to."""


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)
    retired: list[str] = field(default_factory=list)  # read by the version before

    def paths(self, root: str, buckets: list[int] | None = None) -> list[str]:
        chosen = self.folders.keys() if buckets is None else map(str, buckets)
        return [f"{root}/data/{p}" for k in chosen for p in self.folders.get(k, [])]


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    hadoop_path, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def _versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in _listed(spark, f"{root}/manifests") if n.endswith(".json") and n[0] != "."]


def _manifest_at(spark: SparkSession, root: str, version: int) -> Manifest:
    path, fs = _fs(spark, f"{root}/manifests/{version:012d}.json")
    stream = fs.open(path)
    try:
        return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def read_manifest(spark: SparkSession, root: str) -> Manifest | None:
    versions = _versions(spark, root)
    return _manifest_at(spark, root, versions[-1]) if versions else None


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Publish a version, then free what only versions before the last one read."""
    jvm, name = spark._jvm, f"{manifest.version:012d}.json"
    aside, fs = _fs(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{name}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as exc:
        fs.delete(aside, False)
        if fs.exists(target):
            raise ConcurrentWrite(f"{root} already has version {manifest.version}") from exc
        raise
    for version in _versions(spark, root):
        if version < manifest.version:
            for folder in _manifest_at(spark, root, version).retired:
                path, fs = _fs(spark, f"{root}/data/{folder}")
                fs.delete(path, True)
        if version < manifest.version - 1:
            path, fs = _fs(spark, f"{root}/manifests/{version:012d}.json")
            fs.delete(path, False)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def touched_buckets(df: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of a frame's keys: at most ``buckets`` small numbers."""
    return sorted(r[0] for r in df.select(bucket_of(key, buckets).alias("bucket")).distinct().collect())


def read_table(spark: SparkSession, root: str, buckets: list[int] | None = None, manifest: Manifest | None = None) -> DataFrame | None:
    """The table, or some of its buckets; None when nothing was published yet."""
    manifest = manifest or read_manifest(spark, root)
    if manifest is None:
        return None
    schema, paths = T.StructType.fromJson(json.loads(manifest.schema)), manifest.paths(root, buckets)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).select(*schema.names)


def _write(rows: DataFrame, root: str, key: str, buckets: int, expected: list[int], partition: tuple[str, ...]) -> dict[str, str]:
    """Folder of each bucket that was written.  Spark splits large buckets over tasks and joins small ones."""
    run = f"run=r{uuid.uuid4().hex}"
    out = rows.withColumn("__bucket", bucket_of(key, buckets)).withColumnRenamed("__bucket", "bucket")
    out.hint("rebalance", "bucket").write.partitionBy("bucket", *partition).parquet(f"{root}/data/{run}")
    written = [n for n in _listed(rows.sparkSession, f"{root}/data/{run}") if n.startswith("bucket=")]
    found = {n.removeprefix("bucket="): f"{run}/{n}" for n in written}
    if not set(found) <= {str(k) for k in expected}:
        raise RuntimeError("the rows changed between two readings")
    return found


def _base(spark: SparkSession, root: str, df: DataFrame, key: str, buckets: int) -> Manifest:
    old = read_manifest(spark, root)
    if old is None:
        fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
        return Manifest(-1, key, buckets, T.StructType(fields).json())
    if old.key != key:
        raise ValueError(f"{root} is keyed by {old.key}")
    return old


def upsert_table(
    incoming: DataFrame, root: str, key: str, keep: tuple[str, ...] = ("created_at",), buckets: int = BUCKETS, partition: tuple[str, ...] = ()
) -> Manifest:
    """Upsert rows with unique keys: only the buckets of incoming keys are read and written.

    ``partition``: columns that split each bucket's folder further, for readers that filter by them; a row that
    changes its partition stays in its bucket, so nothing has to be searched for or removed."""
    spark = incoming.sparkSession
    old = _base(spark, root, incoming, key, buckets)
    touched = touched_buckets(incoming, key, old.buckets)
    if not touched and old.version >= 0:
        return old
    rows = incoming
    if old.version >= 0:
        current = read_table(spark, root, touched, old)
        cast = [F.col(c).cast(current.schema[c].dataType).alias(c) if c in current.columns else F.col(c) for c in incoming.columns]
        rows = upsert_rows(current, incoming.select(*cast), key, keep)
    written = _write(rows, root, key, old.buckets, touched, partition)
    replaced = [p for k in written for p in old.folders.get(k, [])]
    new = replace(old, version=old.version + 1, folders=old.folders | {k: [p] for k, p in written.items()}, retired=replaced)
    commit(spark, root, new)
    return new


def append_rows(rows: DataFrame, root: str, key: str, buckets: int = BUCKETS, marks: dict[str, str] | None = None) -> Manifest:
    """Append rows; ``marks`` are published with them.  A touched bucket of too many folders becomes one again."""
    spark = rows.sparkSession
    old = _base(spark, root, rows, key, buckets)
    touched = touched_buckets(rows, key, old.buckets)
    full = [k for k in touched if len(old.folders.get(str(k), [])) >= MOST_FOLDERS]
    whole = rows.unionByName(read_table(spark, root, full, old)) if full else rows
    written = _write(whole, root, key, old.buckets, touched, ()) if touched else {}
    folders = old.folders | {k: [p] if int(k) in full else [*old.folders.get(k, []), p] for k, p in written.items()}
    retired = [p for k in full for p in old.folders[str(k)]]
    new = replace(old, version=old.version + 1, folders=folders, marks=old.marks | (marks or {}), retired=retired)
    commit(spark, root, new)
    return new

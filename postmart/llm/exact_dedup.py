"""Exact duplicates by content sort: equal texts become neighbours and neighbours are compared in full."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postmart.llm.common import Scratch, text_or_empty

#: Bytes of the text that splitters hold.  Longer common beginnings are split by hash, equal texts by id.
PREFIX = 48


def _sorted_stream(docs: DataFrame, id_col: str, key: Column, payload: list[str], text_at: int | None) -> DataFrame:
    """Rows in the order of their bytes: sampled splitters deal them out, an external sort orders each range.

    The order is (first bytes, hash, whole text, id from large to small).  A splitter holds the first
    bytes, the hash and the id, never a whole text, so that neither a common beginning nor a large group of
    equal texts has to fit into one range.  ``text_at``: which payload column the text is, to send it once."""
    whole = key if text_at is None else F.coalesce(F.col(f"row.c{text_at}"), F.lit(""))
    columns = [F.col(id_col).cast("bigint").alias("id"), F.substring(F.encode(key, "UTF-8"), 1, PREFIX).alias("head"), F.xxhash64(key).alias("hash")]
    if payload:
        columns.append(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(payload)]).alias("row"))
    if text_at is None:
        columns.append(key.alias("key"))
        whole = F.col("key")
    rows = docs.select(*columns).repartitionByRange("head", "hash", F.desc_nulls_last("id"))
    return rows.sortWithinPartitions("head", "hash", whole, F.desc_nulls_last("id"))


def _nullable(field: T.StructField) -> T.StructField:
    return T.StructField(field.name, T.StructType([T.StructField(f.name, f.dataType, True) for f in field.dataType]), True)


def _members(rows: DataFrame, text_at: int | None) -> DataFrame:
    """Each row with its run of equal neighbours.  ``edge`` marks runs that another range may continue: those
    whose (head, hash) is the first or the last of the range.  Text and row travel on with the first of a run
    only, and the text only where it has to be compared once more."""
    with_rows = "row" in rows.columns
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("run", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("top", T.LongType()), T.StructField("size", T.LongType()), T.StructField("first", T.BooleanType()),
        T.StructField("edge", T.BooleanType()), T.StructField("sha", T.StringType()), T.StructField("key", T.StringType()),
        *([_nullable(rows.schema["row"])] if with_rows else []),
    ])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), -1
        key = place = first_place = None
        ids: list[pa.Array] = []
        row: pa.Array | None = None
        # Runs of the last place seen wait until it is known whether the range ends there.
        waiting: list[tuple] = []

        def emit(held: list[tuple], last) -> Iterator[pa.RecordBatch]:
            for number, at, text, parts, payload in held:
                own = pa.chunked_array(parts, pa.int64()).combine_chunks()
                n, edge = len(own), at == first_place or at == last
                none = pa.nulls(n - 1, pa.string())
                columns = [
                    pa.repeat(pa.scalar(part, pa.int64()), n), pa.repeat(pa.scalar(number, pa.int64()), n), own,
                    pa.repeat(own[0], n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.array([True] + [False] * (n - 1)),
                    pa.repeat(pa.scalar(edge), n), pa.repeat(pa.scalar(hashlib.sha256(text.encode()).hexdigest()), n),
                    pa.concat_arrays([pa.array([text if edge else None], pa.string()), none]),
                ]
                if with_rows:
                    columns.append(pa.concat_arrays([payload, pa.nulls(n - 1, payload.type)]))
                yield columns

        def packed(columns: Iterable[list]) -> Iterator[pa.RecordBatch]:
            names, buffer, held = schema.names, [], 0
            for c in columns:
                buffer.append(c)
                held += len(c[0])
                if held >= 2000:
                    yield _batch(buffer, names)
                    buffer, held = [], 0
            if buffer:
                yield _batch(buffer, names)

        def runs() -> Iterator[list]:
            nonlocal run, key, place, first_place, ids, row, waiting
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                heads, hashes, own = (batch.column(c) for c in ("head", "hash", "id"))
                payload = batch.column("row") if with_rows else None
                texts = batch.column("key") if text_at is None else pc.fill_null(payload.field(text_at), "")
                new = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist() if n > 1 else []
                starts = [0, *(i + 1 for i, x in enumerate(new) if x), n]
                for begin, end in zip(starts, starts[1:], strict=False):
                    text = texts[begin].as_py()
                    if begin == 0 and text == key:
                        ids.append(own.slice(begin, end - begin))
                        continue
                    if key is not None:
                        waiting.append((run, place, key, ids, row))
                    here = (heads[begin].as_py(), hashes[begin].as_py())
                    if first_place is None:
                        first_place = here
                    if here != place and waiting:
                        yield from emit(waiting, None)
                        waiting = []
                    run, key, place, ids = run + 1, text, here, [own.slice(begin, end - begin)]
                    row = payload.slice(begin, 1) if with_rows else None
            if key is not None:
                waiting.append((run, place, key, ids, row))
                yield from emit(waiting, place)

        yield from packed(runs())

    return rows.mapInArrow(find, schema)


def _batch(buffer: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c[i] for c in buffer]) for i in range(len(names))], names)


def _settled(members: DataFrame) -> DataFrame:
    """Members with the figures of the whole group.  Runs at the edge of a range (a few for each range, so the
    broadcast is bounded by the number of ranges) are compared by their whole text and added up."""
    edges = members.where("edge AND first")
    groups = edges.groupBy("key").agg(F.max("top").alias("all_top"), F.sum("size").alias("all_size"), F.min("part").alias("owner"))
    fixes = edges.select("part", "run", "key").join(groups, "key").select("part", "run", "all_top", "all_size", "owner")
    joined = members.join(F.broadcast(fixes), ["part", "run"], "left")
    return joined.select(
        "id",
        F.coalesce("all_top", "top").alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & (F.coalesce("owner", "part") == F.col("part"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if "row" in members.columns else []),
    )


def _key(text_col: str, normalise: Callable[[Column], Column] | None) -> Column:
    text = text_or_empty(text_col)
    return text if normalise is None else F.coalesce(normalise(text), F.lit(""))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their normalised bytes are; without ``normalise`` they are compared as they are and
    NULL counts as empty.  The row with the largest id stays; of rows that repeat the id, exactly one.  A NULL
    id stays only where the group has no other (``keep_id`` is then NULL).  An empty table gives no rows and
    further columns are ignored, whatever their names.  Texts are compared whole, however long."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = _sorted_stream(docs, id_col, _key(text_col, normalise), [], None)
    return _settled(scratch.store(_members(rows, None), "members")).withColumnRenamed("id", id_col)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns unchanged.  See ``exact_groups``.

    Whole rows take part in the one sort, so texts are shuffled once and nothing is joined back; only the
    first row of each run of equals is written."""
    scratch = Scratch(docs.sparkSession, "exact")
    text_at = docs.columns.index(text_col) if normalise is None else None
    rows = _sorted_stream(docs, id_col, _key(text_col, normalise), docs.columns, text_at)
    kept = _settled(scratch.store(_members(rows, text_at), "members")).where("kept")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = """
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS place,
    sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
)
"""

"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from postmart.llm.common import Scratch, text_or_empty
from postmart.llm.tokens import byte_level

#: Share of the sequences that waiting documents need at least which one round opens.  Smaller shares come
#: closer to one-by-one best fit and take more rounds: about 13 for 99.9 % of the best possible here.
OPENED = 0.43
#: Units whose ids a worker remembers.
REMEMBERED = 300_000

_UNSAFE = re.compile(r" \s")
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids, as little-endian unsigned 32-bit numbers: those of the byte-level BPE in ``path``
    (``*.json``), for speed computed from the ranks of its own vocabulary, if it is such that ranks decide
    (``byte_level``).

    A space between two other characters begins a new pre-token, so texts are cut there and the ids of each
    unit are remembered.  Texts with white space after a space, or with a special token's string, go through the
    file's own tokenizer as a whole."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = byte_level(path)[1]
    fast = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole: list[Tokenizer] = []

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    class Known(dict):
        def __missing__(self, unit: str) -> bytes:
            found = packed(fast.encode_ordinary(unit))
            if len(unit) < 64:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[unit] = found
            return found

    known = Known()

    def encode(text: str) -> bytes:
        if not fast or _SPECIAL in text or _UNSAFE.search(text):
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return packed(whole[0].encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        return known[first] + b"".join([known[" " + unit] for unit in rest])

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole if it fits, else full pieces after a first
    one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    starts = list(range(n % capacity, n, capacity))
    return [(0, n % capacity)] * bool(n % capacity) + [(s, capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids if kept): each document's ids and a closing 0, cut to fit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + b"\0\0\0\0"
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema)


def _sweep(events: DataFrame) -> DataFrame:
    """Successor sweep of each range, from large to small: a document takes the gap seen last that nobody has
    taken, which is the smallest it fits into.  What stays unmatched is numbered: documents met before any
    gap, gaps that no document of this range took.  A last row for each range has their numbers."""
    names = ["part", "kind", "id", "size", "seq", "pos"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        stack: list[tuple[int, int]] = []
        for batch in batches:
            out: list[tuple] = []
            for item, owner, size in zip(*(batch.column(c).to_pylist() for c in ("item", "id", "size")), strict=True):
                if not item:
                    stack.append((owner, size))
                elif stack:
                    out.append((part, "placed", owner, size, stack.pop()[0], None))
                else:
                    out.append((part, "document", owner, size, None, seen))
                    seen += 1
            if out:
                yield _rows(out, names)
        left = [(part, "gap", owner, size, None, k) for k, (owner, size) in enumerate(stack)]
        yield _rows([*left, (part, "range", seen, len(stack), None, None)], names)

    order = [F.desc("size"), F.col("item"), F.xxhash64("id", "slot")]
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).select("item", "id", "size")
    return ranged.mapInArrow(run, "part int, kind string, id bigint, size bigint, seq bigint, pos bigint")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _across(swept: DataFrame) -> DataFrame:
    """The ranges' leftover documents (item, length, seq or NULL) after they have met the leftover gaps by rank.

    Read from large to small, a left gap is a step up and a left document a step down.  A document matches
    the latest earlier gap on its own step, so each step is a small group: two rows of a range at most.  The
    ranges' bases are a running sum over one row per range, which is what is broadcast."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = swept.where("kind = 'range'").select("part", F.col("id").alias("docs"), F.coalesce(F.sum(F.col("size") - F.col("id")).over(before), F.lit(0)).alias("base"))
    left = swept.where("kind IN ('document', 'gap')").select("part", (F.col("kind") == "document").alias("item"), "id", "size", "pos")
    level = F.when(F.col("item"), F.col("base") - F.col("pos") - 1).otherwise(F.col("base") - F.col("docs") + F.col("pos"))
    step = Window.partitionBy("level").orderBy("part", F.desc("item"))
    met = left.join(F.broadcast(bases), "part").withColumn("level", level).select(
        "item", "id", "size", F.lag(F.struct("item", "id")).over(step).alias("last")
    )
    return met.where("item").select(F.col("id").alias("item"), F.col("size").alias("length"), F.when(~F.col("last.item"), F.col("last.id")).alias("seq"))


def _opening(left: DataFrame, capacity: int) -> tuple[Column, int | None, int]:
    """Which of the unplaced documents open a sequence, the longest length among the others, and how many
    there are.  Those over half a sequence open one, and otherwise the largest, ``OPENED`` times as
    many as their tokens need at least.  From the number of documents of each length in 16 parts by hash (at
    most 16 times ``capacity`` rows); of a length that is needed in part, as many parts open as are not too
    many, and one document at least."""
    drawn = F.xxhash64("item")
    share = F.pmod(drawn, F.lit(16)).cast("int")
    found = left.groupBy("length", share.alias("share")).agg(F.count(F.lit(1)), F.min(drawn)).collect()
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for length, part, n, least in found:
        parts.setdefault(length, []).append((part, n, least))
    counts = [(length, sum(n for _, n, _ in parts[length])) for length in sorted(parts, reverse=True)]
    if not counts:
        return F.lit(False), None, 0
    total = sum(c for _, c in counts)
    need = max(1, round(OPENED * sum(n * c for n, c in counts) / capacity), sum(c for n, c in counts if 2 * n > capacity))
    for k, (length, n) in enumerate(counts):
        if need == n:
            return F.col("length") >= length, counts[k + 1][0] if k + 1 < len(counts) else None, total
        if need < n:
            chosen: list[int] = []
            for part, size, _ in sorted(parts[length]):
                if size <= need:
                    chosen.append(part)
                    need -= size
            some = share.isin(chosen) if chosen else drawn == min(least for _, _, least in parts[length])
            return (F.col("length") > length) | ((F.col("length") == length) & some), length, total
        need -= n
    return F.lit(True), None, total


def _tasks(rows: int) -> int:
    """Tasks that write a round's tables: one for every 20,000 documents to be packed, as neither the documents nor
    the gaps of a round are more.  Rounds write many tables, which need not be a file for each shuffle
    partition where these hold less."""
    return rows // 20_000 + 2


def assign(items: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(item, length, seq, round) for all ``items`` (item, length <= capacity).

    A round offers every gap to the waiting documents; a gap at least twice the longest of them is offered as
    equal slots, so that one round can fill it with many short ones.  Sweeps match, gaps are updated, and
    the longest unplaced documents open sequences of their own, named after them."""
    placed: list[DataFrame] = []
    gaps = longest = None
    waiting, turn, rows = items, 0, 0
    while turn == 0 or longest is not None:
        used, left = [], waiting
        if gaps is not None:
            n = F.greatest(F.floor(F.col("gap") / longest), F.lit(1)).cast("int")
            slots = gaps.select(
                F.lit(False).alias("item"), F.col("seq").alias("id"), F.floor(F.col("gap") / n).cast("bigint").alias("size"), F.explode(F.sequence(F.lit(1), n)).alias("slot")
            )
            docs = waiting.select(F.lit(True).alias("item"), F.col("item").alias("id"), F.col("length").alias("size"), F.lit(0).alias("slot"))
            swept = scratch.store(_sweep(docs.unionByName(slots)), f"swept{turn}")
            met = scratch.store(_across(swept).coalesce(_tasks(rows)), f"met{turn}")
            used = [swept.where("kind = 'placed'").select(F.col("id").alias("item"), F.col("size").alias("length"), "seq"), met.where("seq IS NOT NULL")]
            left = met.where("seq IS NULL").select("item", "length")
        opens, longest, total = _opening(left, capacity)
        rows = rows or total
        opened = left.where(opens).select("item", "length", F.col("item").alias("seq"))
        placed += [x.withColumn("round", F.lit(turn)) for x in (*used, opened)]
        if longest is not None:
            changes = [opened.select("seq", (capacity - F.col("length")).alias("gap")), *(x.select("seq", (-F.col("length")).alias("gap")) for x in used)]
            change = gaps
            for x in changes:
                change = x if change is None else change.unionByName(x)
            change = change.groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0")
            gaps = scratch.store(change.coalesce(_tasks(rows)), f"gaps{turn}")
            if turn:
                scratch.drop(f"gaps{turn - 1}")
        waiting, turn = left.where(~opens), turn + 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``ids`` if kept.

    A document is its ids and a closing 0; only longer ones than ``capacity`` are cut (``cut``).  Every sequence
    is gapless from offset 0 and holds at most ``capacity`` ids.  Full pieces are sequences by themselves,
    the rest is packed in rounds (``assign``) on (item, length) rows alone; texts are never shuffled.

    NULL and empty texts are the closing 0 alone.  Ids may be NULL or repeat: each row is packed by itself.
    An empty table gives no rows; further columns are ignored; a long text is tokenised and cut whole."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col, keep_ids)
    pieces = scratch.store(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = F.col("length") < capacity
    seats = assign(pieces.where(short).select("item", "length"), capacity, scratch).select("item", "seq", "round")
    before = Window.partitionBy("seq").orderBy("round", "item").rowsBetween(Window.unboundedPreceding, -1)
    packed = pieces.where(short).join(seats, "item").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    full = pieces.where(~short).withColumn("seq", F.col("item")).withColumn("offset", F.lit(0).cast("bigint"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset", *["ids"] * keep_ids]
    return packed.select(*columns).unionByName(full.select(*columns))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces that kept their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))

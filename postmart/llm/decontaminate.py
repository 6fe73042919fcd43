"""Benchmark decontamination: an FM-index per shard of documents, searched for the phrases of a benchmark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postmart.llm.common import Scratch, sql_lower, text_or_empty
from postmart.llm.fm_index import FMIndex

#: Bytes of text that one index covers, and bytes of phrases that are searched for in one pass.
SHARD_BYTES, BLOCK_BYTES = 6 << 20, 32 << 20

# What a word is made of, lower-cased: digits, letters a-z, everything beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def phrases(bench: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, phrase): all windows of each item's words, or all its words if they are fewer."""
    words = F.regexp_extract_all(F.translate(text_or_empty(text_col), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    split = bench.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))
    return split.select("item", F.explode(windows).alias("phrase")).distinct()


@dataclass
class Block:
    """Phrases as rows of word numbers (from 1, padded with 0), and the items of each."""

    words: list[bytes]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    of_phrase: np.ndarray  # item numbers, phrase by phrase
    begin: np.ndarray  # where those of a phrase begin

    @classmethod
    def of(cls, pairs: pa.Table, window: int) -> Block:
        pairs = pairs.sort_by("phrase")
        text, item = pairs.column("phrase").to_pylist(), pairs.column("item").to_pylist()
        distinct = list(dict.fromkeys(text))
        vocabulary: dict[str, int] = {}
        rows = np.zeros((len(distinct), window), np.int32)
        lengths = np.zeros(len(distinct), np.int64)
        for k, phrase in enumerate(distinct):
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in phrase.split(" ")]
            rows[k, : len(numbers)], lengths[k] = numbers, len(numbers)
        number = {p: k for k, p in enumerate(distinct)}
        names: dict[str, int] = {}
        known = [(number[p], names.setdefault(i, len(names))) for p, i in zip(text, item, strict=True) if i is not None]
        at = np.array([k for k, _ in known], np.int64)
        begin = np.searchsorted(at, np.arange(len(distinct) + 1))
        return cls([w.encode() for w in vocabulary], rows, lengths, list(names), np.array([i for _, i in known], np.int64), begin)


@dataclass
class _Doc:
    head: object
    text: bytes
    mask: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    items: set[int] = field(default_factory=set)


def _pieces(text: bytes, most: int) -> Iterator[list[bytes]]:
    """Words of consecutive parts of a text, cut between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        part = text[at:end].translate(_TO_WORDS)
        if end < len(text) and (space := part.rfind(b" ")) >= 0:
            end, part = at + space + 1, part[: space + 1]
        while end < len(text) and part[-1:] != b" ":  # a word longer than a part
            more = text[end : end + most].translate(_TO_WORDS)
            space = more.find(b" ")
            more = more if space < 0 else more[: space + 1]
            part, end = part + more, end + len(more)
        yield part.split()
        at = end


class _Shard:
    """Documents, or parts of a long one, that are indexed together."""

    def __init__(self, block: Block, window: int):
        self.block, self.window = block, window
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.parts: list[tuple[_Doc, int, np.ndarray]] = []

    def add(self, doc: _Doc, words: list[bytes], again: int) -> None:
        """``again``: so many words were the end of the document's part before."""
        number = self.vocabulary
        ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int32, len(words))
        self.parts.append((doc, again, ids))

    def search(self) -> None:
        """Mark the words of all occurrences and note the items."""
        if not self.parts:
            return
        counts = np.array([len(ids) for _, _, ids in self.parts])
        masks = [np.zeros(n, bool) for n in counts]
        known = np.array([0, *(self.vocabulary.get(w, 0) for w in self.block.words)])
        if known.any() and counts.sum():
            index = FMIndex(np.concatenate([ids for _, _, ids in self.parts]), counts, len(self.vocabulary))
            which, place = index.occurrences(known[self.block.rows], self.block.lengths)
            part = np.searchsorted(index.starts, place, side="right") - 1
            edges = np.zeros(index.size + 1, np.int64)
            np.add.at(edges, place, 1)
            np.add.at(edges, place + self.block.lengths[which], -1)
            hit = np.cumsum(edges) > 0
            for k in np.unique(part):
                masks[k] = hit[index.starts[k] : index.starts[k] + counts[k]]
            pair = np.unique(part * len(self.block.rows) + which)
            part, which = pair // len(self.block.rows), pair % len(self.block.rows)
            begin = self.block.begin[which]
            times = self.block.begin[which + 1] - begin
            at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
            found = np.unique(np.repeat(part, times) * len(self.block.items) + self.block.of_phrase[at]) if len(at) else at
            for k, item in zip((found // max(1, len(self.block.items))).tolist(), (found % max(1, len(self.block.items))).tolist(), strict=True):
                self.parts[k][0].items.add(item)
        for (doc, again, _), mask in zip(self.parts, masks, strict=True):
            if again:
                doc.mask[-again:] |= mask[:again]
            doc.mask = np.concatenate([doc.mask, mask[again:]])
        self.clear()


def _spans(doc: _Doc, mask: np.ndarray) -> list[tuple[int, int]]:
    """(first byte, end) of each run of marked words."""
    inside = np.frombuffer(doc.text.translate(_TO_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    run = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return list(zip(edges[0::2][run[0::2]].tolist(), edges[1::2][run[1::2] - 1].tolist(), strict=True))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _searched(docs: DataFrame, block: Block, window: int) -> DataFrame:
    """(head, n_words, n_hit, items, words, spans) of each row of ``docs`` (head, text).  ``words`` and ``spans``
    are runs of hit words, counted in words and in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = T.StructType([docs.schema["head"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit")),
                         T.StructField("items", T.ArrayType(T.StringType())), T.StructField("words", _SPANS), T.StructField("spans", _SPANS)])
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def finished(done: list[_Doc]) -> pa.RecordBatch:
        rows = []
        for doc in done:
            mask = doc.mask
            words, spans = [], []
            if mask.any():
                run = np.flatnonzero(np.diff(np.r_[False, mask, False])).tolist()
                words = [{"start": a, "length": b - a} for a, b in zip(run[0::2], run[1::2], strict=True)]
                points = np.r_[0, np.cumsum((np.frombuffer(doc.text, np.uint8) & 0xC0) != 0x80)]
                spans = [{"start": int(points[a]), "length": int(points[b] - points[a])} for a, b in _spans(doc, mask)]
            rows.append((len(mask), int(mask.sum()), [shared.value.items[i] for i in doc.items], words, spans))
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pairs, pairs)
        heads = pa.concat_arrays([d.head for d in done])
        return pa.RecordBatch.from_arrays([heads, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], kind.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, waiting = _Shard(shared.value, window), 0, []
        for batch in batches:
            heads = batch.column("head")
            for k, text in enumerate(batch.column("text")):
                doc = _Doc(heads.slice(k, 1), text.as_buffer().to_pybytes())
                waiting.append(doc)
                tail: list[bytes] = []
                for words in _pieces(doc.text, SHARD_BYTES):
                    shard.add(doc, tail + words, len(tail))
                    tail = (tail + words)[-(window - 1) :] if window > 1 else []
                    held += sum(map(len, words)) + len(words)
                    if held >= SHARD_BYTES:
                        shard.search()
                        held = 0
                if not held:
                    yield finished(waiting)
                    waiting = []
        shard.search()
        if waiting:
            yield finished(waiting)

    return docs.select("head", "text").mapInArrow(run, kind)


def _merged(found: DataFrame) -> DataFrame:
    """One row for each row number of what several passes have found: runs are united."""

    def united(runs: Column) -> Column:
        ends = F.transform(F.array_sort(runs), lambda r: F.struct(r["start"].alias("start"), (r["start"] + r["length"]).alias("end")))
        empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

        def add(done: Column, r: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
            return F.when(r["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

        return F.transform(F.aggregate(ends, empty, add), lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("length")))

    all_ = found.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "words")])
    return all_.select("row", F.array_distinct("items").alias("items"), united(F.col("words")).alias("words"))


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, ``n_words``, ``n_hit``, ``items``, ``words``, ``spans``) of each row of ``docs``.

    A phrase is ``window`` consecutive words of an item, or all of a shorter item.  A word is hit if an occurrence of
    a phrase covers it.  ``items``: those with an occurring phrase; ``words`` and ``spans``: the runs of hit words as
    (start, length) in words and in code points.

    Each task indexes its documents in shards of ``SHARD_BYTES`` and searches all phrases there; nothing is
    shuffled.  Phrases go to the tasks in blocks of at most about ``BLOCK_BYTES``: one pass for an ordinary benchmark.
    A larger one takes several passes over a stored copy of the documents, whose runs are united by row; ``spans``
    are then taken from the united words.

    NULL and empty texts, on either side, have no words and no phrases.  Items with equal ids are one item; a
    phrase of an item without an id hits words and counts no item.  Rows with equal or no ids are rows of their
    own.  Empty tables give no hits or no rows; further columns are ignored.  A text longer than a shard is
    indexed in parts that overlap by ``window`` - 1 words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    pairs = scratch.store(phrases(bench, window, item_col, item_text_col), "phrases")
    total = pairs.agg(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("item"), F.lit(0)) + 8)).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    head = F.col(id_col)
    rows = docs.select(head.alias("head"), text_or_empty(text_col).alias("text"))
    block = lambda k: Block.of(pairs.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == k).toArrow(), window)
    if blocks == 1:
        return _searched(rows, block(0), window).withColumnRenamed("head", id_col)
    kept = scratch.store(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    numbered = kept.select(F.col("row").alias("head"), "text")
    parts = [scratch.store(_searched(numbered, block(k), window), f"block{k}") for k in range(blocks)]
    found = _merged_union([p.where("n_hit > 0").select(F.col("head").alias("row"), "items", "words") for p in parts])
    sized = parts[0].select(F.col("head").alias("row"), "n_words").join(found, "row", "left").join(kept, "row")
    nothing = F.array().cast(_SPANS)
    whole = sized.select("head", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("words", nothing).alias("words"), "text")
    return _with_spans(whole).withColumnRenamed("head", id_col)


def _merged_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _merged(out)


def _with_spans(rows: DataFrame) -> DataFrame:
    """``n_hit`` and ``spans`` from the runs of words and the text."""
    kind = T.StructType([rows.schema["head"], rows.schema["n_words"], T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                         T.StructField("words", _SPANS), T.StructField("spans", _SPANS)])
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for n, words, text in zip(batch.column("n_words").to_pylist(), batch.column("words").to_pylist(), batch.column("text"), strict=True):
                own = []
                if words:
                    mask = np.zeros(n, bool)
                    for w in words:
                        mask[w["start"] : w["start"] + w["length"]] = True
                    doc = _Doc(None, text.as_buffer().to_pybytes())
                    points = np.r_[0, np.cumsum((np.frombuffer(doc.text, np.uint8) & 0xC0) != 0x80)]
                    own = [{"start": int(points[a]), "length": int(points[b] - points[a])} for a, b in _spans(doc, mask)]
                spans.append(own)
            hits = [sum(w["length"] for w in words) for words in batch.column("words").to_pylist()]
            columns = [batch.column("head"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items"), batch.column("words"), pa.array(spans, pairs)]
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    return rows.mapInArrow(run, kind)


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.try_element_at(spans, F.greatest(i, F.lit(1)))["start"] + F.try_element_at(spans, F.greatest(i, F.lit(1)))["length"] + 1)
    stop = lambda i: F.coalesce(F.try_element_at(spans, i + 1)["start"], F.length(text).cast("bigint"))
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substr(text, start(i).cast("int"), (stop(i) - start(i) + 1).cast("int")))
    return F.array_join(kept, "")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, and a hash of the items that occur in a document."""
    return found.select(
        id_col, "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _sql_words(table: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all({sql_lower('text')}, '{_WORD}') AS w FROM {table} WHERE text IS NOT NULL"


SQL = f"""
WITH d AS ({_sql_words("documents", "doc_id")}),
b AS ({_sql_words("benchmark", "CAST(item_id AS VARCHAR) AS item")}),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS (SELECT doc_id, i, o.n, item FROM o JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM f) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

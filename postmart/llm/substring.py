"""Repeated passages: recurring phrases are confirmed by counting, compiled into automata, and cut out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postmart.llm.common import Scratch, text_or_empty
from postmart.operators.skew import join_facts

#: Bytes of text that are hashed at once, that one shard of documents holds about, and that one automaton serves.
CHUNK, SHARD_BYTES, AUTOMATON_BYTES = 1 << 20, 4 << 20, 16 << 20

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_TOP = _U(2**64 - 1)


@lru_cache(maxsize=8)
def _powers(which: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def run(base: int) -> np.ndarray:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    base = _BASES[which]
    return run(base), run(pow(base, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _size(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a buffer that begins and ends with a separator."""
    found, at = [], 0
    while at < len(text) - 1:
        end = min(len(text), at + CHUNK)
        while end < len(text) and not _SEPARATOR[text[end - 1]]:
            end += 1
        b = np.frombuffer(text, np.uint8, end - at, at)
        sep = np.r_[True, _SEPARATOR[b], True]
        edges = np.flatnonzero(sep[1:] != sep[:-1])
        start, stop = edges[0::2], edges[1::2]
        up, down = _powers("byte", _size(len(b)))
        sums = np.r_[_U(0), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)]
        found.append(_mix((sums[stop] - sums[start]) * down[start]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Grams:
    """Words and windows of some texts.  The anchor of a window is the phrase of ``anchor`` words in it with the
    smallest hash, the leftmost of equal ones: it depends on the window alone, so equal windows in different
    texts have equal anchors, and a text has few of them."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.anchor = window, max(1, 3 * window // 8)
        per = [word_hashes(b" " + t + b" ") for t in texts]
        self.counts = np.array([len(p) for p in per], np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.words = np.concatenate(per) if per else np.zeros(0, np.uint64)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        up, self._down = _powers("word", _size(n + 1))
        self._sums = np.r_[_U(0), np.cumsum(self.words * up[:n], dtype=np.uint64)]
        first = np.arange(max(0, n - window + 1))
        self.at = first[self.doc[first] == self.doc[first + window - 1]]  # first word of each window
        if len(self.at):
            phrase = self._gram(np.arange(n - self.anchor + 1), self.anchor)
            self.place = self._leftmost_least(phrase)[self.at]
            self.units, self.unit = np.unique(self.place, return_inverse=True)
        else:
            phrase = np.zeros(0, np.uint64)
            self.place = self.units = self.unit = np.zeros(0, np.int64)
        self.a = phrase[self.units]
        d = self.doc[self.units] if len(self.units) else self.units
        reach = window - self.anchor
        low, high = np.maximum(self.starts[d], self.units - reach), np.minimum(self.ends[d], self.units + self.anchor + reach)
        whole = (self._sums[high] - self._sums[low]) * self._down[low]
        self.x = _mix(whole ^ _mix((self.units - low).astype(np.uint64) * _U(1 << 20) + (high - self.units).astype(np.uint64)))

    def _gram(self, at: np.ndarray, n: int) -> np.ndarray:
        return _mix((self._sums[at + n] - self._sums[at]) * self._down[at])

    def _leftmost_least(self, phrase: np.ndarray) -> np.ndarray:
        """For each window the place of its anchor, by doubling the range that is looked at."""
        value, place, width, goal = phrase, np.arange(len(phrase)), 1, self.window - self.anchor + 1
        while width < goal:
            step = min(width, goal - width)
            right = value[step:] < value[:-step]
            place = np.where(right, place[step:], place[:-step])
            value = np.where(right, value[step:], value[:-step])
            width += step
        return place

    def windows(self, which: np.ndarray) -> np.ndarray:
        return self._gram(self.at[which], self.window)


def _batched(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``most`` bytes: (position of the first, texts)."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= most:
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bytes(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in column]


def phrases(docs: DataFrame, window: int) -> DataFrame:
    """(a, x, id): each anchor of each document with its surroundings x, all that windows around it can hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for begin, texts in _batched(_bytes(batch.column("text")), CHUNK):
                g = Grams(texts, window)
                yield pa.RecordBatch.from_arrays([_signed(g.a), _signed(g.x), pa.array(ids[begin:][g.doc[g.units]] if len(g.units) else g.units, pa.int64())], ["a", "x", "id"])

    return docs.where("id IS NOT NULL").select("id", "text").mapInArrow(run, "a bigint, x bigint, id bigint")


def _key(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(_mix(ids.astype(np.int64).view(np.uint64)) ^ a) ^ b)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a) ^ b)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _variant_windows(sharded: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """(a, h, id) of the windows around the phrases in ``firsts`` (shard, id, a, x)."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asked.num_rows and docs.num_rows:
            want = np.sort(_key(_column(asked, "id"), _column(asked, "a").view(np.uint64), _column(asked, "x").view(np.uint64)))
            docs = docs.filter(pc.is_in(docs.column("id"), pc.unique(asked.column("id"))))
            ids = docs.column("id").to_numpy()
            for begin, texts in _batched(_bytes(docs.column("text")), CHUNK):
                g = Grams(texts, window)
                if len(g.units):
                    own = ids[begin:][g.doc[g.units]]
                    chosen = np.isin(_key(own, g.a, g.x), want)[g.unit]
                    unit = g.unit[chosen]
                    for held, new in zip(out, (g.a[unit].view(np.int64), g.windows(chosen).view(np.int64), own[unit]), strict=True):
                        held.append(new)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "h", "id"), columns, strict=True)})

    return sharded.groupBy("shard").cogroup(firsts.groupBy("shard")).applyInArrow(run, "a bigint, h bigint, id bigint")


def passages(g: Grams, ids: np.ndarray, confirmed: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(first word, end, largest of the windows' earliest ids) of runs of windows that an earlier text has."""
    if not len(g.at):
        return []
    none = np.iinfo(np.int64).max
    early = np.full(len(g.at), none)
    own = ids[g.doc[g.units]]
    for kind, (keys, earliest) in confirmed.items():
        if not len(keys):
            continue
        have = _pair(g.a, g.x) if kind == "phrase" else _pair(g.a[g.unit], g.windows(np.ones(len(g.at), bool)))
        slot = np.minimum(np.searchsorted(keys, have), len(keys) - 1)
        found = np.where((keys[slot] == have) & (earliest[slot] < (own if kind == "phrase" else own[g.unit])), earliest[slot], none)
        early = np.minimum(early, found[g.unit] if kind == "phrase" else found)
    hit = np.flatnonzero(early < none)
    if not len(hit):
        return []
    at = g.at[hit]
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (g.doc[at[1:]] != g.doc[at[:-1]])])
    last = np.r_[cut[1:], len(at)] - 1
    return list(zip(at[cut].tolist(), (at[last] + g.window).tolist(), np.maximum.reduceat(early[hit], cut).tolist(), strict=True))


def locate(g: Grams, ids: list[int | None], found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words are covered: the passages are compiled into an automaton over words, all texts run through it,
    and an occurrence counts where the passage has an earlier origin than the text."""
    covered = np.zeros(len(g.words), bool)
    if not found:
        return covered
    letters = np.unique(g.words, return_inverse=True)[1].tolist()
    patterns: dict[tuple[int, ...], int] = {}
    for begin, end, early in found:
        word = tuple(letters[begin:end])
        patterns[word] = min(early, patterns.get(word, early))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for word, early in patterns.items():
        automaton.add_word(word, (len(word), early))
    automaton.make_automaton()
    for own, start, end in zip(ids, g.starts.tolist(), g.ends.tolist(), strict=True):
        if own is not None and end - start >= g.window:
            for at, (length, early) in automaton.iter(tuple(letters[start:end])):
                if early < own:
                    covered[start + at - length + 1 : start + at + 1] = True
    return covered


def _cut_out(sharded: DataFrame, confirmed: DataFrame, window: int, with_text: bool) -> DataFrame:
    names = ["id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        sets = {}
        for kind in ("phrase", "window"):
            part = known.filter(pc.equal(known.column("kind"), kind)) if known.num_rows else known
            keys = _pair(_column(part, "a").view(np.uint64), _column(part, "b").view(np.uint64))
            order = np.argsort(keys)
            sets[kind] = keys[order], _column(part, "early")[order]
        ids, rows = docs.column("id").to_pylist(), []
        for begin, texts in _batched(_bytes(docs.column("text")), AUTOMATON_BYTES):
            own = ids[begin : begin + len(texts)]
            if known.num_rows:
                g = Grams(texts, window)
                covered = locate(g, own, passages(g, np.array([i or 0 for i in own], np.int64), sets))
            for k, text in enumerate(texts):
                words, gone = text.split(), 0
                if known.num_rows and (mask := covered[g.starts[k] : g.ends[k]]).any():
                    gone = int(mask.sum())
                    kept = b" ".join([w for w, out in zip(words, mask.tolist(), strict=True) if not out])
                else:
                    kept = b" ".join(words)
                rows.append((own[k], len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode())[: len(names)])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=False)})

    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return sharded.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(run, schema)


def cut_repeats(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``; the kept text if asked for.

    A word goes if a window of ``window`` consecutive words around it also stands in a document with a smaller
    id.  Words are what white space separates, unchanged; windows are judged on the input.

    1. Every window has an anchor (``Grams``), about one for every 16 words.  Phrases (anchor and all that
       windows around it hold) are counted: smallest id of each, and anchors with several surroundings.
    2. A phrase that an earlier document has covers all its windows.  Only where an anchor has several
       surroundings, and only in the first document of each, windows are counted themselves: whichever
       document has a window first is the first one of its surroundings too, so nothing is missed.
    3. Documents are dealt to shards.  What was confirmed goes once to each shard that has it, so a phrase of all
       documents is as many rows as there are shards.  A shard's passages are compiled into an
       automaton and all its documents run through it, which finds every occurrence.

    A passage in very many documents is one row after counting, and no pair of documents is ever formed.  Rows
    without an id have no order: nothing is cut from them and they cut nothing.  Rows with equal ids do not
    cut each other.  NULL and empty texts have no words; an empty table gives no rows; further columns
    are ignored; a long text is one automaton's work at most, and hashed in pieces."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES + 1)
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.xxhash64("text"))), F.lit(shards)))
    shard_of = lambda column: F.pmod(F.xxhash64(column), F.lit(shards)).alias("shard")

    found = scratch.store(phrases(rows, window), "phrases")
    units = found.groupBy("a", "x").agg(F.min("id").alias("early"), F.max("id").alias("late"))
    units = scratch.store(units, "units")
    several = units.groupBy("a").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    several = several.select("a", "n", F.lit(True).alias("varied"))
    firsts = join_facts(units, several, "a", ["x"], rows="n").where("varied").select(shard_of("early"), F.col("early").alias("id"), "a", "x")
    windows = scratch.store(_variant_windows(sharded, firsts, window), "windows")
    seen = windows.groupBy("a", "h").agg(F.min("id").alias("early"), F.max("id").alias("late"))
    confirmed = None
    for kind, places, first, b in (("phrase", found, units, "x"), ("window", windows, seen, "h")):
        per_shard = places.select(shard_of("id"), "a", b).distinct().join(first.where("early < late").drop("late"), ["a", b])
        part = per_shard.select("shard", "a", F.col(b).alias("b"), "early", F.lit(kind).alias("kind"))
        confirmed = part if confirmed is None else confirmed.unionByName(part)
    return _cut_out(sharded, confirmed, window, with_text).withColumnRenamed("id", id_col)


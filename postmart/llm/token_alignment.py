"""Cross-tokenizer alignment: galloping intersection of token ends, groups, links and how common links are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postmart.llm.common import Scratch
from postmart.llm.tokens import PairEncoder, pair_encoder

#: Bytes of text that are aligned at once, and that one stored row of links covers.
PART, CHUNK = 1 << 20, 8 << 20


def gallop(ends: np.ndarray, longer: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """Place of the first of ``longer`` that is at least each of ``ends`` (none is larger than the last).

    All searches advance together: from its hint each one doubles its step, to the right or to the left, until
    it has passed the place, then halves what is left."""
    low, high = hint - 1, hint.copy()  # longer[low] < end <= longer[high], once found
    right = np.flatnonzero(longer[hint] < ends)
    left = np.flatnonzero(longer[hint] >= ends)
    low[right], step = hint[right], 1
    while len(right):
        probe = np.minimum(hint[right] + step, len(longer) - 1)
        small = longer[probe] < ends[right]
        high[right[~small]] = probe[~small]
        right, probe = right[small], probe[small]
        low[right] = probe
        step *= 2
    step = 1
    while len(left):
        probe = hint[left] - step
        large = (probe >= 0) & (longer[np.maximum(probe, 0)] >= ends[left])
        low[left[~large]] = np.maximum(probe[~large], -1)
        left, probe = left[large], probe[large]
        high[left] = probe
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        small = longer[middle] < ends[open_]
        low[open_[small]], high[open_[~small]] = middle[small], middle[~small]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


@dataclass
class Aligned:
    """Some texts' tokens with the shorter lists driving.  ``place``: of each shorter end in the longer list;
    ``hit``: whether both end there; ``first``: the first longer token that a shorter one overlaps."""

    place: np.ndarray
    hit: np.ndarray
    first: np.ndarray


def align(shorter: np.ndarray, longer: np.ndarray, n_shorter: np.ndarray, n_longer: np.ndarray) -> Aligned:
    """Token lengths in bytes, text by text, and tokens per text; every text has as many bytes in both."""
    ends, others = np.cumsum(shorter), np.cumsum(longer)
    doc = np.repeat(np.arange(len(n_shorter)), n_shorter)
    own = np.arange(len(ends)) - np.repeat(np.cumsum(n_shorter) - n_shorter, n_shorter)
    hint = (np.cumsum(n_longer) - n_longer)[doc] + own * n_longer[doc] // n_shorter[doc]
    place = gallop(ends, others, hint)
    hit = others[place] == ends
    return Aligned(place, hit, np.r_[0, (place + hit)[:-1]] if len(place) else place)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([str(i).encode() for i in range(n)])
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text)


class Speller:
    """Groups as text: ids in decimal, ``,`` within a side, ``|`` between sides, ``;`` after a group."""

    def __init__(self, top: int):
        self.digits, self.sizes = _digits(top)

    def spell(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all characters, where each token of b ends in them).  ``last``: the token ends its group."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        at_a = np.arange(len(a)) + np.r_[0, stop_b][group_a]
        at_b = np.arange(len(b)) + stop_a[group_b]
        n, width = len(a) + len(b), self.digits.shape[1]
        ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a], mark[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        rows, sizes = np.zeros((n, width + 1), np.uint8), self.sizes[ids]
        rows[:, :width] = self.digits[ids]
        rows[np.arange(n), sizes] = mark
        return rows[np.arange(width + 1) <= sizes[:, None]], np.cumsum(sizes + 1)[at_b]


@dataclass
class _Doc:
    id: int | None
    good: bool = True
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))  # n_a, n_b, groups, links
    hash: object = None
    groups: list[bytes] = field(default_factory=list)


class _Chunk:
    """Documents whose links are stored in one row."""

    def __init__(self, encoder: PairEncoder, keep_groups: bool):
        self.encoder, self.keep_groups = encoder, keep_groups
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (encoder.first_bytes, encoder.second_bytes))
        self.width = len(self.b_size)
        self.shift = int(len(self.a_size) * self.width).bit_length()
        self.speller = Speller(max(len(self.a_size), self.width))
        self.clear()

    def clear(self) -> None:
        self.docs: list[_Doc] = []
        self.waiting: list[tuple[int, bytes, bytes]] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = self.bytes = 0

    def add(self, id_: int | None, text: str) -> None:
        doc = _Doc(id_)
        self.docs.append(doc)
        a, b = [], []

        def pass_on() -> None:
            if a and doc.good:
                self.waiting.append((len(self.docs) - 1, b"".join(a), b"".join(b)))
            a.clear()
            b.clear()
            if self.held >= PART:
                self.work()

        for unit in self.encoder.units(text) if text else []:
            found = self.encoder.encode(unit)
            if found is None:
                doc.good = False
                break
            a.append(found[0])
            b.append(found[1])
            self.held += len(unit) + 1
            self.bytes += len(unit) + 1
            if self.held >= PART:
                pass_on()
        pass_on()

    def work(self) -> None:
        """Align what waits: texts with fewer tokens of the first tokenizer by those, the others the other way."""
        waiting, self.waiting, self.held = self.waiting, [], 0
        for turned in (False, True):
            mine = [w for w in waiting if (len(w[1]) > len(w[2])) == turned]
            if mine:
                self._work(mine, turned)

    def _work(self, parts: list[tuple[int, bytes, bytes]], turned: bool) -> None:
        a, b = (np.frombuffer(b"".join([p[k] for p in parts]), "<i4").astype(np.int64) for k in (1, 2))
        n_a, n_b = (np.array([len(p[k]) // 4 for p in parts]) for k in (1, 2))
        doc = np.array([p[0] for p in parts])
        s, l, n_s, n_l = (b, a, n_b, n_a) if turned else (a, b, n_a, n_b)  # noqa: E741
        sizes = (self.b_size, self.a_size) if turned else (self.a_size, self.b_size)
        found = align(sizes[0][s], sizes[1][l], n_s, n_l)
        overlaps = found.place - found.first + 1
        which = np.repeat(np.arange(len(s)), overlaps)
        other = np.arange(len(which)) - np.repeat(np.cumsum(overlaps) - overlaps, overlaps) + np.repeat(found.first, overlaps)
        pair = l[other] * self.width + s[which] if turned else s[which] * self.width + l[other]
        edge = np.cumsum(n_s) - n_s
        groups, links = (np.add.reduceat(x.astype(np.int64), edge) for x in (found.hit, overlaps))
        keys, times = np.unique((np.repeat(doc, n_s)[which] << self.shift) | pair, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        other_last = np.zeros(len(l), bool)
        other_last[found.place[found.hit]] = True
        last_a, last_b = (other_last, found.hit) if turned else (found.hit, other_last)
        text, stop = self.speller.spell(a, b, last_a, last_b)
        stops = stop[np.cumsum(n_b) - 1].tolist()
        for k, (at, begin, end) in enumerate(zip(doc.tolist(), [0, *stops[:-1]], stops, strict=True)):
            d = self.docs[at]
            d.tokens += (n_a[k], n_b[k], groups[k], links[k])
            spelled = text[begin : end - 1].tobytes()
            if d.hash is None:
                d.hash = hashlib.sha256(spelled)
            else:
                d.hash.update(b";" + spelled)
            if self.keep_groups:
                d.groups.append(spelled)

    def row(self, number: int) -> dict:
        """All documents so far as one row, and begin anew."""
        self.work()
        keys, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.times))
        good = np.array([d.good for d in self.docs], bool)
        keep = good[keys >> self.shift] if len(keys) else np.zeros(0, bool)
        keys, place = np.unique(keys[keep], return_inverse=True)  # a long text comes in several parts
        times = np.bincount(place, weights=times[keep], minlength=len(keys)).astype(np.int64)
        pairs, slot, n = np.unique(keys & ((1 << self.shift) - 1), return_inverse=True, return_counts=True)
        owners = np.bincount(keys >> self.shift, minlength=len(self.docs))
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()
        zero = np.zeros(4, np.int64)
        tokens = np.array([d.tokens if d.good else zero for d in self.docs]).reshape(-1, 4)
        done = {
            "chunk": number, "pairs": pairs, "n": n, "slots": small(slot), "times": small(times), "owners": owners,
            "ids": [d.id for d in self.docs], **{name: tokens[:, k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "sha": [d.hash.hexdigest() if d.good and d.hash else "" for d in self.docs],
            "groups": [(b";".join(d.groups).decode() if d.good else "") if self.keep_groups else None for d in self.docs],
        }
        self.clear()
        return done


_NUMBERS = ("pairs", "n", "owners", "ids", "n_a", "n_b", "n_groups", "n_links")
_CHUNKS = "chunk bigint, " + ", ".join(f"{c} array<bigint>" for c in _NUMBERS) + ", slots binary, times binary, sha array<string>, groups array<string>"


def link_chunks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """One row for about ``CHUNK`` bytes of documents: its distinct id pairs with their numbers of documents, and each
    document's counts and links (numbers of pairs, how often)."""
    types = {c: pa.list_(pa.int64()) for c in _NUMBERS} | {"chunk": pa.int64(), "slots": pa.binary(), "times": pa.binary(), "sha": pa.list_(pa.string()), "groups": pa.list_(pa.string())}
    names = [c.strip().split()[0] for c in _CHUNKS.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number = _Chunk(pair_encoder(byte_path, piece_path), keep_groups), TaskContext.get().partitionId() << 33
        packed = lambda row: pa.RecordBatch.from_arrays([pa.array([row[c]], types[c]) for c in names], names)
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                chunk.add(id_, text.as_py() or "")
                if chunk.bytes >= CHUNK:
                    yield packed(chunk.row(number))
                    number += 1
        if chunk.docs:
            yield packed(chunk.row(number))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _CHUNKS)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(pair, ``count``, ``best``): in how many documents of the corpus a pair is linked, and whether no other pair of
    its first id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {width}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``; the groups' text if asked for.

    1. Tasks encode whole texts by both tokenizers and intersect the byte offsets where tokens end (``gallop``):
       common ends cut groups, ranks in the longer list give the tokens that overlap.  About ``CHUNK`` bytes of
       documents become one stored row that holds each distinct pair once.
    2. Pairs are counted over all chunks by a shuffle on the pair, and each chunk gets the counts of its own pairs
       back.  A pair of every text has one row in a chunk, however many documents link it, and no table of pairs
       goes through the driver or to all tasks.

    Texts that are NULL, empty, or that a tokenizer changes have no tokens: zeros, and an empty hash.  Rows with equal
    or no ids are documents of their own; an empty table gives no rows; further columns are ignored.  A text
    longer than ``PART`` is aligned in parts that end where both tokenizers begin anew."""
    import sentencepiece

    scratch = Scratch(docs.sparkSession, "alignment")
    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    chunks = scratch.store(link_chunks(docs, byte_path, piece_path, id_col, text_col, keep_groups), "chunks")
    own = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "n")).alias("slot", "x")).select("chunk", "slot", F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    found = own.join(pair_counts(own, width), "pair").select("chunk", "slot", "count", "best")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"][: 8 + keep_groups]

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        slots, counts, best = (known.column(c).to_numpy() for c in ("slot", "count", "best"))
        count, top = np.zeros(len(slots), np.int64), np.zeros(len(slots), bool)
        count[slots], top[slots] = counts, best
        row = {c: chunk.column(c)[0] for c in chunk.column_names}
        ids, owners = row["ids"].values, row["owners"].values.to_numpy()
        links = int(owners.sum())
        read = lambda c: np.frombuffer(raw := row[c].as_py(), f"u{max(1, len(raw) // max(1, links))}")
        slot, times = read("slots").astype(np.int64), read("times").astype(np.int64)
        edge = np.r_[0, np.cumsum(owners)]
        total, tops = (np.r_[0, np.cumsum(times * x[slot])] if links else np.zeros(1, np.int64) for x in (count, top))
        columns = [ids, *(row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(np.diff(tops[edge])), pa.array(np.diff(total[edge])), row["sha"].values]
        return pa.table([*columns, *([row["groups"].values] if keep_groups else [])], names)

    schema = f"{id_col} bigint, " + ", ".join(f"{c} bigint" for c in names[1:7]) + ", groups_sha256 string" + ", groups string" * keep_groups
    return chunks.drop("pairs", "n").withColumnRenamed("chunk", "own").groupBy("own").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)

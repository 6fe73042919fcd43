"""SimHash near-duplicates: 64-bit fingerprints, all pairs within a radius by covering hashing, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from postmart.llm.common import Scratch, text_or_empty

BITS = 64
#: Members of a bucket that are compared in one task; larger buckets are divided by further masks first.  A
#: mask leaves about 31 of the 64 bits open and a second one about 15 of these, so one division is enough.
BUCKET = 32768


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """2^(radius+1)-1 masks.  Any two words of 64 bits that differ in at most ``radius`` bits agree under one.

    Each bit position i has a vector c(i) of radius+1 bits.  The mask of a vector v holds the positions with
    an odd number of common ones in v and c(i).  The vectors of ``radius`` positions do not span the space,
    so some v other than 0 has an even number with all of them: its mask avoids all these positions."""
    dimension = radius + 1
    step = 2 * (7 * level % 32) + 1  # another arrangement of the positions on each level
    codes = [1 + ((i * step % BITS) + level) % (2**dimension - 1) for i in range(BITS)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2**dimension)]


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half of the shingles' XXH64, as a signed number; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed=42)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = [0, *(ends[: -words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed=42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of each row."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            fps = [fingerprint(x.as_buffer().to_pybytes(), words) for x in text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(mark, "id bigint, fp bigint")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join exactly what is joined by pairs within the radius: one for each member but the first."""
    found, rest = [], fps.view(np.uint64)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                front.extend(rest[near])
                found.extend((root, x) for x in rest[near])
                rest = rest[~near]
    return found


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Sorted buckets, streamed: links (a, b, NULL), and (fp, NULL, mask) for the members of too large ones."""
    key = F.col("fp").bitwiseAND(F.col("mask"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = fp = np.empty(0, np.int64)
        large = None  # (mask, key) of a bucket that is being passed on

        def passed_on(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(mask)], schema=schema)

        def complete(mask: np.ndarray, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs: list[tuple[int, int]] = []
            for k in np.flatnonzero(ends - starts > 1):
                s, e = starts[k], ends[k]
                if e - s > BUCKET:
                    yield passed_on(mask[s:e], fp[s:e])
                else:
                    pairs.extend(_forest(fp[s:e], radius))
            if pairs:
                x = np.array(pairs, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64())], schema=schema)

        for batch in batches:
            mask = np.concatenate([mask, batch.column("mask").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            keys = fp & mask
            if large is not None:
                same = (mask == large[0]) & (keys == large[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield passed_on(mask[:n], fp[:n])
                    mask, fp, keys = mask[n:], fp[n:], keys[n:]
                if len(fp):
                    large = None
            if not len(fp):
                continue
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts = np.r_[0, cut]
            yield from complete(mask, fp, starts[:-1], cut)
            at = starts[-1]
            mask, fp = mask[at:], fp[at:]
            if len(fp) > BUCKET:
                large = (mask[0], fp[0] & mask[0])
                yield passed_on(mask, fp)
                mask, fp = mask[:0], fp[:0]
        if len(fp):
            yield from complete(mask, fp, np.array([0]), np.array([len(fp)]))

    dealt = rows.repartition("mask", key).sortWithinPartitions("mask", key, "fp")
    return dealt.mapInArrow(compare, "a bigint, b bigint, mask bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tables(fps: DataFrame, masks: list[int], mask: Column) -> DataFrame:
    """Each fingerprint once per mask, on top of the bits already agreed on."""
    every = F.explode(F.array(*[F.lit(_signed(x)) for x in masks])).alias("more")
    return fps.select("fp", mask.alias("had"), every).select("fp", F.col("had").bitwiseOR(F.col("more")).alias("mask"))


def links(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (a < b) between the distinct fingerprints ``fps`` whose components are those of all pairs within
    ``radius``.  Covering masks make every such pair meet; a bucket of over ``BUCKET`` members is divided by
    the masks of the next level, which cover its members' pairs again."""
    found: list[DataFrame] = []
    rows, level = _tables(fps, covering_masks(radius), F.lit(0).cast("bigint")), 0
    while True:
        out = scratch.store(_bucket_links(rows, radius), f"links{level}")
        found.append(out.where("b IS NOT NULL").select("a", "b"))
        large = out.where("b IS NULL").select(F.col("a").alias("fp"), "mask")
        if large.isEmpty():
            break
        level += 1
        rows = _tables(large, covering_masks(radius, level), F.col("mask")).distinct()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) with the smallest node of each component as root, for all nodes of the edges (a < b).

    Large-star and small-star steps in turn, each stored: every node hands its smallest neighbour to the
    larger ones, then to the smaller ones, until nothing changes.  No component is collected anywhere."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges, turn = scratch.store(edges, "edges0"), 0
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: edges hang below their larger end.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
        small = small.unionByName(down.select(F.col("m").alias("x"), F.col("b").alias("y")))
        turn += 1
        edges = scratch.store(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"edges{turn}")
        scratch.drop(f"edges{turn - 1}")
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(
    docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    A-Z is lower-cased, words are separated by white space, and each bit of the fingerprint is the majority of
    the XXH64 of all ``words``-word shingles, repeats included.  Fingerprints within ``radius`` bits are
    linked; ``component_id`` is the smallest id that can be reached.

    Equal fingerprints are one node, so a group of copies of any size costs one row there.  Texts with fewer
    words are one shingle; NULL, empty and blank texts have fingerprint 0 and are linked like any other.  NULL
    ids never become a component's id unless it has no other; repeated rows give repeated results; an empty
    table gives none; further columns are ignored; long texts are counted in blocks."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.store(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = scratch.store(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, scratch), scratch)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = scratch.store(rooted.join(smallest, "root").select("fp", "component_id"), "facts")
    out = marked.join(facts, "fp")
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.  Rows that repeat an id are
    one document and stay or go together; rows without an id cannot be told apart and stay."""
    groups = near_groups(docs, words, radius, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col("__gone"), "left_anti")

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postmart.llm import decontaminate as D
from postmart.llm.fm_index import FMIndex, suffix_array
from postmart.llm.queries import op13_decontamination

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return list(WORD.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, bench, n):
    out = []
    phrases = {}
    for item, text in bench:
        w = [m.group() for m in words(text)]
        for i in range(max(1, len(w) - n + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add(item)
    for doc, text in docs:
        found = words(text)
        w = [m.group() for m in found]
        hit, items = [False] * len(w), set()
        for m in {len(p) for p in phrases}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in phrases:
                    items |= {str(x) for x in phrases[p] if x is not None}
                    hit[i : i + m] = [True] * m
        spans, words_ = [], []
        for i, h in enumerate(hit):
            if h and i and hit[i - 1]:
                spans[-1][1], words_[-1][1] = found[i].end() - spans[-1][0], words_[-1][1] + 1
            elif h:
                spans.append([found[i].start(), found[i].end() - found[i].start()])
                words_.append([i, 1])
        out.append((doc, len(w), sum(hit), sorted(items), [tuple(x) for x in words_], [tuple(x) for x in spans]))
    return sorted(out, key=repr)


def result(spark, docs, bench, n):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS head", "2 AS row", "3 AS items").repartition(3)
    b = spark.createDataFrame(bench, "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS phrase")
    got = D.find_contamination(d, b, n).collect()
    return sorted(((r[0], r[1], r[2], sorted(r[3]), [tuple(x) for x in r[4]], [tuple(x) for x in r[5]]) for r in got), key=repr)


def cases():
    rng = np.random.default_rng(2)
    word = lambda: str(rng.choice(["a", "B", "é", "07", "ça", "zz", "Ü"]))
    text = lambda m: "".join(word() + str(rng.choice([" ", ", ", "\n", "--"])) for _ in range(m))
    bench = [(i, text(int(rng.integers(0, 14)))) for i in range(12)] + [(3, text(8)), (None, text(6)), (50, None), (51, ""), (52, " -- "), (53, "!zz!"), (54, "zz")]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "x " + bench[4][1]), (None, "x " + bench[4][1]), (103, bench[2][1] * 3), (103, "\x00" + bench[2][1]), (104, "w" * 3000 + " " + text(400))]
    return docs, bench


@pytest.mark.parametrize("shard, block", [(6 << 20, 32 << 20), (150, 32 << 20), (40, 120)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    import postmart

    docs, bench = cases()
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    want = brute(docs, bench, 4)
    assert sum(r[2] for r in want) > 100
    if shard == 6 << 20:
        assert result(spark, docs, bench, 4) == want
    # Small shards are tried here, as workers do not see a changed constant.
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    assert postmart and [w for p in D._pieces(docs[-1][1].encode(), shard) for w in p] == [m.group().encode() for m in words(docs[-1][1])]
    if block < 1000:
        assert result(spark, docs, bench, 4) == want


def test_parts_of_a_long_text_overlap():
    import pyarrow as pa

    docs, bench = cases()
    pairs = {(None if i is None else str(i), " ".join(m.group() for m in words(t)[k : k + 4])) for i, t in bench for k in range(max(1, len(words(t)) - 3)) if words(t)}
    block = D.Block.of(pa.Table.from_pylist([{"item": i, "phrase": p} for i, p in sorted(pairs, key=repr)]), 4)
    want = {repr(r[0]) + str(r[1]): r for r in brute(docs, bench, 4)}
    for most in (1, 7, 100):
        shard = D._Shard(block, 4)
        for doc, text in docs[:40] + docs[-1:]:
            held, tail = D._Doc(None, (text or "").encode()), []
            for part in D._pieces(held.text, most):
                shard.add(held, tail + part, len(tail))
                tail = (tail + part)[-3:]
                shard.search()
            row = want[repr(doc) + str(len(held.mask))]
            assert int(held.mask.sum()) == row[2] and sorted(block.items[i] for i in held.items) == row[3]


def test_whole_tables_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(D.SQL).fetchall())
    got = sorted(tuple(r) for r in op13_decontamination(spark, SF).collect())
    assert got == want and any(r[5] for r in got)
    assert {r[4] for r in got if not r[3]} == {hashlib.sha256(b"").hexdigest()}


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "Here: one two THREE four, five. End")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("q", "two three, four")], "item_id string, text string")
    found = D.find_contamination(docs, bench, 3)
    assert D.find_contamination(docs.limit(0), bench, 3).count() == 0
    assert D.find_contamination(docs, bench.limit(0), 3).collect()[0]["n_hit"] == 0
    text = found.join(docs, "doc_id").select(D.remove_spans(F.col("text"), F.col("spans"))).first()[0]
    assert text == "Here: one , five. End"


def test_suffixes_and_occurrences():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60)))
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    for _ in range(200):
        counts, top = rng.integers(0, 12, int(rng.integers(1, 8))), int(rng.integers(1, 5))
        w = rng.integers(1, top + 1, counts.sum())
        lengths = rng.integers(0, 5, 10)
        rows = np.where(np.arange(5) < lengths[:, None], rng.integers(0, top + 1, (10, 5)), 0)
        text, at = [], 0
        for c in counts:
            text, at = [*text, *w[at : at + c].tolist(), 0], at + c
        want = sorted((i, s) for i, m in enumerate(lengths) if m and rows[i, :m].all() for s in range(len(text)) if text[s : s + m] == rows[i, :m].tolist())
        assert sorted(zip(*(x.tolist() for x in FMIndex(w, counts, top).occurrences(rows, lengths)), strict=True)) == want

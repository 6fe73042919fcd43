import hashlib
from collections import Counter

import numpy as np
import pytest

from postmart.llm import substring

DOCS = "doc_id bigint, text string"


def brute(rows, window):
    first: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, words in split:
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[(i, len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def corpus(seed, window):
    rng = np.random.default_rng(seed)
    word = lambda n: [str(x) for x in rng.integers(0, 30 if seed % 2 else 3000, n)]
    shared = [word(int(n)) for n in rng.integers(window - 3, 4 * window, 6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts += word(int(rng.integers(0, 2 * window)))
            if rng.random() < 0.5:
                piece = list(shared[int(rng.integers(len(shared)))])
                if rng.random() < 0.4:
                    piece[int(rng.integers(len(piece)))] = "EDIT"
                parts += piece[int(rng.integers(5)) :]
        rows.append((int(rng.integers(0, 10**6)), "\n ".join(parts)))
    rows += rows[:5] + [(i + 1, t) for i, t in rows[:8]]
    rows += [(7, None), (8, ""), (9, " \t"), (None, rows[0][1]), (None, rows[0][1]), (10, "same " * 500), (11, "same " * 500), (12, "Ünï ☃ " * 100), (13, "x Ünï ☃ " * 100)]
    return rows + [(14, "é" * 200_000), (15, " ".join(rows[3][1].split() * 3)), (10, "same " * 40 + "other")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substring, "SHARD_BYTES", 30_000)
    rows = corpus(seed, 20)
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS shard", "2 AS id", "3 AS a").repartition(3)
    got = substring.cut_repeats(frame, window=20)
    want = brute(rows, 20)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 60


def test_kept_text_and_empty_tables(spark):
    text = " ".join(str(i) for i in range(80))
    frame = spark.createDataFrame([(1, text), (2, "a " + text + "\nb"), (3, text[:100])], DOCS)
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring.cut_repeats(frame, with_text=True).collect()}
    assert got == {1: (0, text), 2: (80, "a b"), 3: (0, " ".join(text[:100].split()))}
    assert substring.cut_repeats(frame.limit(0)).count() == 0


def test_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in substring.cut_repeats(frame).collect()) == brute(rows, 50)


def test_long_buffers_are_hashed_in_pieces(monkeypatch):
    text = b" " + b" ".join(str(i).encode() for i in range(5000)) + b" "
    whole = substring.word_hashes(text)
    monkeypatch.setattr(substring, "CHUNK", 97)
    assert (substring.word_hashes(text) == whole).all() and len(set(whole.tolist())) == 5000

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from postmart.llm import packing
from postmart.llm.queries import tokenizer_path
from tests.llm.test_exact_mixing_simhash_urls import brute_components, brute_fingerprint, brute_targets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def data(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    texts = [t for _, t, *_ in rows]
    rows += [(1000 + i, texts[i], "en", "src1", 1) for i in range(20)]  # exact copies
    rows += [(2000 + i, texts[i] + " end.", "en", None, 1) for i in range(20)]  # near copies
    rows += [(3000, None, "en", "src1", 1), (3001, "12 34 !!", "en", "src2", 1), (3002, "", None, None, None), (None, "the and of with was", "en", "src0", 1)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS row", "3 AS share"), rows


def test_stages_agree_with_brute_force(spark, data, folder):
    docs, rows = data
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = lambda rs: Counter(r["doc_id"] for r in rs)

    # Nothing but the texts without letters goes: clean documents stay.
    assert ids(kept["language_id"]) == Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))

    best = {}
    for r in kept["language_id"]:
        best[r["text"]] = max(best.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert ids(kept["exact_dedup"]) == Counter(None if i < 0 else i for i in best.values())

    before = kept["exact_dedup"]
    comps, least = brute_components([brute_fingerprint(r["text"]) for r in before]), {}
    for r, c in zip(before, comps, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    assert ids(kept["simhash_near_dedup"]) == Counter(r["doc_id"] for r, c in zip(before, comps, strict=True) if r["doc_id"] in (None, least.get(c)))

    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept["simhash_near_dedup"]:
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(n, longest[r["source"]])
    for r in kept["mixing"]:
        taken[r["source"]] += len(r["text"].split())
    assert max(ids(kept["mixing"]).values()) <= 3
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source]

    encode, want = packing.encoder(tokenizer_path()), Counter()
    for r in kept["mixing"]:
        tokens = np.frombuffer(encode(r["text"]) + b"\0\0\0\0", "<u4")
        for piece, (s, n) in enumerate(packing.cut(len(tokens), 2048)):
            want[(r["doc_id"], piece, s, n, zlib.crc32(tokens[s : s + n].tobytes()))] += 1
    packed = kept["best_fit_packing"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_stages_take_empty_tables(spark, data):
    empty = data[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 50

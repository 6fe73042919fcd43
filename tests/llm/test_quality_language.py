import math
import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmart.llm import language, quality
from postmart.llm.queries import op3_quality, op5_language

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "!!! ??? ...", "12345", "a", "\x00", "é" * 100_000, "word " * 50_000, "\U0001f600☃", "퟿ x", "\u0301\u0308 \u0903"]


def auc(good, bad):
    order = np.argsort(np.argsort(np.r_[good, bad], kind="stable"), kind="stable")
    return (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / len(good) / len(bad)


def test_held_out_quality(spark):
    rows = op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert auc(np.array(good), np.array(bad)) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (1, ""), (1, "")], "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS stats", "3 AS label")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(6, None), (7, 5), (None, 1), (99, 1)], "doc_id bigint, quality int").selectExpr("*", "'x' AS label")
    got = quality.score_documents(docs, labels, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(docs.limit(0), labels, F.lit(True)).count() == 0
    assert {(r["score"], r["predicted"]) for r in quality.score_documents(docs, labels.limit(0), F.lit(True)).collect()} == {(0.5, 1)}
    assert all(math.isfinite(x) for t in ODD for x in quality.statistics(t or ""))
    assert len(quality.statistics("a b")) == quality.N_STATS


def test_labels_outside_the_sample_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = F.col("id") % 2 == 0
    turned = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_documents(docs, x, learn).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_isotonic():
    x, y = np.arange(6.0), np.array([0.0, 0.5, 0.2, 0.4, 1.0, 0.9])
    knots, levels = quality.isotonic(x, y, np.ones(6))
    # 0.5 and 0.2 are pooled to 0.35, which 0.4 does not violate.
    assert knots.tolist() == [0, 1.5, 3, 4.5] and levels == pytest.approx([0, 0.35, 0.4, 0.95])


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(5, 20_000)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, 20_000)
    model = quality.Model(np.zeros(5), np.ones(5), w, b, np.zeros(1), np.zeros(2), np.zeros(2))
    x = rng.normal(size=(6, 5)) * 2
    z = model.map(x)[:, :-1]
    want = np.exp(-((x[:, None] - x) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert z @ z.T == pytest.approx(want, abs=0.05)


def test_held_out_languages(spark):
    rows = op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows_and_spans(spark):
    latin = ["the cat and the dog were with that thing", "and this is the other one which was there"] * 20
    greek = ["αυτό είναι το σπίτι και η πόλη", "δεν ξέρω τι είναι αυτό"] * 20
    rows = [(i, t, "en") for i, t in enumerate(latin)] + [(100 + i, t, "el") for i, t in enumerate(greek)]
    rows += [(500 + i, t, None) for i, t in enumerate(ODD)] + [(None, "the other", None), (600, None, "xx"), (700, "the dog and the cat. " * 4 + "είναι το σπίτι και. " * 4 + "this was the one", None), (701, "жук", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS id", "2 AS lang_pred", "3 AS score")
    got = {r["doc_id"]: r for r in language.identify(docs, F.col("doc_id") < 500, with_spans=True).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i is not None and i < 500)
    for i, t in enumerate(ODD):
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            assert (got[500 + i]["lang_pred"], got[500 + i]["score"], got[500 + i]["spans"]) == ("und", 0.0, [])
    text = rows[-2][1]
    spans = [(s["lang"], text[s["start"] : s["start"] + s["length"]]) for s in got[700]["spans"]]
    assert [lang for lang, _ in spans] == ["en", "el", "en"] and spans[1][1].startswith("είναι") and spans[2][1] == "this was the one"
    kept = language.keep_identified(docs, F.col("doc_id") < 500)
    assert kept.columns == docs.columns
    assert language.identify(docs.limit(0), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(False)).collect()} == {"und"}


def brute_path(scores, switch):
    import itertools

    def value(path):
        return sum(scores[t][k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))

    return max(value(p) for p in itertools.product(range(scores.shape[1]), repeat=len(scores))), value


def test_paths_are_best():
    rng = np.random.default_rng(1)
    parts = [-rng.exponential(2.0, size=(int(n), 3)) for n in rng.integers(1, 8, 60)]
    doc = np.repeat(np.arange(0, 120, 2), [len(p) for p in parts])
    path = language.label_words(np.concatenate(parts), doc, 3.0)
    at = 0
    for p in parts:
        best, value = brute_path(p, 3.0)
        assert value(path[at : at + len(p)]) == pytest.approx(best)
        at += len(p)


def test_long_paths_are_best():
    """Against the plain recursion, for texts of several blocks."""
    rng = np.random.default_rng(2)
    for n in (2, 5):
        sizes = np.r_[rng.integers(1, 400, 30), 1, language.BLOCK, language.BLOCK + 1, 2 * language.BLOCK]
        parts = [-rng.exponential(1.0, size=(k, n)) * (1 + 2 * (np.arange(n) != (np.arange(k) // 30 % n)[:, None])) for k in sizes]
        path, at = language.viterbi(np.concatenate(parts), sizes, 4.0), 0
        for p in parts:
            value, own = p[0].copy(), path[at : at + len(p)]
            for row in p[1:]:
                value = np.maximum(value, value.max() - 4.0) + row
            assert p[np.arange(len(p)), own].sum() - 4.0 * (np.diff(own) != 0).sum() == pytest.approx(value.max())
            at += len(p)


def plain_words(text):
    """Words with their letters' triples, one by one."""
    word, out = "", []
    for c in (text or "") + "\0":
        if unicodedata.category(c)[0] in "LM":
            word += c
            continue
        if any(unicodedata.category(x)[0] == "L" for x in word):
            low = " " + "".join(x.lower() if len(x.lower()) == 1 else x for x in word) + " "
            out.append([low[i - 1 : i + 2] for i in range(1, len(low) - 1)])
        word = ""
    return out


def test_against_a_plain_predictor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r["doc_id"], (r["text"] or "")[:700], r["lang"]) for r in docs.collect()] + [(-1, "\u0301", None), (-2, "", None)]
    learnt = [r for r in rows if r[2] is not None and r[0] % 2 == 0]
    counts = {}
    for _, text, lang in learnt:
        for word in plain_words(text):
            for t in word:
                counts.setdefault(lang, {}).setdefault(t, 0)
                counts[lang][t] += 1
    languages = sorted(counts)
    total = {k: sum(c.values()) for k, c in counts.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.col("doc_id") % 2 == 0).collect()}
    same = 0
    for id_, text, _ in rows:
        scores = [[sum(math.log((counts[k].get(t, 0) + 0.5) / (total[k] + 0.5 * language.CELLS)) for t in w) for k in languages] for w in plain_words(text)]
        if not scores:
            assert got[id_] == "und"
            continue
        scores = [[max(s - max(w), -language.MOST) for s in w] for w in scores]
        value, back = list(scores[0]), []
        for w in scores[1:]:
            best = max(range(len(value)), key=value.__getitem__)
            back.append([k if value[k] >= value[best] - language.SWITCH else best for k in range(len(value))])
            value = [max(v, value[best] - language.SWITCH) + s for v, s in zip(value, w, strict=True)]
        path = [max(range(len(value)), key=value.__getitem__)]
        for b in reversed(back):
            path.append(b[path[-1]])
        letters = [0] * len(languages)
        for k, w in zip(reversed(path), plain_words(text), strict=True):
            letters[k] += len(w)
        same += got[id_] == languages[letters.index(max(letters))]
    # Triples share cells by hash, which can turn a close call.
    assert same >= 0.99 * sum(bool(plain_words(t)) for _, t, _ in rows)


def small_model():
    rng = np.random.default_rng(3)
    return language.Model(["a", "b", "c"], rng.normal(-9, 1.5, (language.CELLS, 3)).astype(np.float32), np.ones((len(language._NAMES), 3), bool))


@pytest.mark.parametrize("most", [3, 50, 1000])
def test_pieces_of_a_long_text(most):
    rng, model = np.random.default_rng(4), small_model()
    text = "".join(rng.choice(list("abcdéж \u0301. "), 6000)) + "x" * 700 + " \u0301\u0301 " + "y" * 40
    lang, score, spans = language._labelled(model, [text], True)
    got = language._labelled_long(model, text, True, most)
    assert got[0] == lang and got[1] == pytest.approx(score) and got[2] == spans and len(spans[0]) > 3
    for odd in ("", "\u0301" * 500, "x" * 500, " " * 500, "x" + "\u0301" * 500):
        assert language._labelled_long(model, odd, True, most)[0] == language._labelled(model, [odd], True)[0]


def test_memory_for_a_long_text():
    model, text = small_model(), "the cat sat on a mat, et la souris " * 300_000  # 10 M code points
    language.words_of(["x"])
    tracemalloc.start()
    language._labelled_long(model, text, False, language._size(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6

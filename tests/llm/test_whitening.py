import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmart.llm import whitening as W
from postmart.llm.queries import op11_whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, k=8):
    """(deviation, whitened up to sign, explained) by a plain eigendecomposition of the covariance."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array(x, float) - np.array(sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    return deviation, centred @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def rows(spark, vectors):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>")


def compared(got, vectors):
    deviation, white, explained = brute(vectors)
    k = white.shape[1]
    table = {(r["vec_id"], r["component"]): r for r in got}
    ids = sorted({i for i, _ in table})
    assert len(table) == len(got) == len(vectors) * k and len(ids) == len(vectors)
    for c in range(k):
        mine = np.array([table[i, c + 1]["whitened"] for i in ids])
        assert np.abs(mine * np.sign(mine @ white[:, c]) - white[:, c]).max() < 1e-9
        assert table[ids[0], c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
    for i, d in zip(ids, deviation, strict=True):
        assert {r["deviation"] for r in (table[i, c + 1] for c in range(k))} == {d}
    assert {(r["n"], r["identity_error"] < 1e-9) for r in got} == {(len(vectors), True)}


def test_whole_table(spark):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    compared(op11_whitening(spark, SF).collect(), vectors)


def test_few_dimensions_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    vectors = [list(v) for v in rng.normal(size=(300, 5)) * [5, 3, 2, 1, 0.5]] + [[1.0, 2.0, 3.0, 4.0, 5.0]] * 150
    compared(W.whiten(rows(spark, vectors).repartition(9)).collect(), vectors)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    good = [list(v) for v in rng.normal(size=(40, 3))]
    bad = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [-float("inf"), 0.0, 0.0], [1.0, 2.0]]
    df = rows(spark, good + bad).selectExpr("*", "1 AS id", "2 AS x", "'c' AS component", "3 AS n")
    compared(W.whiten(df).collect(), good)
    twice = W.whiten(df.unionByName(df).selectExpr("CAST(NULL AS bigint) AS vec_id", "embedding")).collect()
    assert len(twice) == 240 and {r["vec_id"] for r in twice} == {None} and {r["n"] for r in twice} == {80}


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 50):
        assert W.whiten(rows(spark, vectors)).count() == 0
    # One direction of variance only.
    got = W.whiten(rows(spark, [[float(i), 7.0, 7.0] for i in range(10)])).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def test_huge_entries(spark):
    got = W.whiten(rows(spark, [[1e300, 0.0], [-1e300, 1.0], [0.5, 0.25]])).collect()
    assert len(got) >= 3 and {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


def test_many_tasks_add_up_in_groups(spark, monkeypatch):
    monkeypatch.setattr(W, "FEW_TASKS", 3)
    rng = np.random.default_rng(5)
    vectors = [list(v) for v in rng.normal(size=(200, 40))]
    compared(W.whiten(rows(spark, vectors).repartition(10)).collect(), vectors)


@pytest.mark.parametrize("values", [np.r_[9.0, 9.0, 9.0, np.linspace(5, 1, 57)], np.r_[np.ones(8) * 4, np.ones(52)], 0.5 ** np.arange(60), np.ones(60), np.zeros(60)])
def test_components_of_hard_spectra(values):
    rng = np.random.default_rng(6)
    basis = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    v = basis * values @ basis.T
    found, q = W.components(lambda m: v @ m, 60, 8)
    assert found[:8] == pytest.approx(np.sort(values)[::-1][:8], abs=1e-12 * max(values[0], 1))
    assert np.abs(v @ q[:, :8] - q[:, :8] * found[:8]).max() < 1e-11 * max(values[0], 1)
    assert q.T @ q == pytest.approx(np.eye(q.shape[1]), abs=1e-12)

"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postmart.llm.common import Scratch, text_or_empty

#: Labelled rows that are learnt from at most; beyond it a hash of the id chooses about that many.
SAMPLE = 200_000
#: Number of random features, width of the kernel in standardised statistics, weight of the ridge.
FEATURES, WIDTH, RIDGE = 256, 4.0, 1e-3
#: Tasks that sum the equations: the driver adds as many small matrices.
PARTS = 16
#: Bins of raw scores that the calibration is fitted on.
BINS = 400

_KINDS = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 2, "Lm": 2, "Nd": 3, "Zs": 4, "Cc": 5}
N_STATS = 26


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Class of each code point: upper, lower, other letter, digit, space, control, punctuation, symbol, other."""
    start = {"P": 6, "S": 7}
    categories = (unicodedata.category(chr(i)) for i in range(0x110000))
    return np.fromiter((_KINDS.get(c, start.get(c[0], 8)) for c in categories), np.uint8, 0x110000)


def statistics(text: str) -> list[float]:
    """Numbers about the form of a text, none of them about what it says.  Every one is defined for any text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    upper, lower, other, digit, space, control, punctuation, symbol, rest = np.bincount(_kinds()[points], minlength=9).tolist()
    chars, letters = max(1, len(points)), max(1, upper + lower + other)
    words, lines = text.split(), text.split("\n")
    n, counts = max(1, len(words)), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    pairs = len(words) - 1
    return [
        np.log1p(len(points)), np.log1p(len(words)), lengths.mean(), lengths.std(),
        letters / chars, upper / letters, digit / chars, space / chars, control / chars, punctuation / chars, symbol / chars, rest / chars, other / letters,
        text.count(".") / n, text.count(",") / n, text.count("!") / n, text.count("|") / n, text.count("?") / n,
        len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 1.0,  # noqa: B905
        len(set(lines)) / len(lines), np.log1p(len(points) / len(lines)),
        sum(map(str.istitle, words)) / n, sum(map(str.isalpha, words)) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(stats, pa.list_(pa.float32()))], ["id", "stats"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated values there

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score.  Where the calibration is level the raw score still orders, with a weight of 1 %."""
        raw = self.raw(stats)
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten(), np.float64).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, terms) -> tuple[np.ndarray, ...] | None:
    """Sum over all rows of ``terms(stats, label)``: each task adds up its own, the driver adds ``PARTS`` results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = terms(_matrix(batch), batch.column("label").to_numpy().astype(float))
                total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[np.asarray(x, "<f8").tobytes() for x in total]], pa.list_(pa.binary()))})

    parts = rows.coalesce(PARTS).mapInArrow(run, "sums array<binary>").collect()
    if not parts:
        return None
    return tuple(sum(np.frombuffer(p[0][i], "<f8") for p in parts) for i in range(len(parts[0][0])))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (middle of each pool, its level), for x in ascending order."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    pooled = np.array(pools)
    return pooled[:, 0] / pooled[:, 2], pooled[:, 1] / pooled[:, 2]


def fit(stats: DataFrame, labels: DataFrame, learn: Column, seed: int = 0) -> Model | None:
    """Model from ``stats`` (id, stats) and ``labels`` (id, label 0 or 1), from rows with ``learn`` only; None
    without such rows.  A quarter of them, by hash of the id, is kept back for the calibration."""
    scratch = Scratch(stats.sparkSession, "quality")
    usable = labels.where(F.col("label").isin(0, 1) & F.coalesce(learn, F.lit(False)))
    share = min(1.0, SAMPLE / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20))
    rows = scratch.store(stats.join(usable.where(drawn < int(share * (1 << 20)) + 1), "id").select("id", "stats", F.col("label").cast("int")), "train")
    moments = _summed(rows, lambda x, y: [np.array([len(x)]), x.sum(0), (x * x).sum(0)])
    if moments is None:
        return None
    n, total, squares = moments
    mean = total / n
    rng = np.random.default_rng(seed)
    model = Model(
        mean, np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-6,
        rng.normal(size=(len(mean), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1),
        np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    kept_back = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) == 0

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.map(x)
        return [z.T @ z, z.T @ y, np.array([len(z)])]

    sums = _summed(rows.where(~kept_back), equations) or _summed(rows, equations)
    d = FEATURES + 1
    a = sums[0].reshape(d, d) + RIDGE * sums[2][0] * np.diag([1.0] * FEATURES + [1e-9])
    model.weights = np.linalg.solve(a, sums[1])
    fitted = model

    def bins(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        at = np.clip((fitted.raw(x) + 1) / 3 * BINS, 0, BINS - 1).astype(int)
        raw = np.clip(fitted.raw(x), -1, 2)
        return [np.bincount(at, w, BINS) for w in (None, y, raw)]

    count, ones, raw = _summed(rows.where(kept_back), bins) or _summed(rows, bins)
    full = count > 0
    model.knots, model.levels = isotonic(raw[full] / count[full], ones[full] / count[full], count[full])
    return model


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(id, score, predicted) of each row of ``docs``; ``learn`` is a condition on the labels' column ``id``.

    A score depends on the text alone.  The model is a matrix of fixed size and is sent with the tasks.

    NULL and empty texts are scored as texts without characters.  Labels other than 0 and 1, and labels without
    a document, are not learnt from; an id with several labels or rows counts with each.  Without any label
    every score is 0.5.  Repeated rows give repeated results, an empty table none; further columns are ignored."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.store(document_statistics(docs, id_col, text_col), "stats")
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"))
    model = fit(stats, known, learn)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype("i4"))], ["id", "score", "predicted"])

    return stats.mapInArrow(run, "id bigint, score double, predicted int").withColumnRenamed("id", id_col)

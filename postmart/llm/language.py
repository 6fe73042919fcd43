"""Language identification: scripts narrow the candidates, Viterbi over words labels spans of mixed texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Labelled documents that are learnt from at most; beyond it a hash of the id chooses about that many.
SAMPLE = 50_000
#: Languages that a model knows at most: those with most labelled documents.
LANGUAGES = 256
#: Letter triples are counted in so many cells for each language.
CELLS = 1 << 16
#: Code points that are worked on at once, for up to eight languages; fewer for more.
PIECE = 1 << 20
#: Words of a block, within which paths from every language to every other are found for all blocks at once.
BLOCK = 64
#: What a change of language costs, and what one word can weigh, in nats.
SWITCH, MOST = 9.0, 12.0

# First and last code point of script blocks.  0 stands for every other letter.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
]
_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def _points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(is letter or mark, is letter, lower case, script) of each code point."""
    n = 0x110000
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(n)])
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(n)), np.uint32, n)
    script = np.zeros(n, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = _NAMES.index(name)
    return np.isin(kinds, ["L", "M"]), kinds == "L", lower, script


@dataclass
class Words:
    """Words of some texts: runs of letters and marks with at least one letter."""

    cells: np.ndarray  # of each letter with its neighbours
    begin: np.ndarray  # first letter of each word
    script: np.ndarray  # of each word
    doc: np.ndarray  # of each word
    place: np.ndarray  # first code point of each word in its text
    letters: np.ndarray  # of each word
    proper: np.ndarray  # whether a word has a letter

    def kept(self) -> Words:
        """Without runs of nothing but marks."""
        if self.proper.all():
            return self
        k = self.proper
        cells, letters = self.cells[np.repeat(k, self.letters)], self.letters[k]
        return Words(cells, np.cumsum(letters) - letters, self.script[k], self.doc[k], self.place[k], letters, k[k])


def words_of(texts: list[str], before: str = "\0", after: str = "\0") -> Words:
    """``before`` and ``after``: what stands around the texts, for a piece of a longer one."""
    known, letter, lower, script = _points()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer((before + "\0".join(texts) + after).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = known[points]
    at = np.flatnonzero(is_letter[1:-1]) + 1
    low = np.where(is_letter, lower[points], 32).astype(np.uint64)
    mixed = low[at - 1] * np.uint64(0x9E3779B97F4A7C15) + low[at] * np.uint64(0xC2B2AE3D27D4EB4F) + low[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(31)
    cells = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)
    begin = np.flatnonzero(~is_letter[at - 1] | (at == 1))
    first = at[begin]
    starts = np.cumsum(sizes + 1) - sizes
    doc = np.searchsorted(starts, first, side="right") - 1
    letters = np.diff(np.r_[begin, len(at)])
    proper = np.add.reduceat(letter[points[at]], begin, dtype=np.int64) > 0 if len(begin) else np.zeros(0, bool)
    return Words(cells, begin, script[points[first]], doc, first - starts[doc] if len(doc) else first, letters, proper)


def _size(languages: int) -> int:
    return max(1, PIECE * 8 // max(8, languages))


def pieces_of(text: str, most: int) -> Iterator[tuple[int, str, bool, bool]]:
    """(start, piece, goes on with the word before it, its last word goes on) of a long text, cut between words
    where there is a place within the last tenth of a piece."""
    known = _points()[0]
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        for back in range(end, max(at, end - max(1, most // 10)), -1):
            if end == len(text) or not known[ord(text[back - 1])]:
                end = back
                break
        joined = at > 0 and bool(known[ord(text[at - 1])] and known[ord(text[at])])
        yield at, text[at:end], joined, end < len(text) and bool(known[ord(text[end - 1])] and known[ord(text[end])])
        at = end


def grouped(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) of consecutive texts of about ``most`` bytes at most; a longer one is alone."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield begin, [t or "" for t in column.slice(begin, i - begin).to_pylist()]
            begin, held = i, 0
        held += n + 1
    if begin < len(sizes):
        yield begin, [t or "" for t in column.slice(begin).to_pylist()]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # cells x languages, log probabilities
    fits: np.ndarray  # scripts x languages

    def sums(self, words: Words) -> np.ndarray:
        """Words x languages, of all letters."""
        n, step = len(words.begin), max(1, 4_000_000 // max(1, len(self.languages)))
        out, stops, at = np.zeros((n, len(self.languages))), np.cumsum(words.letters), 0
        while at < n:
            # As many words as have about ``step`` letters; at least one.
            end = max(at + 1, int(np.searchsorted(stops, words.begin[at] + step, side="right")))
            part = self.table[words.cells[words.begin[at] : stops[end - 1]]]
            np.add.reduceat(part, words.begin[at:end] - words.begin[at], axis=0, dtype=float, out=out[at:end])
            at = end
        return out

    def settled(self, s: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Scores, 0 for the best of a word.  A language that is not written in a word's script stays behind by
        ``MOST``; a script that no language is known in excludes none."""
        if not len(s):
            return s
        fits = self.fits[script]
        s = np.where(~fits & fits.any(axis=1, keepdims=True), -np.inf, s)
        return np.maximum(s - s.max(axis=1, keepdims=True), -MOST)

    def scores(self, words: Words) -> np.ndarray:
        return self.settled(self.sums(words), words.script)


def learn(docs: DataFrame, sample: Column, id_col: str, text_col: str, lang_col: str) -> Model:
    """Counts of letter triples and of scripts for each language.  Tasks count for themselves, Spark adds up, and
    the driver gets at most ``CELLS`` numbers for each of at most ``LANGUAGES`` languages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def count(words: Words, langs: list[str]) -> None:
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs])[words.doc] if len(words.doc) else words.doc
            for k, name in enumerate(names):
                mine = own == k
                cells = np.bincount(words.cells[np.repeat(mine, words.letters)], minlength=CELLS)
                scripts = np.bincount(words.script[mine], minlength=len(_NAMES))
                counts[name] = counts.get(name, 0) + np.r_[cells, scripts]

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in grouped(batch.column("text"), PIECE):
                if len(texts) > 1 or len(texts[0]) <= PIECE:
                    count(words_of(texts).kept(), langs[at : at + len(texts)])
                    continue
                for start, piece, _, _ in pieces_of(texts[0], PIECE):
                    around = texts[0][start - 1] if start else "\0", texts[0][start + len(piece) :][:1] or "\0"
                    count(words_of([piece], *around).kept(), [langs[at]])
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "cell": pa.array(at, pa.int64()), "n": pa.array(c[at], pa.int64())})

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & sample)
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    share = min(1.0, SAMPLE / max(1, sum(r["count"] for r in sizes)))
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col("id")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    rows = known.where(F.col("lang").isin(languages) & drawn).select("lang", "text")
    sums = rows.mapInArrow(run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((CELLS + len(_NAMES), len(languages)))
    where = {x: k for k, x in enumerate(languages)}
    counts[sums.column("cell").to_numpy(), [where[x] for x in names]] = sums.column("n").to_numpy()
    cells, scripts = counts[:CELLS], counts[CELLS:]
    table = np.log((cells + 0.5) / (cells.sum(axis=0) + 0.5 * CELLS)).astype(np.float32)
    return Model(languages, table, scripts > 0.01 * scripts.sum(axis=0))


def blocks_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of so many words as blocks: (first word, words of each block; blocks of each text)."""
    per = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(sizes) - sizes)[of] + k * BLOCK, np.minimum(BLOCK, sizes[of] - k * BLOCK), per


def transfers(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best value of a path through each block, from each language before it to each at its end: a step for each
    position, for all blocks at once."""
    order, n = np.argsort(-sizes, kind="stable"), scores.shape[1]
    value = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)[None].repeat(len(sizes), axis=0)
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    for t, m in enumerate(live.tolist()):
        v = value[:m]
        value[:m] = np.maximum(v, v.max(axis=2, keepdims=True) - switch) + scores[first[order[:m]] + t][:, None, :]
    out = np.empty_like(value)
    out[order] = value
    return out


def chained(moves: np.ndarray, per: np.ndarray, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best value of each text's path by its last language; best language before each block by that at its end)."""
    begin, order = np.cumsum(per) - per, np.argsort(-per, kind="stable")
    value = np.zeros((len(per), moves.shape[1])) if value is None else value.copy()
    came = np.empty(moves.shape[:2], np.int16)
    live = np.searchsorted(-per[order], -np.arange(per.max(initial=0)), side="left")
    for k, m in enumerate(live.tolist()):
        text = order[:m]
        all_ = value[text][:, :, None] + moves[begin[text] + k]
        came[begin[text] + k] = all_.argmax(axis=1)
        value[text] = all_.max(axis=1)
    return value, came


def ends_of(last: np.ndarray, came: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language before, language at the end) of each block on its text's best path."""
    begin, order, now = np.cumsum(per) - per, np.argsort(-per, kind="stable"), last.copy()
    before, after = np.empty(len(came), np.int64), np.empty(len(came), np.int64)
    live = np.searchsorted(-per[order], -np.arange(per.max(initial=0)), side="left")
    for k in range(len(live) - 1, -1, -1):
        text = order[: live[k]]
        at = begin[text] + k
        after[at] = now[text]
        before[at] = now[text] = came[at, now[text]]
    return before, after


def paths(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on the best path through each block with known ends."""
    order, n = np.argsort(-sizes, kind="stable"), scores.shape[1]
    first, sizes, own = first[order], sizes[order], np.arange(n)
    value = np.full((len(sizes), n), -np.inf)
    value[np.arange(len(sizes)), before[order]] = 0
    live = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left").tolist()
    back = []
    for t, m in enumerate(live):
        v = value[:m]
        best = v.argmax(axis=1)
        change = v[np.arange(m), best][:, None] - switch
        stay = v >= change
        back.append(np.where(stay, own, best[:, None]).astype(np.int16))
        value[:m] = np.where(stay, v, change) + scores[first[:m] + t]
    path, now = np.empty(len(scores), np.int64), after[order].astype(np.int64)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        path[first[:m] + t] = now[:m]
        now[:m] = back[t][np.arange(m), now[:m]]
    return path


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best path of each of some texts of so many words.  Blocks are independent once it is known what each costs
    from language to language; a chain over a text's blocks, a step for all texts, then chooses their ends."""
    first, words, per = blocks_of(sizes)
    value, came = chained(transfers(scores, first, words, switch), per)
    return paths(scores, first, words, *ends_of(value.argmax(axis=1), came, per), switch)


def label_words(scores: np.ndarray, doc: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word of many texts, by the best path of each.

    Most texts are in one language.  Let b be the best language of a whole text.  If no stretch of words gains half
    the switching penalty by another language, no path beats b throughout: a path of n stretches away from b
    gains less than n halves and changes n times, or n - 1 times (n > 1) if it is never in b.  That is tested
    for all texts at once, and only the others are walked through."""
    if not len(doc):
        return doc
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    text = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    path = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)[text]
    mixed = np.zeros(len(starts), bool)
    apart = 1e5 + 2 * float(np.abs(scores).sum(axis=0).max())
    own = scores[np.arange(len(path)), path]
    for k in range(scores.shape[1]):
        gain = np.cumsum(scores[:, k] - own)
        before = np.r_[0.0, gain[:-1]] - apart * text  # lower for each later text, so that minima stay inside
        rise = gain - (np.minimum.accumulate(before) + apart * text)
        mixed |= np.maximum.reduceat(rise, starts) >= switch / 2 - 1e-3
    if mixed.any():
        sizes = np.diff(np.r_[starts, len(doc)])
        walked = mixed[text]
        path[walked] = viterbi(scores[walked], sizes[mixed], switch)
    return path


def _verdicts(letters: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language of most letters, score) of texts.  ``total``: scores of the words in that language."""
    pred = letters.argmax(axis=1)
    lead = total[np.arange(len(pred)), pred][:, None] - total
    posterior = 1 / np.exp(-np.minimum(lead, 50)).sum(axis=1)
    share = letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1)
    return pred, np.where(letters.sum(axis=1) > 0, share * posterior, 0.0)


def _labelled(model: Model, texts: list[str], spans: bool):
    """(language, score, spans) of each text."""
    words, n = words_of(texts).kept(), len(model.languages)
    scores = model.scores(words)
    path = label_words(scores, words.doc)
    letters = np.zeros((len(texts), n))
    np.add.at(letters, (words.doc, path), words.letters)
    mine = path == letters.argmax(axis=1)[words.doc]
    total = np.zeros((len(texts), n))
    np.add.at(total, words.doc[mine], scores[mine])
    pred, score = _verdicts(letters, total)
    found: list[list[dict]] = [[] for _ in texts]
    if spans and len(path):
        cut = np.flatnonzero(np.r_[True, (words.doc[1:] != words.doc[:-1]) | (path[1:] != path[:-1])])
        for a, b in zip(cut, np.r_[cut[1:], len(path)] - 1, strict=True):
            found[words.doc[a]].append({"start": int(words.place[a]), "length": int(words.place[b] + words.letters[b] - words.place[a]), "lang": model.languages[path[a]]})
    some = letters.sum(axis=1) > 0
    return [model.languages[p] if s else "und" for p, s in zip(pred, some, strict=True)], score, found


def _streamed(model: Model, text: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, place, letters) of the words of a long text, piece by piece; a word over several pieces comes whole."""
    held: list[np.ndarray] | None = None
    for start, piece, joined, goes_on in pieces_of(text, most):
        w = words_of([piece], text[start - 1] if start else "\0", text[start + len(piece) :][:1] or "\0")
        now = [model.sums(w), w.script, w.place + start, w.letters, w.proper]
        if held is not None:
            if joined and len(w.begin):
                now[0][0] += held[0][0]
                now[3][0] += held[3][0]
                now[4][0] |= held[4][0]
                now[1][0], now[2][0] = held[1][0], held[2][0]
            else:
                now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
            held = None
        if goes_on and len(now[3]):
            held, now = [x[-1:].copy() for x in now], [x[:-1] for x in now]
        sums, script, place, letters, proper = now
        yield model.settled(sums[proper], script[proper]), place[proper], letters[proper]
    if held is not None and held[4][0]:
        yield model.settled(held[0], held[1]), held[2], held[3]


def _labelled_long(model: Model, text: str, spans: bool, most: int, switch: float = SWITCH):
    """As ``_labelled``, for one text in pieces.  The first pass carries the value of the best path to each language
    from piece to piece and keeps, for each block, where the path came from; the second one labels the words."""
    n = len(model.languages)
    value, came = np.zeros((1, n)), []
    for scores, _, _ in _streamed(model, text, most):
        first, sizes, blocks = blocks_of(np.array([len(scores)]))
        value, c = chained(transfers(scores, first, sizes, switch), blocks, value)
        came.append(c)
    last, ends = value.argmax(axis=1), []
    for c in reversed(came):
        before, after = ends_of(last, c, np.array([len(c)]))
        ends.append((before, after))
        last = before[:1] if len(before) else last
    letters, total = np.zeros(n), np.zeros((n, n))
    found: list[dict] = []
    for (scores, place, sizes), (before, after) in zip(_streamed(model, text, most), reversed(ends), strict=True):
        if not len(scores):
            continue
        first, words, _ = blocks_of(np.array([len(scores)]))
        path = paths(scores, first, words, before, after, switch)
        np.add.at(letters, path, sizes)
        np.add.at(total, path, scores)
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if spans else []
        for a, b in zip(cut, np.r_[cut[1:], len(path)] - 1, strict=True) if spans else ():
            lang, end = model.languages[path[a]], int(place[b] + sizes[b])
            if found and found[-1]["lang"] == lang:
                found[-1]["length"] = end - found[-1]["start"]
            else:
                found.append({"start": int(place[a]), "length": end - int(place[a]), "lang": lang})
    pred, score = _verdicts(letters[None], total[letters.argmax()][None])
    return [model.languages[pred[0]] if letters.any() else "und"], score, [found]


def identify(
    docs: DataFrame,
    sample: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    with_spans: bool = False,
    keep: bool = False,
) -> DataFrame:
    """(id, ``lang_pred``, ``score``) of each row of ``docs``, ``spans`` (start and length in code points, language)
    if asked for; with ``keep`` all columns of ``docs`` in a struct ``row`` instead of the id.

    Learnt from text and language of rows with ``sample``; a prediction depends on the text alone.  The
    prediction is the language of most letters; the score is its share of them times its posterior over its own
    spans.  The model has a fixed size for each language and is broadcast.

    Texts that are NULL or have no letter (marks alone are none) are ``und`` with score 0, and so is every text if
    nothing could be learnt.  Rows without a language are not learnt from; repeated rows give repeated results; an empty
    table gives none; further columns are ignored.  Whole texts count, however long: texts are worked on in
    groups, and a long one in pieces, of about ``PIECE`` code points, which bounds a task's memory."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, sample, id_col, text_col, lang_col))
    head = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]) if keep else F.col(id_col).cast("bigint")
    name = "row" if keep else "id"
    rows = docs.select(head.alias(name), *([] if keep else [F.coalesce(F.col(text_col), F.lit("")).alias("text")]))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        most = _size(len(known.languages))
        for batch in batches:
            column = batch.column(0).field(text_at) if keep else batch.column("text")
            for at, part in grouped(column, most):
                if not known.languages:
                    lang, score, spans = ["und"] * len(part), np.zeros(len(part)), [[]] * len(part)
                elif len(part) == 1 and len(part[0]) > most:
                    lang, score, spans = _labelled_long(known, part[0], with_spans, most)
                else:
                    lang, score, spans = _labelled(known, part, with_spans)
                arrays = [batch.column(0).slice(at, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if with_spans:
                    arrays.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(arrays, [name, "lang_pred", "score", "spans"][: len(arrays)])

    schema = T.StructType([rows.schema[name], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if with_spans:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("lang", T.StringType())])
        schema = schema.add("spans", T.ArrayType(span))
    out = rows.mapInArrow(run, schema)
    return out if keep else out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, sample: Column, least: float = 0.5, **names) -> DataFrame:
    """Rows of ``docs``, unchanged, whose language is known with a score of ``least`` or more."""
    labelled = identify(docs, sample, keep=True, **names).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return labelled.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

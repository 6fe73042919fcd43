import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postmart.llm import token_alignment as A, tokens
from postmart.llm.queries import op12_alignment

SF = "/root/testdata/sf0.001"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "a\nb", "a \n b", "\t\tx  y", "<|endoftext|> x <|endoftext|>", "<s> </s> <unk> <0x41>", "▁", "a▁b", "é" * 3000,
    "\x00\x01", "日本語のテキスト と english", "👩‍👩‍👧 ok ☃ x", "a b   c", "don't we'll I'M", "x\x1c y", "é ́a", "ﬁ ligature ①", "1234567 89,0.1", "İ ß ſ", "​ ﻿",
    "word " * 400, "a  b   c    d", "tab\t x\t\ty", "if (x):\n    return  {\n\t'a': 1}\n", "a\u0085b c", "\r\n a\r\nb", "a 　b", "   lead", "trail   ",
]


def brute(docs):
    """By whole texts, sets and every pair of tokens."""
    first, second = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    first.encode_special_tokens = True
    a_bytes, b_bytes = tokens.byte_level(BYTE)[0], tokens.piece_bytes(second)
    rows, seen = [], Counter()
    for id_, text in docs:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, known in ((a, a_bytes), (b, b_bytes)):
            ends = np.cumsum([len(known[i]) for i in ids]).tolist()
            spans.append(list(zip(ids, ([0, *ends])[: len(ids)], ends, strict=True)))
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        group = lambda side, lo, hi: ",".join(str(i) for i, _, e in side if lo < e <= hi)
        text_ = ";".join(f"{group(spans[0], lo, hi)}|{group(spans[1], lo, hi)}" for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)) if cuts else ""
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        seen.update(set(links))
        rows.append((id_, len(a), len(b), len(cuts), links, text_))
    top = Counter()
    for (i, _), n in seen.items():
        top[i] = max(top[i], n)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return sorted([(id_, na, nb, g, len(k), sum(seen[p] == top[p[0]] for p in k), sum(seen[p] for p in k), digest(t), t) for id_, na, nb, g, k, t in rows], key=repr)


def texts():
    rng = np.random.default_rng(1)
    letters = ["the", "ing", "ción", "x", " ", "  ", "\n", "é", "日", "9", "'s", "\t", ".", "Ünter", "▁"]
    p = np.array([6, 6, 4, 4, 12, 0.3, 1, 2, 1, 2, 1, 0.3, 2, 1, 0.05])
    made = ["".join(rng.choice(letters, int(rng.integers(1, 60)), p=p / p.sum())) for _ in range(60)]
    return [*ODD, *made, made[0], made[0]]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs = [(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS chunk", "3 AS pair").repartition(3)
    want = brute(docs)
    assert sum(r[1] > 0 for r in want) > 50 and sum(r[1] == 0 for r in want) > 5
    assert result(A.align_documents(df, BYTE, PIECE, keep_groups=True)) == want
    assert A.align_documents(df.limit(0), BYTE, PIECE).count() == 0


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 1500]
    got = result(A.align_documents(spark.createDataFrame(short, "doc_id bigint, text string"), BYTE, PIECE, keep_groups=True))
    assert got == brute(short)
    whole = op12_alignment(spark, SF).collect()
    assert len(whole) == len(docs)
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"] <= r["count_sum"] for r in whole)


@pytest.mark.parametrize("part", [1, 40, 1 << 20])
def test_parts_and_chunks(monkeypatch, part):
    monkeypatch.setattr(A, "PART", part)
    docs = list(enumerate(texts()))
    chunk = A._Chunk(tokens.pair_encoder(BYTE, PIECE), True)
    for id_, text in docs:
        chunk.add(id_, text or "")
    row = chunk.row(0)
    got = sorted(zip(row["ids"], row["n_a"].tolist(), row["n_b"].tolist(), row["n_groups"].tolist(), row["n_links"].tolist(), row["sha"], row["groups"], strict=True), key=repr)
    assert got == sorted(((*r[:5], r[7], r[8]) for r in brute(docs)), key=repr)
    assert int(row["n"].sum()) == int(row["owners"].sum()) and len(set(row["pairs"].tolist())) == len(row["pairs"])
    assert not chunk.docs


def test_units_encode_as_whole_texts():
    second = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert tokens.cuts_at_spaces(second) and tokens.byte_level(BYTE)[1] is not None
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    encode = tokens.byte_encoder(BYTE)
    for t in texts():
        if t:
            units = tokens.CUT.split(t)
            assert [i for u in units for i in encode(" " + u)] == first.encode(" " + t, add_special_tokens=False).ids
            assert [i for u in units for i in second.encode(u)] == second.encode(t)


def test_a_model_that_is_not_plain(tmp_path):
    import json

    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "turned.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert tokens.byte_level(str(path))[1] is None
    own = Tokenizer.from_file(str(path))
    own.encode_special_tokens = True
    assert tokens.byte_encoder(str(path))("the thing <|endoftext|>") == own.encode("the thing <|endoftext|>", add_special_tokens=False).ids


def test_gallop():
    rng = np.random.default_rng(4)
    for _ in range(300):
        longer = np.unique(rng.integers(0, 200, int(rng.integers(1, 50))))
        ends = np.sort(rng.integers(0, longer[-1] + 1, int(rng.integers(0, 20))))
        hint = rng.integers(0, len(longer), len(ends))
        assert A.gallop(ends, longer, hint).tolist() == np.searchsorted(longer, ends).tolist()

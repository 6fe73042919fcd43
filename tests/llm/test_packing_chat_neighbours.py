import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmart.llm import chat_format, neighbours, packing
from postmart.llm.common import Scratch
from postmart.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


AWKWARD = [
    "", " ", "  two  spaces", " leading", "trailing ", "a \n b", "a\n b", "tab\there", "x  y", "x  y", "it's we'll  I'd",
    "Ünïcode ☃\U0001f600 words", "<|endoftext|>", "a <|endoftext|> b", "1234 5.6", "ends with newline\n\n", "\r\n", "é   z", "!!! ??? ...",
    " 's 'll", "x" * 70 + " y", "\x1c \x1d", "a\x00 b",
]


def test_ids_are_those_of_the_tokenizer(whole):
    encode = packing.encoder(tokenizer_path())
    for text in [*AWKWARD, *AWKWARD, " ".join(AWKWARD)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_on_the_given_table(spark, whole):
    encode = packing.encoder(tokenizer_path())
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(encode(row[0]), "<u4").tolist() == whole.encode(row[0], add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 9, 10, 11, 20, 21, 39])
def test_cut(n):
    parts = packing.cut(n, 10)
    assert sum(length for _, length in parts) == n and all(length <= 10 for _, length in parts)
    assert [s for s, _ in parts] == [sum(length for _, length in parts[:i]) for i in range(len(parts))]
    assert len(parts) == math.ceil(n / 10) and all(length == 10 for _, length in parts[1:])


def test_packed_pieces(spark, whole):
    rng = np.random.default_rng(0)
    texts = [*AWKWARD, None, *(" ".join(["word"] * int(n)) for n in rng.integers(1, 90, 300)), "long " * 3000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5])]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS item", "2 AS seq", "3 AS length").repartition(5)
    got = packing.pack_documents(frame, tokenizer_path(), capacity=64, keep_ids=True).cache()
    pieces = got.collect()
    want = Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[(i, piece, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in pieces)
    assert len(by) <= 1.05 * total / 64 + 1
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    for r in pieces:
        assert joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack_documents(frame.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("kind", ["short", "middle", "mixed"])
def test_as_few_sequences_as_best_fit(spark, kind):
    rng = np.random.default_rng(1)
    sizes = {"short": rng.integers(1, 30, 3000), "middle": rng.integers(300, 700, 1500), "mixed": np.r_[rng.integers(1, 2048, 700), np.full(500, 700)]}[kind]
    frame = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "item bigint, length bigint").repartition(4)
    got = packing.assign(frame, 2048, Scratch(spark, "test")).collect()
    assert Counter((r["item"], r["length"]) for r in got) == Counter((i, int(n)) for i, n in enumerate(sizes))
    used = defaultdict(int)
    for r in got:
        used[r["seq"]] += r["length"]
    assert max(used.values()) <= 2048
    room: list[int] = []  # best fit, longest first, one by one
    for n in sorted(sizes.tolist(), reverse=True):
        fits = [g for g in room if g >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 2048) - n)
    assert len(used) <= 1.03 * len(room) + 1


def test_formatted_chats(spark):
    hostile = ["<|turn|>", "<\\|end|>", "<|", "<\\\\|next|>\\", "\\### Assistant: </turn> ok", "", None, "Ünï\U0001f600 ☃", "a\nb", "<<||>>", "$1 \\1"]
    rows, rng = [], np.random.default_rng(2)
    for conv in [*range(25), None]:
        for turn in range(int(rng.integers(1, 14))):
            rows.append((conv, turn, [None, "user", "assistant", "assistant", "<|text|>"][int(rng.integers(5))], hostile[int(rng.integers(len(hostile)))]))
    rows += [(99, None, "assistant", "x"), (99, None, "assistant", "x"), (99, 0, "user", None)]
    rows += [(500, t, ("assistant", "assistant", "user")[t % 3], f"turn {t}") for t in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS conv", "2 AS segment", "3 AS runs")
    chats = chat_format.format_chats(frame).cache()
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    digests = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    assert set(digests) == set(by)
    for row in chats.collect():
        turns = [(r, x) for _, r, x in sorted(by[row["conv_id"]])]
        d = digests[row["conv_id"]]
        assert d["n_turns"] == len(turns)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert (d["loss_chars"], d["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        text, at, masked = row["formatted"], 0, ""
        for run in row["loss_runs"]:
            masked += text[at : at + run["chars"]] if run["loss"] else ""
            at += run["chars"]
        assert at == len(text) == d["formatted_chars"]
        import re

        assert re.sub(r"<\\(\\*)\|", r"<\1|", masked) == learnt
        merged = sum(i == 0 or turns[i - 1][0] != turns[i][0] for i in range(len(turns)))
        assert text.count(chat_format.TURN) == text.count(chat_format.END) == merged
    assert chat_format.digest(chat_format.format_chats(frame.limit(0))).count() == 0


def brute_nearest(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q in {i for i, _ in use if i % 100 == 0}:
        best = {}
        for own, a in use:
            if own == q:
                for i, b in use:
                    if i != q and len(a) == len(b):
                        total = 0.0  # plain additions in order; sum() would correct its rounding
                        for x, y in zip(a.tolist(), b.tolist(), strict=True):
                            total += (x - y) ** 2
                        s = math.sqrt(total)
                        best[i] = min(s, best.get(i, s))
        out |= {(q, r + 1, i, s) for r, (s, i) in enumerate(sorted((s, i) for i, s in best.items())[:k])}
    return out


def test_nearest_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_ROWS", 100)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    f4 = lambda n: [float(np.float32(x)) for x in rng.normal(size=n)]
    rows = [(i, f4(16)) for i in range(700)] + [(1000 + i, f4(7)) for i in range(4)]
    same = f4(16)
    rows += [(2000 + i, same) for i in range(30)] + [(2001, same)] * 15 + [(300, f4(16)), (2100, same)]
    rows += [(100, None), (200, [0.0] * 16), (900, [math.nan] * 16), (901, [math.inf, *f4(15)]), (902, [None, *f4(15)]), (None, f4(16)), (903, []), (904, [1e30] * 16), (905, [1e-30] * 16)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS lane", "3 AS score").repartition(6)
    rows = [(r[0], r[1]) for r in frame.select("vec_id", "embedding").collect()]
    got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_nearest(rows, 10)
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, v = rng.normal(size=(5, 33)) * 10, rng.normal(size=(400, 33)) * np.r_[np.ones(200), np.full(200, 50)][:, None]
    found = dict(neighbours.tile_best(np.arange(5), q, np.arange(5, 405), v, 7))
    for i in range(5):
        d = np.sqrt(((q[i] - v) ** 2).sum(1))
        assert [x for _, x in found[i]] == (np.argsort(d, kind="stable")[:7] + 5).tolist()


def test_the_digest_reads_the_mask(spark):
    text = lambda i: f"text {i} <|end|> é \U0001f600 <\\\\|turn|>" * (i % 5)
    rows = [(1, i, ("user", "assistant", "assistant", "system")[i % 4], text(i)) for i in range(700)] + [(2, 0, "user", "nothing to learn")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    want = "".join(t for _, _, r, t in rows if r == "assistant")
    got = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    assert (got[2]["loss_chars"], got[2]["loss_sha256"], got[1]["n_turns"]) == (0, hashlib.sha256(b"").hexdigest(), 700)
    learnt = chats.where("conv_id = 1").select(chat_format.learnt_texts(F.col("formatted"), F.col("loss_runs"))).first()[0]
    assert learnt == [t for _, _, r, t in rows if r == "assistant" and t]
    shifted = chats.withColumn("loss_runs", F.transform("loss_runs", lambda r, i: F.struct((r["chars"] + F.when(i == 0, 1).otherwise(0)).alias("chars"), r["loss"].alias("loss"))))
    assert chat_format.digest(shifted).where("conv_id = 1").first()["loss_sha256"] != got[1]["loss_sha256"]
    assert "chars" in chat_format.digest(chats)._jdf.queryExecution().optimizedPlan().toString()

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from postmart.llm import exact_dedup, mixing, simhash, url_filter
from postmart.llm.common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS + extra)


AWKWARD = [
    (1, "same"), (5, "same"), (5, "same"), (None, "same"), (2, None), (3, ""), (None, None), (7, " "), (8, "x" * 300_000),
    (9, "x" * 300_000), (10, "x" * 300_000 + "y"), (None, "alone"), (None, "alone"), (11, "Ünïcode ☃\U0001f600"), (12, "a\x00b"),
]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, -(x or 0)))
        for place, i in enumerate(ids):
            out[(i, ids[0], len(ids), place == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_exact_groups_match_brute_force(spark):
    rows = AWKWARD + [(100 + i, f"common beginning of all these texts, which is longer than a splitter {i % 7}") for i in range(500)]
    rows += [(1000 + i, "hot") for i in range(700)]
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(7))
    got = Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_exact(rows)


def test_exact_dedup_returns_whole_rows(spark):
    rows = docs(spark, AWKWARD).selectExpr("*", "1 AS run", "'k' AS keep_id", "array(doc_id) AS row", "'n' AS `__null`", "2 AS id")
    kept = exact_dedup.exact_dedup(rows)
    assert kept.columns == rows.columns and kept.dtypes == rows.dtypes
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter((t or "") for _, t in got) == Counter(set((t or "") for _, t in AWKWARD))
    assert (5, "same") in got and (None, "alone") in got
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0 and exact_dedup.exact_groups(rows.limit(0)).count() == 0


def test_exact_dedup_normalises(spark):
    from pyspark.sql import functions as F

    kept = exact_dedup.exact_dedup(docs(spark, [(1, "A"), (2, "a"), (3, "b")]), normalise=F.lower)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a"), (3, "b")]


def brute_targets(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(1 + i % 3) for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_match_brute_force(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        sizes = {f"s{i}": int(rng.integers(0, 10 ** rng.integers(1, 5))) for i in range(9)} | {None: 40, "": 0, "é": 7}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_rounding_keeps_words_and_expectation():
    sizes, share = np.array([5, 3, 9, 2, 7, 1]), np.full(6, 0.4)
    mean = np.zeros(6)
    for seed in range(4000):
        out, held = mixing.round_group(sizes, share, list(range(6)), seed, False)
        assert (out * sizes).sum() == pytest.approx((share * sizes).sum())
        assert sum(0 < x < 1 for x in out) == (held >= 0) <= 1
        mean += out / 4000
    assert mean == pytest.approx(share, abs=0.04)


def test_mixing_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 16)  # several levels of the tree
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "en", f"s{int(i > 500)}", 1) for i in range(900)]
    rows += [(None, "a b", None, None, None), (None, "a b", None, None, None), (5, None, None, "s0", None), (6, " \t\n", None, "s9", None)]
    frame = docs(spark, rows).selectExpr("*", "1 AS size", "2 AS copies", "3 AS share")
    got = mixing.mix_copies(frame).collect()
    assert len(got) == len(rows)
    again = mixing.mix_copies(frame.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert target == pytest.approx(brute_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 15
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_copies(frame.limit(0)).count() == 0 and mixing.mix(frame.limit(0)).count() == 0


def brute_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, radius=4):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def near_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, 300))
        for k in range(8):
            words = list(base)
            for at in rng.integers(0, 300, k):
                words[at] = str(rng.choice(vocabulary))
            rows.append((n, "  ".join(words).upper() if k % 2 else " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "\n\t"), (None, ""), (n + 3, "one two"), (n + 4, "One\x0btwo"), (n + 3, "one two"), (None, "lonely one")]
    return rows + [(n + 5, "İ É ÀB"), (n + 6, "long " * 50_000)]


def test_near_groups_match_brute_force(spark):
    rows = near_rows()
    got = simhash.near_groups(docs(spark, rows).selectExpr("*", "'x' AS fp", "1 AS component_id", "2 AS mask")).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components(prints)
    least = defaultdict(lambda: None)
    for (i, _), c in zip(rows, comps, strict=True):
        least[c] = i if least[c] is None else least[c] if i is None else min(i, least[c])
    want = Counter((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, comps, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert len(set(comps)) < len(rows) - 20  # near copies are found


def test_near_dedup_keeps_one_of_each(spark):
    rows = near_rows()
    frame = docs(spark, rows).selectExpr("*", "1 AS __x", "'y' AS component_id")
    kept = simhash.near_dedup(frame)
    assert kept.columns == frame.columns
    comps = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, comps, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter(i for (i, _), c in zip(rows, comps, strict=True) if i is None or i == least[c])
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert simhash.near_groups(frame.limit(0)).count() == 0


def test_masks_cover_every_pair():
    rng = np.random.default_rng(4)
    for level in range(4):
        masks = simhash.covering_masks(4, level)
        assert len(masks) == 31 and all(20 <= m.bit_count() <= 44 for m in masks)
        for _ in range(3000):
            diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
            assert any(diff & m == 0 for m in masks)


def test_large_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 100)
    rng = np.random.default_rng(5)
    places = [3, 11, 19, 24, 33, 41, 50, 58, 62]
    base = [int(x) for x in rng.integers(0, 2**62, 2)]
    values = {b ^ sum(1 << p for k, p in enumerate(places) if n >> k & 1) for b in base for n in range(512) if n % 5}
    values = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    scratch = Scratch(spark, "test")
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint").repartition(3), 4, scratch)
    roots = dict(map(tuple, simhash.components(edges, scratch).collect()))
    comps = brute_components([v & (2**64 - 1) for v in values])
    groups = defaultdict(set)
    for v, c in zip(values, comps, strict=True):
        groups[c].add(v)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(x for x in values if roots.get(x, x) == r) for r in {roots.get(v, v) for v in values}
    }


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 103), (102, 103)]
    roots = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()))
    assert {roots.get(i, i) for i in range(61)} == {0} and {roots.get(i, i) for i in range(100, 104)} == {100}


def test_url_parts():
    assert url_filter.split_url("http://A.Example.ORG:80/x/Y?q=/#f") == ("a.example.org:80", "/x/Y")
    assert url_filter.split_url("x://h?p/q://z") == ("h", "") and url_filter.split_url("://") == ("", "")
    assert url_filter.split_url(None) == url_filter.split_url("no scheme/") == ("", "")
    assert url_filter.split_url("http://ÄB.org#a/b") == ("Äb.org", "")


def test_url_rules_against_brute_force(spark):
    rng = np.random.default_rng(6)
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "com", "x.com", "", "org.com", "example.org.", "b..org"]
    paths = ["", "/", "/en/1", "/en/12/3", "/en", "/es/", "/es", "/es/x?", "/fr/", "/de/x", "//", "/en//1"]
    rules = url_filter.RULES + [url_filter.Rule("block", "", "/en//"), url_filter.Rule("block", "a.example.org", ""), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/fr/")]
    rows = [(int(i), f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '#x', '?y/'])}") for i in range(400)]
    rows += [(None, None), (1, "plain"), (1, "plain"), (2, "http://x.com/" + "de/" * 50_000)]
    got = Counter(tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS id", "2 AS host"), rules).collect())
    want = Counter()
    for i, u in rows:
        host, path = url_filter.split_url(u)
        fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
        want[(i, host, path, best and best.host + best.path, best.verdict if best else "allow")] += 1
    assert got == want


def test_long_rule_lists_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), url_filter.RULES)

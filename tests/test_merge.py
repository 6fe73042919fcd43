"""The merge against a plain fold in Python, and its properties."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postmart.operators import merge as M, normalize as N, sets as U, windows as W

BLANK = (None, "", [])


def fold(rows):
    """One key's versions, oldest first, each (text, number, tags, nested_a, nested_b, stats)."""
    out = {"text": None, "number": None, "tags": None, "a": None, "b": None, "stats": None}
    for text, number, tags, a, b, stats in rows:
        for name, value in (("text", text), ("number", number), ("tags", tags), ("a", a), ("b", b)):
            if value not in BLANK:
                out[name] = value
            elif out[name] is None:
                out[name] = value
        if stats is not None:
            out["stats"] = stats
    return out


SCHEMA = "id string, ord bigint, text string, number bigint, tags array<string>, author struct<a:string,b:bigint>, stats struct<x:double>"
version = st.tuples(
    st.sampled_from([None, "", "p", "q"]), st.sampled_from([None, 0, 5]), st.sampled_from([None, [], ["t"], ["u", "v"]]),
    st.sampled_from([None, "", "n"]), st.sampled_from([None, 0, 7]), st.sampled_from([None, 0.0, 1.5]),
)


def frame(spark, keyed):
    rows = []
    for key, versions in keyed.items():
        for i, (text, number, tags, a, b, stats) in enumerate(versions):
            rows.append((key, i, text, number, tags, (a, b), None if stats is None else (stats,)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def merged(df):
    out = {}
    for r in M.merge_versions(df, "id", ["ord"]).collect():
        out[r["id"]] = {
            "text": r["text"], "number": r["number"], "tags": r["tags"], "a": r["author"]["a"], "b": r["author"]["b"],
            "stats": None if r["stats"] is None else r["stats"]["x"],
        }
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keyed=st.dictionaries(st.sampled_from(["1", "2", "3", "4"]), st.lists(version, min_size=1, max_size=5), min_size=1))
def test_merge_equals_fold(spark, keyed):
    df = frame(spark, keyed)
    assert merged(df) == {k: fold(v) for k, v in keyed.items()}


def test_merge_is_idempotent(spark):
    keyed = {"1": [("p", None, ["t"], "", 0, None), ("", 0, [], "n", None, 1.5)], "2": [(None, 5, None, None, None, None)]}
    once = M.merge_versions(frame(spark, keyed), "id", ["ord"])
    again = M.merge_into(once, once, base_url=None)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(once) == key(again)


def test_zero_and_false_overwrite_blank_does_not(spark):
    rows = [("1", 0, 9, True, "keep"), ("1", 1, 0, False, "")]
    df = spark.createDataFrame(rows, "id string, ord bigint, n bigint, f boolean, t string")
    assert tuple(M.merge_versions(df, "id", ["ord"]).select("n", "f", "t").first()) == (0, False, "keep")


def test_source_order_beats_time(spark):
    schema = "id string, line_no bigint, title string, url string"
    archive = spark.createDataFrame([("1", 5, "new title", "")], schema)
    seed = spark.createDataFrame([("1", 1, "old title", ""), ("2", 2, "", "")], schema)
    both = U.union_seeds([archive, seed, archive])
    got = {r["id"]: (r["title"], r["url"]) for r in M.merge_versions(both, "id", ["source_rank", "line_no"], "http://s/").collect()}
    assert got == {"1": ("old title", "http://s/1"), "2": ("", "http://s/2")}


def test_upsert_keeps_created_at_and_overwrites_with_null(spark):
    schema = "id string, v string, created_at string, extra string"
    target = spark.createDataFrame([("1", "a", "then", "e"), ("2", "b", "then", "f")], schema)
    incoming = spark.createDataFrame([("1", None, "now"), ("3", "c", "now")], "id string, v string, created_at string")
    got = sorted(map(tuple, M.upsert_rows(target, incoming, "id").collect()))
    assert got == [("1", None, "then", "e"), ("2", "b", "then", "f"), ("3", "c", "now", None)]


def test_import_skips_ids_without_using_their_key(spark):
    rows = spark.createDataFrame(
        [("1", "k1", 1), ("2", "k1", 2), ("3", "k1", 3), ("4", "known", 4), ("", "k9", 5), ("6", "k2", 6)],
        "id string, logical_key string, line_no bigint")
    existing = spark.createDataFrame([("1", "other"), ("77", "known")], "id string, logical_key string")
    got = {r["line_no"]: r["outcome"] for r in W.mark_import(rows, existing).collect()}
    assert got == {1: "skipped", 2: "imported", 3: "skipped", 4: "skipped", 5: None, 6: "imported"}


def test_exactly_one_visible_post_per_key(spark):
    rows = [(str(i), f"k{i % 3}" if i < 20 else "", "bt" if i % 2 else "", i % 4, i % 5) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, logical_key string, backtest_id string, clone_count bigint, like_count bigint")
    best = {}
    for r in rows:
        if r[1]:
            best[r[1]] = max(best.get(r[1], (-1,)), (1 if r[2] else 0, r[3], r[4], r[0]))
    for hot in (1_000_000, 1):
        got = {r["id"]: (r["is_hidden_duplicate"], r["duplicate_of"]) for r in W.mark_duplicates(df, hot_rows=hot).collect()}
        for r in rows:
            top = best[r[1]][3] if r[1] else r[0]
            assert got[r[0]] == ((0, None) if top == r[0] else (1, top))


def test_annual_return_zero_falls_through(spark):
    archive = spark.createDataFrame(
        [("1", ("b", None, 3, (750.0, 0.0, 0.0))), ("2", ("", None, None, (None, 0.3, None)))],
        "id string, backtest struct<id:string,name:string,clone_count:bigint,stats:struct<trading_days:double,annual_algo_return:double,sharpe:double>>")
    ids = spark.createDataFrame([("2",)], "id string")
    rows = N.normalize_archive_post(N.conform(archive), ids, "now", "http://s/")
    got = {r["id"]: (r["annual_return"], r["period_years"], r["sharpe"], r["is_original_candidate"], r["url"]) for r in rows.collect()}
    assert got == {"1": (None, 3.0, 0.0, 0, "http://s/1"), "2": (0.3, None, None, 1, "http://s/2")}


def test_rows_without_id_are_dropped(spark):
    archive = spark.createDataFrame([("",), (None,), ("9",)], "id string")
    ids = spark.createDataFrame([], "id string")
    assert [r["id"] for r in N.normalize_archive_post(N.conform(archive), ids, "now").select("id").collect()] == ["9"]


def test_stale_stats_error_survives_merge(spark):
    schema = "id string, __source bigint, backtest struct<stats:struct<sharpe:double>,stats_error:string>"
    rows = [("1", 0, (None, "boom")), ("1", 1, ((1.0,), None))]
    merged_row = M.merge_versions(spark.createDataFrame(rows, schema), "id", ["__source"]).first()
    assert merged_row["backtest"]["stats_error"] == "boom" and merged_row["backtest"]["stats"]["sharpe"] == 1.0
    assert F is not None


def test_resume_with_blank_keys(spark):
    from postmart.operators.joins import resume_anti

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("", 3), (None, 4), (None, 4), ("", 3)], "id string, n int")
    done = spark.createDataFrame([("a",), ("",), (None,)], "id string")
    assert sorted((r["n"] for r in resume_anti(rows, done).collect())) == [2, 3, 3, 4, 4]
    numbers = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, v string")
    assert [r["id"] for r in resume_anti(numbers, spark.createDataFrame([(1,)], "id int")).collect()] == [2]


def test_merge_of_repeated_keys_only(spark):
    """Same rows as the merge of all keys: single versions, repeated ones, rows without a key, absent structs."""
    schema = "id string, ord bigint, url string, number bigint, tags array<string>, author struct<a:string,b:bigint>, " \
        "backtest struct<id:string,stats:struct<x:double>>, stats struct<x:double>, bounty string"
    rows = [
        ("1", 1, None, None, None, None, None, None, "[]"),
        ("2", 1, "", 0, [], (None, None), ("", (None,)), (None,), ""),
        ("3", 1, "u", 5, ["t"], ("n", 0), (None, (1.5,)), (2.0,), "[1]"),
        ("4", 1, "u", 5, ["t"], ("n", 1), ("b", (1.5,)), (2.0,), "[1]"), ("4", 2, "", None, [], ("", None), None, (None,), "{}"),
        (None, 1, None, 1, None, ("x", None), None, None, None), (None, 2, None, None, ["v"], None, ("c", None), None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    text = lambda merged: sorted(r[0] for r in merged.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect())
    want = M.merge_versions(df, "id", ["ord"])
    got = M.merge_repeated(df, "id", ["ord"])
    assert got.columns == want.columns and text(got) == text(want) and len(text(got)) == 5
    tied = spark.createDataFrame([("4", 1, "p"), ("4", 1, "q"), ("5", 1, "r")], "id string, ord bigint, title string")
    assert text(M.merge_repeated(tied, "id", ["ord"], None, F.ascii("title"))) == ['{"id":"4","title":"q"}', '{"id":"5","title":"r"}']

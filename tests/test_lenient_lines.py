"""Lines as other writers leave them: text numbers, fractions, stand-in fields, several part files."""

import json

from pyspark.sql import functions as F, types as T

from postmart.operators import merge as M, normalize as N
from postmart.operators.ranking import global_rank
from postmart.schemas import ARCHIVE_LINES
from postmart.sinks import publish as K
from postmart.sources import files


def test_archive_lines_keep_every_value(spark, folder):
    rows = [
        {"id": 5, "view_count": "12", "like_count": 3.0, "reply_count": True, "backtest": {"clone_count": "7.9", "stats": {"trading_days": "500", "sharpe": "1.5"}}},
        {"post_id": "p1", "author_name": "ann", "backtest": {"stats": {"annual_algo_return": 0, "annual_return": 0.0}}},
        {"requested_id": "r1", "author": {"name": "bo"}, "backtest": {"stats": {"annual_algo_return": 0.0, "annual_return": "0.25"}}},
        {"title": "no id at all"}, {"id": "x", "author": ["odd"], "backtest": None, "tags": [{"id": 1, "name": "t"}, 3], "view_count": "many"},
    ]
    with open(f"{folder}/a.jsonl", "w") as file:
        file.write("\n".join(map(json.dumps, rows)))
    lines = files.scan_jsonl_strict(spark, f"{folder}/a.jsonl", ARCHIVE_LINES)
    none = spark.createDataFrame([], "id string")
    posts = {r["id"]: r for r in N.normalize_archive_post(N.canonicalize_existing(lines), none, "now").collect()}
    assert set(posts) == {"5", "p1", "r1", "x"}
    a = posts["5"]
    assert (a["view_count"], a["like_count"], a["reply_count"], a["clone_count"], a["trading_days"], a["sharpe"]) == (12, 3, 1, 7, 500, 1.5)
    assert (posts["p1"]["author_name"], posts["p1"]["annual_return"], posts["r1"]["annual_return"]) == ("ann", 0.0, 0.25)
    assert (posts["x"]["author_name"], posts["x"]["view_count"]) == ("", None)


def test_line_order_over_part_files(spark, folder):
    for part, n in enumerate((3, 4000, 50)):  # Spark packs the largest file first
        with open(f"{folder}/part-{part}.jsonl", "w") as file:
            file.writelines(json.dumps({"id": "k", "n": 10_000 * part + i}) + "\n" for i in range(n))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    rows = files.scan_jsonl_strict(spark, folder, schema, line_no=True)
    ordered = [r["n"] for r in rows.orderBy("line_no").collect()]
    assert len(ordered) == 4053 and ordered == sorted(ordered)
    assert M.merge_versions(rows, "id", ["line_no"], None).first()["n"] == 20_049


def test_an_empty_bounty_never_erases_one(spark):
    rows = [("a", 1, '{"n":5}'), ("a", 2, "[]"), ("a", 3, "{ }"), ("a", 4, "null"), ("b", 1, "[]"), ("b", 2, '[{"n":1}]')]
    df = spark.createDataFrame(rows, "id string, at int, bounty string")
    got = {r["id"]: r["bounty"] for r in M.merge_versions(df, "id", ["at"], None).collect()}
    assert got == {"a": '{"n":5}', "b": '[{"n":1}]'}


def test_ranks_with_missing_and_negative_counters(spark):
    values = [7, None, 0, None, 0, -3] * 30
    df = spark.createDataFrame([(f"{i:04}", v) for i, v in enumerate(values)], "id string, n bigint")
    got = [r["n"] for r in global_rank(df, [("n", True), ("id", False)], ranges=5).orderBy("rank").collect()]
    assert got == sorted((v for v in values if v is not None), reverse=True) + [None] * 60


def test_document_of_many_parts_is_read_back(spark, folder):
    rows = spark.range(1, 101).select(F.col("id").alias("rank"), F.concat(F.lit('a,"]}'), "id").alias("name")).repartition(7)
    path = K.write_json_document(rows, folder + "/d")
    item = T.StructType([T.StructField("name", T.StringType())])
    got = files.scan_json_document(spark, path, item, lines=True)
    assert sorted(r["name"] for r in got.collect()) == sorted(f'a,"]}}{i}' for i in range(1, 101))

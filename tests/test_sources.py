import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from postmart.operators import normalize as N, sets as U, windows as W
from postmart.operators.aggregates import day_summary, max_listing_page, page_integrity
from postmart.sources import files, html, payloads as S
from tests.conftest import values

DOC = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(text)
    return path


def test_jsonl_skips_blanks_and_non_objects(spark, folder):
    path = write(folder, "a.jsonl", '{"id":"1","n":5}\n\n   \n[1,2]\n"text"\n7\nnull\n{"id":"2"}\n')
    assert sorted(values(files.scan_jsonl_strict(spark, path, DOC), "id", "n")) == [("1", 5), ("2", None)]


def test_jsonl_fails_on_a_broken_line(spark, folder):
    path = write(folder, "bad.jsonl", '{"id":"1"}\n{"id": oops}\n')
    with pytest.raises(Exception, match="invalid JSON line in bad.jsonl.*oops"):
        files.scan_jsonl_strict(spark, path, DOC).collect()


def test_jsonl_line_numbers_grow(spark, folder):
    path = write(folder, "n.jsonl", "".join(f'{{"id":"{i}"}}\n' for i in range(20)))
    rows = files.scan_jsonl_strict(spark, path, DOC, line_no=True).orderBy("line_no").collect()
    assert [r["id"] for r in rows] == [str(i) for i in range(20)]


def test_json_document(spark, folder):
    path = write(folder, "d.json", json.dumps({"count": 2, "items": [{"id": "1", "n": 1}, {"id": "2"}]}, indent=2))
    assert values(files.scan_json_document(spark, path, DOC), "id", "n") == [("1", 1), ("2", None)]


def test_id_csv(spark, folder):
    path = write(folder, "ids.csv", 'id,note\n7,"a, b"\n\n7,x\n,empty\n9,y\n', encoding="utf-8-sig")
    assert sorted(values(files.scan_id_csv(spark, path), "id")) == [("7",), ("9",)]
    assert files.scan_id_csv(spark, path + ".missing").count() == 0


def raw(spark, **payloads):
    rows = [(i + 1, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads.values())]
    return spark.createDataFrame(rows, "page bigint, payload string")


def test_rejected_pages(spark):
    df = raw(spark, a="nope", b=[1], c={"code": "10001", "msg": "busy"}, d={"code": "00000", "data": []}, e={"code": "00000", "data": {}}, f={"data": {}})
    got = {r["page"]: r["reject_reason"] for r in S.inspect_pages(df).collect()}
    assert got == {1: "response is not an object", 2: "response is not an object", 3: "busy", 4: "response has no data object", 5: None, 6: "request failed"}
    with pytest.raises(Exception, match="busy"):
        S.scan_feed_pages(df.where("page = 3")).collect()
    assert S.scan_feed_pages(df, on_reject="skip").count() == 0


def test_feed_post_with_odd_shapes(spark):
    page = {"code": "00000", "data": {"totalCount": "12", "currTime": "now", "list": [
        {"postId": 5, "title": "t", "user": ["x"], "tagInfo": {"a": 1}, "isTop": 1, "viewCount": "1.5", "backtestCloneCount": "8", "content": "c"},
        "stray", {"postId": "6", "user": {"userId": 3, "alias": "bo"}, "isTop": "0", "likeCount": 4, "tagInfo": [{"tagKey": "k", "name": "n"}, 1]}]}}
    posts = N.normalize_feed_post(S.scan_feed_pages(raw(spark, p=page)), base_url="http://s/").orderBy("pos").collect()
    a, b = posts
    assert (a["id"], a["url"], tuple(a["author"]), a["tags"], a["is_top"], a["view_count"]) == ("5", "http://s/5", ("", ""), [], True, 0)
    assert (a["backtest"]["clone_count"], a["content_preview"], a["total_count"], a["pos"], b["pos"]) == (8, "c", 12, 0, 2)
    assert (tuple(b["author"]), b["like_count"], [tuple(t) for t in b["tags"]], b["is_top"]) == (("3", "bo"), 4, [("k", "n")], False)


def test_detail(spark):
    data = json.dumps({"postId": "in", "userId": 77, "author": {"alias": "z"}, "type": "x", "bounty": {"a": 1}, "isRich": "1", "disLikeCount": "3", "fileSize": "9"})
    df = spark.createDataFrame([("req", data)], "requested_id string, j string").select("requested_id", F.parse_json("j").alias("data"))
    d = N.normalize_post_detail(df, base_url="http://s/").first()
    assert (d["id"], d["url"], d["author"]["id"], d["author"]["name"], d["type"], d["bounty"]) == ("in", "http://s/req", "77", "z", None, '{"a":1}')
    assert (d["is_rich"], d["dislike_count"], d["file"]["size"]) == (True, 3, 9)
    row = N.canonical_from_detail(N.normalize_post_detail(df)).first()
    assert (row["id"], row["internal_post_id"]) == ("req", "in") and row["detail_fetched_at"]


def test_reply_tree(spark):
    tree = {"replyId": 1, "content": "a", "user": {"userId": "u"}, "subReply": {"leaveCount": "2", "list": [
        {"replyId": 2, "subReply": [{"replyId": 3, "pReplyId": 2, "subReply": {"list": "odd"}}, "skip"]}, {"replyId": 4, "isOwner": True}]}}
    df = spark.createDataFrame([("p", json.dumps(tree)), ("p", '"text"')], "post_id string, j string").select("post_id", F.parse_json("j").alias("reply"))
    rows = N.flatten_reply_tree(df).orderBy("path").collect()
    assert [(r["reply_id"], r["parent_reply_id"], r["depth"], r["remaining_count"]) for r in rows] == [
        ("1", "", 0, 2), ("2", "1", 1, 0), ("3", "2", 2, 0), ("4", "1", 1, 0)]
    assert [r["is_owner"] for r in rows] == [False, False, False, True]


def test_stats_retry_needs_core_metrics(spark):
    rows = [("a", {"data": []}), ("b", {"data": {"annual_algo_return": 1, "sharpe": 0}}), ("c", {"data": []}), ("d", {"data": {"sharpe": 2}}),
            ("e", {"data": {"trading_days": 3}}), ("f", {"sharpe": "1.5"}), ("g", {})]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in rows], "backtest_id string, payload string")
    inner = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "b"), ("g", "g")], "backtest_id string, inner_id string")
    got = {r["backtest_id"]: (r["resolved_id"], r["sharpe"]) for r in S.scan_stats_payloads(df, inner).collect()}
    assert got == {"a": ("b", 0.0), "b": ("b", 0.0), "c": ("c", None), "d": ("d", 2.0), "e": ("e", None), "f": ("f", 1.5), "g": ("g", None)}


def days(spark, *payloads):
    rows = [(7, f"2024-01-0{i + 1}", json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "sim_id bigint, requested_date string, payload string")


def test_day_records(spark):
    df = days(spark, {"code": "00000", "data": {"isLimit": "FALSE", "position": [{"date": "2023-12-29 15:00", "x": 1}, {"time": "2024-01-01"}, {"y": 1}]}},
              {"status": "0", "data": {"isLimit": 1, "position": []}})
    got = {r["requested_date"]: (r["record_dates"], r["n_items"], r["complete"]) for r in day_summary(S.scan_day_records(df, "positions")).collect()}
    assert got == {"2024-01-01": (["2023-12-29", "2024-01-01"], 3, True), "2024-01-02": ([], 0, False)}


@pytest.mark.parametrize("payload,problem", [
    ({"data": {"position": []}}, "invalid truncation flag"), ({"data": {"isLimit": "maybe", "position": []}}, "invalid truncation flag"),
    ({"data": {"isLimit": 0}}, "without a position list"), ({"code": "403", "data": {}}, "no access"), ({"code": "5", "msg": "down"}, "down"), ({"status": "1", "data": {}}, "request failed"),
])
def test_bad_day_records(spark, payload, problem):
    with pytest.raises(Exception, match=problem):
        S.scan_day_records(days(spark, payload), "positions").collect()
    with pytest.raises(ValueError):
        S.scan_day_records(days(spark, payload), "trades")


def curve(count, offset=0, n=None, **extra):
    n = count if n is None else n
    line = {"time": list(range(n)), "value": [0.5] * n}
    return {"data": {"state": "2", "result": {"count": count, "offset": offset, "overallReturn": line, "benchmark": line, **extra}}}


def series(spark, *payloads):
    rows = [("s", i + 1, json.dumps(p)) for i, p in enumerate(payloads)]
    return S.scan_series_pages(spark.createDataFrame(rows, "series_id string, page bigint, payload string"))


def test_curve_pages(spark):
    pages = series(spark, curve(2), curve(3, 2), {"data": {"state": 0, "result": None}})
    assert [r["verdict"] for r in W.check_offsets(pages).orderBy("page").collect()] == ["ok", "ok", "ok"]
    points = N.series_to_points(pages, ["series_id", "page"])
    assert points.count() == 5


@pytest.mark.parametrize("payload,problem", [
    (curve(3, n=2), "not as long as count"), ({"data": {"state": "2", "result": None}}, "page without a result"), ({"data": {"state": "1", "result": {}}}, "page without a count"),
])
def test_bad_curve_pages(spark, payload, problem):
    with pytest.raises(Exception, match=problem):
        series(spark, payload).collect()


def test_offsets_that_do_not_move(spark):
    pages = series(spark, curve(2), curve(2, 0), curve(0, 4), curve(1, 4))
    got = [r["verdict"] for r in W.check_offsets(pages).orderBy("page").collect()]
    assert got == ["ok", "offset did not move forward", "ok", "page after the end"]  # an end page may state any offset


def test_listing_verdicts(spark):
    def page(listing, number, ids, total):
        data = {"liveArr": [{"backtestId": i} for i in ids]}
        if total is not None:
            data["totalCount"] = total
        return (listing, number, json.dumps({"data": data}))

    rows = [page("ok", 1, "ab", "3"), page("ok", 2, "c", "3"), page("short", 1, "ab", 3), page("twice", 1, "ab", 4), page("twice", 2, "bc", 4),
            page("gap", 1, "ab", 3), page("gap", 2, "", 3), page("blank", 1, ["", "x"], 2), page("mute", 1, "ab", None), page("none", 1, "", 0)]
    df = spark.createDataFrame(rows, "listing string, page bigint, payload string")
    got = {r["listing"]: r["verdict"] for r in page_integrity(*S.scan_simulation_pages(df)).collect()}
    assert got == {"ok": "ok", "short": "total not reached", "twice": "repeated id", "gap": "empty page before the total",
                   "blank": "row without id", "mute": "page without total", "none": "ok"}


RUNS = """
<table><tr class="head"><td>ignored</td></tr>
<tr class="x backtest-tr" _backtestId="L1" _backtestId2="in1" _status="2"><td>1</td><td>First <b>run</b></td><td>2024-03-01 10:00</td>
<td>2020-01-01<br>2021-01-01</td><td>100000</td><td>-</td><td>day</td><td>12%</td><td>3%</td><td>4%</td></tr>
<tr class="backtest-tr" _backtestId="L2" _status="1"><td><input class="source-code" _backtestid="src"></td><td>2</td><td>Second &amp; last</td><td>now</td>
<td>2020-05-05 - today</td><td>lots</td><td>取消</td><td>minute</td></tr></table>"""


def test_run_listing_rows(spark):
    rows = html.extract_html_rows(spark.createDataFrame([(1, RUNS)], "p int, html string"), "html", "tr", "backtest-tr")
    assert [r["inputs"].get("_backtestid") for r in rows.orderBy("row_no").collect()] == [None, "src"]
    a, b = N.normalize_backtest_rows(rows.select("row_no", "cells", "attrs")).orderBy("row_no").collect()
    assert (a["id"], a["list_id"], a["name"], a["status"], a["start_date"], a["end_date"]) == ("in1", "L1", "First run", "done", "2020-01-01", "2021-01-01")
    assert (a["capital"], a["frequency"], a["algorithm_return"], a["max_drawdown"], a["submitted_at"]) == (100000.0, "day", "12%", "4%", "2024-03-01 10:00")
    assert (b["id"], b["name"], b["status"], b["start_date"], b["end_date"], b["capital"], b["frequency"], b["max_drawdown"]) == (
        "L2", "Second & last", "cancelled", "2020-05-05", "", None, "minute", "")


STRATEGIES = """
<tr class="algorithm_list" _algorithmId="n1"><td></td><td><a href="/x?other=1">i</a><a href="/edit?algorithmId=s1">Name
 one</a></td><td>Code</td><td>2024-01-02</td><td>5</td><td></td></tr>
<tr class="algorithm_list" _fId="f9"><td></td><td>Folder</td></tr><tr class="algorithm_list"><td></td><td><a href="/l?fId=f8">Linked</a></td></tr><tr class="algorithm_list"><td>x</td></tr>"""


def test_strategy_listing_rows(spark):
    rows = html.extract_html_rows(spark.createDataFrame([(1, STRATEGIES)], "p int, html string"), "html", "tr", "algorithm_list")
    s = N.normalize_strategy_rows(rows).collect()
    assert [(r["id"], r["internal_id"], r["name"], r["type"], r["updated_at"], r["run_count"], r["backtest_count"]) for r in s] == [
        ("s1", "n1", "i Name one", "Code", "2024-01-02", 5, None)]
    assert sorted(values(N.folder_rows(rows), "id", "name")) == [("f8", "Linked"), ("f9", "Folder")]


def test_hidden_inputs(spark):
    page = '<input id="a" value="1"><input type=hidden id=b><input name="n" value="x"><input id="a" value="2&amp;">'
    df = spark.createDataFrame([(page,), (None,)], "html string")
    got = [r["attributes"] for r in html.extract_tag_attributes(df, "html", "input", "id", "value").collect()]
    assert {"a": "2&", "b": ""} in got and {} in got


def test_max_page(spark):
    page = """<a href="/list?fId=1&amp;page=12">x</a><a href='/list?page=7'>y</a><a href="/other?page=99">z</a><a href="/list?page=no">w</a>"""
    df = spark.createDataFrame([(page,), ("",)], "html string")
    assert sorted(r["max_page"] for r in max_listing_page(df, "html", "/list").collect()) == [1, 12]
    assert sorted(r["max_page"] for r in max_listing_page(df, "html").collect()) == [1, 99]


def test_folder_walk_visits_once_in_breadth_order(spark):
    edges = spark.createDataFrame(
        [("", "b", 1), ("", "a", 0), ("a", "c", 0), ("b", "c", 0), ("b", "d", 1), ("c", "a", 0), ("d", "", 0), ("c", None, 1), ("x", "y", 0)],
        "parent string, child string, pos bigint")
    roots = spark.createDataFrame([("",)], "folder string")
    # Blank children are no folders, so the link back to the root is ignored too.
    walked = U.walk_folders(edges, roots).orderBy("depth", "path").collect()
    assert [(r["folder"], r["depth"]) for r in walked] == [("", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert walked[3]["path"] == [0, 0]
    items = spark.createDataFrame([("c", "i", 0), ("a", "i", 5), ("d", "j", 0), ("y", "k", 0)], "folder string, item string, pos bigint")
    assert sorted(values(U.walk_items(U.walk_folders(edges, roots), items), "item", "folder")) == [("i", "a"), ("j", "d")]


@pytest.mark.parametrize("text,want", [
    ("a\nb\n", "a\nb\n\n#B\nx\n#E\n"), ("a\n #B\nold\n#E \nb  \n\n", "a\nb\n\n#B\nx\n#E\n"), ("a\n#B\nopen\nmore", "a\n\n#B\nx\n#E\n"), ("", "#B\nx\n#E\n"),
    ("#B\n#B\nq\n#E\nk\n#E\nz", "k\nz\n\n#B\nx\n#E\n"), ("a #B #E\nin\n#E\nout", "out\n\n#B\nx\n#E\n"), ("r\r\n#B\r\no\r\n#E\r\ns", "r\ns\n\n#B\nx\n#E\n"),
])
def test_marker_block(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    once = N.refresh_marker_block(df, "t", "#B", "#E", "#B\nx\n#E")
    assert once.first()[0] == want
    assert N.refresh_marker_block(once, "t", "#B", "#E", "#B\nx\n#E").first()[0] == want


def test_payload_decoding(spark):
    rows = [("aGk=", "base64"), ("aGk", "base64"), ("h\ni", "text"), ('{"a":1}', "json"), ("{", "json"), ("x", "zip"), (None, "text")]
    df = spark.createDataFrame(rows, "content string, format string")
    got = [(None if r["bytes"] is None else bytes(r["bytes"]), r["problem"]) for r in N.decode_payload(df).collect()]
    assert got == [(b"hi", None), (None, "invalid base64"), (b"h\ni", None), (b'{"a":1}', None), (None, "invalid JSON"), (None, "unknown format"), (None, "no content")]


def test_what_a_deep_walk_writes(spark, monkeypatch):
    """A chain of folders: every level is written once, and is no larger than the first ones."""
    import glob
    import os

    written = []
    monkeypatch.setattr(U, "delete_on_exit", lambda _, root: written.append(root))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(12)], "parent string, child string, pos bigint")
    walked = U.walk_folders(edges, spark.createDataFrame([("n0",)], "folder string"))
    assert sorted((r["folder"], r["depth"]) for r in walked.collect()) == sorted((f"n{i}", i) for i in range(13))
    size = [sum(os.path.getsize(f) for f in glob.glob(f"{written[0]}/level={k}/part-*") if spark.read.parquet(f).count()) for k in range(13)]
    assert all(size) and max(size) < 2 * min(size)


def test_a_feed_page_is_parsed_once(spark):
    """A filter on rejected pages or on entries must not parse the payload again."""
    pages = spark.createDataFrame([("f", 1, json.dumps({"code": "00000", "data": {"list": [{"postId": "1"}, 7]}}))], "feed string, page bigint, payload string")
    items = S.scan_feed_pages(pages, on_reject="skip", keep_empty=True)
    plan = N.normalize_feed_post(items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert sorted(values(N.normalize_feed_post(items), "pos", "id")) == [(0, "1"), (1, "")]


def test_pages_of_one_split_are_tokenised_by_all_tasks(spark):
    """A table that comes as one split must not be parsed in one task."""
    pages = spark.range(0, 400, 1, 1).select("id", F.lit("<tr><td>a</td></tr>").alias("html"))
    rows = html.extract_html_rows(pages, "html", "tr").withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert len(per_task) == 4 and sum(per_task) == 400 and max(per_task) <= 150
    links = html.extract_tag_attributes(pages, "html", "td", "id", "id")
    assert links.select(F.spark_partition_id().alias("p")).distinct().count() == 4

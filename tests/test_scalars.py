import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmart.functions import scalars as X
from postmart.functions.labels import label_posts
from tests.conftest import values


def one(spark, column, **cells):
    names = list(cells)
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,strict,trunc,real", [
    ("42", 42, 42, 42.0), (" -7 ", -7, -7, -7.0), ("3.9", None, 3, 3.9), ("-3.9", None, -3, -3.9), ("1e3", None, 1000, 1000.0),
    ("", None, None, None), ("abc", None, None, None), ("nan", None, None, float("nan")), ("inf", None, None, float("inf")),
    ("1d", None, None, None), ("0x10", None, None, None), (".5", None, 0, 0.5), (None, None, None, None), ("+8", 8, 8, 8.0),
])
def test_numbers(spark, text, strict, trunc, real):
    assert one(spark, X.int_strict("t"), t=text) == strict
    assert one(spark, X.int_strict("t", 0), t=text) == (strict or 0)
    assert one(spark, X.int_trunc("t"), t=text) == trunc
    got = one(spark, X.float_or_null("t"), t=text)
    assert got == real or (got != got and real != real)


@pytest.mark.parametrize("text,flag", [("1", True), ("0", False), ("2", True), ("-1", True), ("", False), (None, False), ("yes", False), ("true", False)])
def test_flag(spark, text, flag):
    assert one(spark, X.flag01("t"), t=text) is flag


def test_times(spark):
    assert one(spark, X.parse_time("t"), t="2025-03-09 02:30:00") == dt.datetime(2025, 3, 9, 2, 30)
    assert one(spark, X.parse_time("t"), t="2025-3-9") == dt.datetime(2025, 3, 9)
    assert one(spark, X.parse_time("t"), t="2025-02-30") is None
    assert one(spark, X.parse_time("t"), t=" 2025-03-09") is None
    assert one(spark, X.parse_time("t", strip=True), t=" 2025-03-09　") == dt.datetime(2025, 3, 9)
    assert one(spark, X.parse_time("t"), t="2025-03-09T02:30:00") is None


def test_day_spine(spark):
    days = one(spark, X.day_spine("a", "b"), a="2024-02-28", b="2024-03-01")
    assert [d.isoformat() for d in days] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    with pytest.raises(Exception, match="start after end"):
        one(spark, X.day_spine("a", "b"), a="2024-03-02", b="2024-03-01")


def test_truncation_flag(spark):
    assert [one(spark, X.truncation_flag("t"), t=t) for t in ("TRUE", "false", "0", "1")] == [True, False, False, True]
    for bad in ("2", "", None):
        with pytest.raises(Exception, match="invalid truncation flag"):
            one(spark, X.truncation_flag("t"), t=bad)


def test_business_day_and_curve_time(spark):
    df = spark.sql("select timestamp_ntz'2026-05-01 17:00:00' as ts, 1767225600123L as ms")
    assert df.select(X.business_today("ts")).first()[0] == dt.date(2026, 5, 2)
    assert df.select(X.curve_time("ms")).first()[0] == dt.datetime(2026, 1, 1, 8, 0, 0, 123000)


def test_white_space(spark):
    text = "　 a\x1c\t b \nc  "
    assert one(spark, X.squash_ws("t"), t=text) == " ".join(text.split())
    assert one(spark, X.strip_ws("t"), t=text) == text.strip()


def test_logical_key(spark):
    import hashlib

    body = " 　text body\n"
    want = "\x1f".join(["A B", "T", "2024-01-01 00:00:00", hashlib.sha1(body.strip().encode()).hexdigest()])
    assert one(spark, X.logical_key("a", "t", "p", "b"), a=" A 　B", t="T ", p="2024-01-01  00:00:00", b=body) == want
    assert one(spark, X.logical_key("a", "t", "p", "b"), a=None, t=None, p=None, b=None) == "\x1f\x1f\x1f"


@pytest.mark.parametrize("url,value", [
    ("/edit?algorithmId=abc&x=1", "abc"), ("/edit?x=1&algorithmId=a%20b+c#f", "a b c"), ("/edit?algorithmId=&algorithmId=late", "late"),
    ("/edit#?algorithmId=no", None), ("/edit?xalgorithmId=no", None), ("", None), ("/e?algorithmId=%zz", "%zz"), (None, None),
    ("https://h/p?algorithmId=1?2", "1?2"),
])
def test_url_param(spark, url, value):
    assert one(spark, X.url_param("u", "algorithmId"), u=url) == value


@pytest.mark.parametrize("text,start,end", [
    ("2024-01-02 至 2024-05-06", "2024-01-02", "2024-05-06"), ("since 2024-01-02", "2024-01-02", ""), ("a - b - c ", "a", "c"), ("x", "x", ""), ("", "", ""),
])
def test_split_date_range(spark, text, start, end):
    assert tuple(one(spark, X.split_date_range("t"), t=text)) == (start, end)


@pytest.mark.parametrize("code,text,status", [
    ("1", "回测完成", "done"), ("2", "编译失败 后取消", "failed"), ("0", "已取消", "cancelled"), ("2", "进行中", "running"), ("2", "", "done"), ("9", "?", "9"), (None, None, ""),
])
def test_run_status_words(spark, code, text, status):
    assert one(spark, X.map_run_status("c", "t"), c=code, t=text) == status


def test_blank_is_not_falsy(spark):
    df = spark.sql("select 0 as n, false as b, '' as s, cast(null as int) as z, array() as a, map() as m, 'x' as t")
    got = df.select(*[X.is_blank(c, df.schema[c].dataType) for c in df.columns]).first()
    assert tuple(got) == (False, False, True, True, True, True, False)


def test_redact_and_controls(spark):
    assert one(spark, X.redact("t"), t="My ToKeN is 5") == "<redacted>"
    assert one(spark, X.redact("t"), t="plain") == "plain"
    assert one(spark, X.strip_controls("t"), t="a\x00b\tc\nd\x7f\x9fe一") == "ab\tc\nde一"


def test_labels_of_chinese_posts(spark):
    long = "思路清晰，选股后择时，" + "仓位" * 200
    rows = [
        ("1", long, 3.2, 5.5, 1), ("2", "调参而已", 1.0, 2.0, 0), ("3", "x" * 300, None, None, 0),
        ("4", "多个策略拼接 def initialize(context)", 1.01, 2.01, 0), ("5", None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, "id string, content string, period_years double, sharpe double, is_original_candidate int")
    got = {}
    for post, label, score, reason in values(label_posts(df), "post_id", "label", "score", "reason"):
        got.setdefault(post, {})[label] = (score, reason)
    assert set(got["1"]) == {"原创候选", "详细思路", "回测大于1年", "回测大于3年", "夏普偏高", "疑似过拟合"}
    assert got["1"]["详细思路"] == (4.0, f"正文长度 {len(long)}，策略描述关键词 4 个")
    assert got["1"]["回测大于3年"] == (3.2, "回测约 3.2 年")
    assert set(got["2"]) == {"简单调参", "信息不足"}
    assert "3" not in got
    assert set(got["4"]) == {"简单组合", "代码为主", "回测大于1年", "夏普偏高", "信息不足"}
    assert got["4"]["简单组合"][0] == 2.0
    assert got["5"] == {"信息不足": (0.0, "正文长度 0")}


def test_tags_keep_objects_only(spark):
    df = spark.createDataFrame([('[{"tagKey":"k","tagId":"i","name":"n"},{"tagId":9},3,"x",null]',)], "j string")
    tags = df.select(X.normalize_tags(X.vget(F.try_parse_json("j"), "", "array<variant>"))).first()[0]
    assert [tuple(t) for t in tags] == [("k", "n"), ("9", "")]


@pytest.mark.parametrize("text,number,flag,loose", [
    ("3", 3, True, True), ("3.7", 3, True, True), ("-3.7", -3, True, True), ("0.5", 0, False, True), ("true", 1, True, True), ("false", 0, False, False),
    ('"true"', None, False, True), ('"3"', 3, True, True), ('"3.7"', None, False, True), ('"0"', 0, False, True), ('""', None, False, False), ("null", None, False, False),
    ("[]", None, False, False), ("[0]", None, False, True), ("{}", None, False, False), ('{"a":1}', None, False, True), ("0", 0, False, False), ("0.0", 0, False, False), ("1e3", 1000, True, True),
])
def test_values_by_json_kind(spark, text, number, flag, loose):
    df = spark.createDataFrame([(f'{{"x": {text}}}',)], "t string").select(F.parse_json("t").alias("v"))
    row = df.select(X.int_json("v", "x"), X.int_json("v", "x", 0), X.flag_json("v", "x"), X.truthy_json("v", "x"), X.int_json("v", "gone"), X.flag_json("v", "gone"), X.truthy_json("v", "gone")).first()
    assert tuple(row) == (number, number or 0, flag, loose, None, False, False)

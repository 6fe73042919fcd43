"""Rule labels: ten independent rules over one post row, exploded to (post, label, score, reason)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from postmart.functions.scalars import keyword_hits

# ---- fixed values -----------------------------------------------------------------------------
POSITIVE_TERMS = ["思路", "逻辑", "选股", "择时", "风控", "调仓", "因子", "权重", "止损", "仓位", "代码"]
SIMPLE_TUNING_TERMS = ["调参", "参数优化", "改参数", "微调"]
COMBO_TERMS = ["组合策略", "拼接", "集合", "多个策略"]
CODE_MARKS = ["def initialize", "handle_data"]
CANDIDATE_LABEL = "原创候选"
# ---- end of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class LabelTerms:
    """Vocabulary of the text rules; swap it to label posts in another language."""

    positive: list[str] = field(default_factory=lambda: POSITIVE_TERMS)
    tuning: list[str] = field(default_factory=lambda: SIMPLE_TUNING_TERMS)
    combo: list[str] = field(default_factory=lambda: COMBO_TERMS)
    code: list[str] = field(default_factory=lambda: CODE_MARKS)


@dataclass(frozen=True)
class Rule:
    label: str
    fires: Callable[[dict[str, Column]], Column]
    score: Callable[[dict[str, Column]], Column]
    reason: Callable[[dict[str, Column]], Column]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def default_rules() -> list[Rule]:
    one = lambda f: F.lit(1)
    return [
        Rule(CANDIDATE_LABEL, lambda f: f["candidate"], one, lambda f: F.lit("命中原创候选数据集")),
        Rule("详细思路", lambda f: (f["length"] >= 350) & (f["positive"] >= 3), lambda f: f["positive"],
             lambda f: _text("正文长度 ", f["length"], "，策略描述关键词 ", f["positive"], " 个")),
        Rule("简单调参", lambda f: f["tuning"] > 0, lambda f: f["tuning"], lambda f: F.lit("正文包含调参类描述")),
        Rule("简单组合", lambda f: f["combo"] > 0, lambda f: f["combo"], lambda f: F.lit("正文包含组合/拼接类描述")),
        Rule("代码为主", lambda f: f["code"] > 0, one, lambda f: F.lit("正文包含策略代码")),
        Rule("回测大于1年", lambda f: f["period"] > 1, lambda f: f["period"], lambda f: _text("回测约 ", f["period"], " 年")),
        Rule("回测大于3年", lambda f: f["period"] > 3, lambda f: f["period"], lambda f: _text("回测约 ", f["period"], " 年")),
        Rule("夏普偏高", lambda f: f["sharpe"] > 2, lambda f: f["sharpe"], lambda f: _text("夏普 ", f["sharpe"])),
        Rule("疑似过拟合", lambda f: f["sharpe"] > 5, lambda f: f["sharpe"], lambda f: _text("夏普 ", f["sharpe"], " 异常偏高")),
        Rule("信息不足", lambda f: f["length"] < 200, lambda f: f["length"], lambda f: _text("正文长度 ", f["length"])),
    ]


def _features(terms: LabelTerms) -> list[Column]:
    text = F.coalesce(F.col("content"), F.lit(""))
    return [
        F.length(text).alias("length"),
        keyword_hits(text, terms.positive).alias("positive"),
        keyword_hits(text, terms.tuning).alias("tuning"),
        keyword_hits(text, terms.combo).alias("combo"),
        keyword_hits(text, terms.code).alias("code"),
        F.col("period_years").cast("double").alias("period"),
        F.col("sharpe").cast("double").alias("sharpe"),
        F.coalesce(F.col("is_original_candidate").cast("boolean"), F.lit(False)).alias("candidate"),
    ]


def with_labels(posts: DataFrame, name: str, terms: LabelTerms | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Add the fired rules of each post as array<struct<label,score,reason>>; no shuffle."""
    featured = posts.select("*", F.struct(*_features(terms or LabelTerms())).alias("__f"))
    names = ["length", "positive", "tuning", "combo", "code", "period", "sharpe", "candidate"]
    f = {n: F.col(f"__f.{n}") for n in names}
    fired = [
        F.when(
            F.coalesce(rule.fires(f), F.lit(False)),
            F.struct(
                F.lit(rule.label).alias("label"),
                rule.score(f).cast("double").alias("score"),
                rule.reason(f).alias("reason"),
            ),
        )
        for rule in (rules or default_rules())
    ]
    return featured.withColumn(name, F.array_compact(F.array(*fired))).drop("__f")


def label_posts(posts: DataFrame, terms: LabelTerms | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """One row per fired rule: (post_id, label, score, reason)."""
    return with_labels(posts, "__labels", terms, rules).select(F.col("id").alias("post_id"), F.inline("__labels"))


def labels_as_text(labels: Column) -> Column:
    """Sorted distinct labels of an array between pipes, '' when there are none."""
    names = F.array_sort(F.array_distinct(F.transform(labels, lambda x: x["label"])))
    return F.when(F.size(names) > 0, F.concat(F.lit("|"), F.array_join(names, "|"), F.lit("|"))).otherwise(F.lit(""))

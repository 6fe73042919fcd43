"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmart.llm import chat_format, decontaminate, exact_dedup, language, mixing, neighbours, packing, quality, simhash, substring, token_alignment, url_filter, whitening
from postmart.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def _remainder(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder("id", 3) != 1)
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(chat_format.PROBE_ID, turn, role) for turn, role in enumerate(("user", "assistant"))]
    rows = [f"struct({c} AS conv_id, {t} AS turn, '{r}' AS role)" for c, t, r in probe]
    added = spark.range(1).select(F.explode(F.expr(f"array({', '.join(rows)})")).alias("x")).select("x.*", F.lit(chat_format.PROBE).alias("text"))
    return chat_format.digest(chat_format.format_chats(turns.unionByName(added.select(*turns.columns))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), _remainder("doc_id", 5) != 0)
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """(queries, SQL of those that SQL can express)."""
    queries = [
        op1_packing, op2_exact_dedup, op3_quality, op4_chat_format, op5_language, op6_substring, op7_mixing, op8_simhash, op9_url_filter,
        op10_neighbours, op11_whitening, op12_alignment, op13_decontamination,
    ]
    sql = {
        "op2_exact_dedup": exact_dedup.SQL,
        "op4_chat_format": chat_format.SQL,
        "op9_url_filter": url_filter.SQL,
        "op10_neighbours": neighbours.SQL,
        "op13_decontamination": decontaminate.SQL,
    }
    return {f.__name__: f for f in queries}, sql

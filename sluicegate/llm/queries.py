"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, langid, ngram_join, oracles, quality, suffix_dedup, token_count, topk_search, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.withColumn("held_out", held), model, carry=("doc_id", "held_out"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, k=10)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return quality.resample(table(spark, sf_dir, "documents"), good)


#: The rules that the query judges by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_ngram_join": op2_ngram_join,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_topk_search": op5_topk_search,
        "op6_decontamination": op6_decontamination,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_importance_resampling": op8_importance_resampling,
        "op9_url_filter": op9_url_filter,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

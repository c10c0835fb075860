"""A corpus pipeline whose stages each apply one operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of `documents`. run() writes every stage's rows as Parquet into the shared folder and reads them for the next.

Null or empty tables and texts, very long texts, ties, repeated rows and extra columns of any name go through as the
operators define; a text that is null or has no letter goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm import bpe, decontaminate, langid, ngram_join, suffix_dedup
from sluicegate.llm.common import staged, table
from sluicegate.llm.queries import tokenizer_path

#: A document whose best language has a lower posterior than this is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs, model, carry=tuple(docs.columns), names=("__lang_pred", "__score"))
    return judged.where((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_SCORE)).drop("__lang_pred", "__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in their first holder."""
    return suffix_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every text that is left, checked by decoding."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, hash and match in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None

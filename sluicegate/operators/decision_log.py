"""The append-only decision log: one JSON line a decision, with the policy's version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LOG_ENTRY
from .decisions import EXECUTOR_ERROR, INVALID_SCORE


def entries(decisions: DataFrame, version: int, row_index: str = "seq") -> DataFrame:
    """Log entries of decided events."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return decisions.select(now.alias("ts"), "decision_type", "suspicious", "reason", "score", F.col(row_index).cast("long").alias("row_index"), F.lit(version).cast("long").alias("policy_version"), F.struct("seq", "t", "account", "category", "amount").alias("event"))


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All whole entries; a missing log is empty, blank and broken lines are skipped."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], LOG_ENTRY)
    schema = T.StructType([*LOG_ENTRY.fields, T.StructField("__broken", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__broken").json(path)
    return rows.where(F.col("__broken").isNull() & F.col("decision_type").isNotNull()).drop("__broken")


def operational(log: DataFrame) -> DataFrame:
    """Escalations that the system itself caused: invalid scores and missing inputs."""
    return log.where(F.col("decision_type").isin(INVALID_SCORE, EXECUTOR_ERROR))


def since(log: DataFrame, start: str) -> DataFrame:
    return log.where(F.to_timestamp("ts") >= F.to_timestamp(F.lit(start)))


def not_logged(decisions: DataFrame, log: DataFrame, row_index: str = "seq") -> DataFrame:
    """Decisions whose row has no entry yet."""
    known = log.select(F.col("row_index").alias("__known")).where("__known IS NOT NULL").distinct()
    return decisions.join(known, decisions[row_index] == known["__known"], "left_anti")

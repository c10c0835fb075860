"""Contracts of tables: the canonical event, and checks that fail before any job runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("t", T.DoubleType(), False),
        T.StructField("account", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
    ]
)

LOG_ENTRY = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("decision_type", T.StringType()),
        T.StructField("suspicious", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("policy_version", T.LongType()),
        T.StructField("event", T.StructType([T.StructField("seq", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("account", T.LongType()), T.StructField("category", T.StringType()), T.StructField("amount", T.DoubleType())])),
    ]
)


class InvalidDataset(ValueError):
    """A table that can't be used: columns are missing, or there are no rows, or no positives."""


@dataclass(frozen=True)
class EventMapping:
    """Names of a source's columns for the canonical event; `seq` breaks ties of time."""

    seq: str
    t: str
    account: str | None = None
    category: str | None = None
    amount: str = "amount"
    label: str | None = None


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise InvalidDataset(f"missing columns: {', '.join(missing)}")


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise InvalidDataset("the dataset is empty")


def seconds(df: DataFrame, name: str):
    """A time column as seconds since the epoch in UTC, as a double."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1e6)
    return F.col(name).cast("double")


def clean_label(name: str):
    """A 0/1 label that may be written with literal quotes."""
    return F.regexp_replace(F.col(name).cast("string"), "^'+|'+$", "").cast("int")


def canonical(df: DataFrame, m: EventMapping) -> DataFrame:
    """The canonical event columns, after checking that the source has them."""
    require_columns(df, [c for c in (m.seq, m.t, m.account, m.category, m.amount, m.label) if c])
    empty = F.lit(None)
    return df.select(
        F.col(m.seq).cast("long").alias("seq"),
        seconds(df, m.t).alias("t"),
        (F.col(m.account) if m.account else empty).cast("long").alias("account"),
        (F.col(m.category) if m.category else empty).cast("string").alias("category"),
        F.col(m.amount).cast("double").alias("amount"),
        (clean_label(m.label) if m.label else empty.cast("int")).alias("label"),
    )

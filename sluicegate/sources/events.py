"""Sources of events: files with a declared schema, streams, and a seeded generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import EventMapping, canonical, require_rows

#: Mapping of the driver's `events` table.
EVENTS = EventMapping(seq="event_id", t="ts", account="user_id", category="event_type", amount="value")
ORDERS = EventMapping(seq="o_orderkey", t="o_orderdate", account="o_custkey", category="o_orderpriority", amount="o_totalprice")


def read_table(spark: SparkSession, path: str, mapping: EventMapping, fmt: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """A batch source of any format Spark reads, as canonical events; fails on missing columns and no rows."""
    reader = spark.read.format(fmt).options(**options)
    df = canonical((reader.schema(schema) if schema else reader).load(path), mapping)
    require_rows(df)
    return df


def read_csv(spark: SparkSession, path: str, mapping: EventMapping, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema."""
    return read_table(spark, path, mapping, "csv", schema, header="true", enforceSchema="false")


def transactions_schema(components: int = 28) -> T.StructType:
    """The wide card table: Time, V1..Vn, Amount, Class (a label that may be quoted)."""
    return T.StructType([T.StructField("Time", T.DoubleType()), *(T.StructField(f"V{k}", T.DoubleType()) for k in range(1, components + 1)), T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.StringType())])


def with_source_position(df: DataFrame, name: str = "seq") -> DataFrame:
    """A column that grows with the source's own order, to break ties of time (per file and row group)."""
    from pyspark.sql import functions as F

    return df.withColumn(name, F.monotonically_increasing_id())


def read_stream(spark: SparkSession, path: str, schema: T.StructType, mapping: EventMapping, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """A file stream as canonical events."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return canonical(reader.load(path), mapping)


def from_values(messages: DataFrame, schema: T.StructType, mapping: EventMapping, value: str = "value") -> DataFrame:
    """Canonical events of a message source (Kafka's `value`, text or bytes), batch or stream: one JSON object a message.

    A message that is no such object becomes an event of nulls, which the features and the veto flag.
    """
    from pyspark.sql import functions as F

    return canonical(messages.select(F.from_json(F.col(value).cast("string"), schema).alias("__m")).select("__m.*"), mapping)


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded events for demonstrations: 8 % frauds of 1500 to 5000, else lognormal amounts, gaps of 1 to 4 seconds.

    Made on the driver so that a seed gives the same rows everywhere; meant for small n.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(1, 4, n))
    fraud = rng.random(n) < 0.08
    amount = np.where(fraud, rng.uniform(1500, 5000, n), rng.lognormal(3.2, 0.6, n))
    rows = [(k, float(t[k]), k % 7, "abc"[k % 3], float(amount[k]), int(fraud[k])) for k in range(n)]
    return spark.createDataFrame(rows, "seq long, t double, account long, category string, amount double, label int")

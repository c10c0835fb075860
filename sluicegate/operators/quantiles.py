"""Exact percentiles with linear interpolation, at any size.

Spark's `percentile` keeps all distinct values of a group in one buffer. Beyond `small` rows the
order statistics are found by narrowing instead: each pass counts rows in bins of the intervals
still open (all features and ranks at once), and the bin that holds a rank is its next interval.
What reaches the driver is bounded by features x ranks x bins.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000
BINS = 256


def exact_quantiles(rows: DataFrame, probabilities: list[float], small: int | None = None) -> DataFrame:
    """feature, quantiles (array, in the order asked) of rows (feature, value); NaN and nulls must be gone."""
    limit = SMALL_ROWS if small is None else small
    totals = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    kind = rows.schema["feature"].dataType.simpleString()
    if sum(t["n"] for t in totals) <= limit:
        return rows.groupBy("feature").agg(F.percentile("value", F.array(*(F.lit(float(p)) for p in probabilities))).alias("quantiles"))
    found = _narrow(rows, {t["feature"]: (t["n"], t["low"], t["high"]) for t in totals}, probabilities)
    out = []
    for feature, (n, value) in found.items():
        got = []
        for p in probabilities:
            at = p * (n - 1)
            a, b = value[floor(at)], value[min(floor(at) + 1, n - 1)]
            got.append(a + (b - a) * (at - floor(at)))
        out.append((feature, got))
    return rows.sparkSession.createDataFrame(out, f"feature {kind}, quantiles array<double>")


def _narrow(rows: DataFrame, totals: dict, probabilities: list[float]) -> dict:
    """feature -> (rows, {rank: value}) of the order statistics that the probabilities need."""
    spark = rows.sparkSession
    kind = rows.schema["feature"].dataType.simpleString()
    values: dict = {f: {} for f in totals}
    # (feature, rank) -> interval that holds it and the rank inside the interval
    todo = {(f, r): (low, high, r) for f, (n, low, high) in totals.items() for p in probabilities for r in {floor(p * (n - 1)), min(floor(p * (n - 1)) + 1, n - 1)}}
    while todo:
        for key in [k for k, (low, high, _) in todo.items() if low == high]:
            values[key[0]][key[1]] = todo.pop(key)[0]
        if not todo:
            break
        spans = sorted({(f, low, high) for (f, _), (low, high, _) in todo.items()}, key=str)
        table = spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], f"__k int, feature {kind}, __low double, __high double")
        place = F.least(F.floor((F.col("value") - F.col("__low")) / (F.col("__high") - F.col("__low")) * BINS), F.lit(BINS - 1))
        counted = rows.join(F.broadcast(table), "feature").where(F.col("value").between(F.col("__low"), F.col("__high"))).groupBy("__k", place.alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        bins: dict = {}
        for r in sorted(counted, key=lambda r: (r["__k"], r["__b"])):
            bins.setdefault(spans[r["__k"]], []).append((r["n"], r["low"], r["high"]))
        for key, (low, high, rank) in todo.items():
            for n, a, b in bins[key[0], low, high]:
                if rank < n:
                    todo[key] = (a, b, rank) if 0 < rank < n - 1 else (a, a, 0) if rank == 0 else (b, b, 0)
                    break
                rank -= n
    return {f: (totals[f][0], values[f]) for f in totals}

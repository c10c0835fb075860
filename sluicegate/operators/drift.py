"""Drift of features and scores between a reference and a current table.

All features are unpivoted once and handled in one job. Edges are exact percentiles of the
reference; counts by bin and the cumulative distributions come from partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import bucketed
from .quantiles import exact_quantiles

MODERATE, SIGNIFICANT = 0.1, 0.25
EMPTY_SHARE = 1e-4
P_LEVEL = 0.05
#: Samples up to this many rows a side get an exact p-value.
EXACT_ROWS = 10_000


def unpivoted(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, value: one row for each row and feature."""
    return df.unpivot([], [F.col(f).cast("double").alias(f) for f in features], "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def verdict(psi: Column) -> Column:
    return F.when(psi < MODERATE, "none").when(psi < SIGNIFICANT, "moderate").otherwise("significant")


def psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, psi. Edges are the distinct percentiles; the outer bins are open; an empty bin counts as a small share."""
    return psi_of_rows(unpivoted(reference, features), unpivoted(current, features), bins)


def psi_of_rows(ref: DataFrame, cur: DataFrame, bins: int = 10) -> DataFrame:
    """The same for rows (feature, value) of both sides; a feature may be any key, as a pair of periods."""
    edges = exact_quantiles(ref, [k / bins for k in range(bins + 1)]).select("feature", F.array_distinct("quantiles").alias("edges"))  # one row a feature
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    edges = F.broadcast(edges.select("feature", inner.alias("inner")))
    place = F.size(F.filter("inner", lambda e: e <= F.col("value"))).alias("bin")

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.join(edges, "feature").groupBy("feature", place).agg(F.count(F.lit(1)).alias("__n"))
        return n.withColumn(name, F.col("__n") / F.sum("__n").over(Window.partitionBy("feature"))).drop("__n")

    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    both = spine.join(shares(ref, "r"), ["feature", "bin"], "left").join(shares(cur, "a"), ["feature", "bin"], "left")
    r, a = F.coalesce("r", F.lit(EMPTY_SHARE)), F.coalesce("a", F.lit(EMPTY_SHARE))
    return both.groupBy("feature").agg(F.sum((a - r) * F.ln(a / r)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, features: list[str], buckets: int = 128) -> DataFrame:
    """feature, statistic, n_reference, n_current of the two-sample Kolmogorov-Smirnov test.

    Distinct values are ranked inside buckets between quantiles, whose sums are added up first.
    """
    rows = unpivoted(reference, features).withColumn("__r", F.lit(1)).unionByName(unpivoted(current, features).withColumn("__r", F.lit(0)))
    counts = rows.groupBy("feature", "value").agg(F.sum("__r").alias("r"), F.sum(1 - F.col("__r")).alias("c"))
    sizes = F.broadcast(counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc")))
    placed = bucketed(counts, "value", buckets, ("feature",)).join(sizes, "feature")
    sums = placed.groupBy("feature", "__b").agg(F.sum("r").alias("__sr"), F.sum("c").alias("__sc"))
    before = Window.partitionBy("feature").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = F.broadcast(sums.select("feature", "__b", F.coalesce(F.sum("__sr").over(before), F.lit(0)).alias("__br"), F.coalesce(F.sum("__sc").over(before), F.lit(0)).alias("__bc")))
    inside = Window.partitionBy("feature", "__b").orderBy("value")
    placed = placed.withColumn("__cr", F.sum("r").over(inside)).withColumn("__cc", F.sum("c").over(inside)).join(sums, ["feature", "__b"])
    gap = F.abs((F.col("__cr") + F.col("__br")) / F.col("nr") - (F.col("__cc") + F.col("__bc")) / F.col("nc"))
    return placed.groupBy("feature").agg(F.max(gap).alias("statistic"), F.max("nr").alias("n_reference"), F.max("nc").alias("n_current"))


def ks_p_value(statistic: float, n: int, m: int, terms: int = 100) -> float:
    """Two-sided p-value: exact up to EXACT_ROWS rows a side, Kolmogorov's series beyond."""
    if not n or not m:
        return 1.0
    if max(n, m) <= EXACT_ROWS:
        return ks_p_exact(statistic, n, m)
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, terms + 1))))


def ks_p_exact(statistic: float, n: int, m: int) -> float:
    """Chance that two samples of one continuous distribution lie as far apart as `statistic`, or farther.

    The pooled values in order are a random walk that takes a row of either sample with the chance that its
    rows left give; the walk's shares that have always stayed nearer to the diagonal than the statistic are carried along.
    """
    import numpy as np

    limit = round(statistic * n * m) - 0.5  # gaps are whole multiples of 1 / (n m)
    share = np.zeros(n + 2)  # by rows taken of the first sample; the last place is never reached
    share[0] = 1.0
    for s in range(n + m):
        low = max(0, s - m, math.ceil((s * n - limit) / (n + m)))
        high = min(n, s, math.floor((s * n + limit) / (n + m)))
        if low > high:
            return 1.0
        taken = np.arange(low, high + 1)
        now = share[low : high + 1].copy()
        share[max(0, low - 1) : high + 2] = 0.0
        share[low + 1 : high + 2] += now * (n - taken) / (n + m - s)
        share[low : high + 1] += now * (m - s + taken) / (n + m - s)
    return min(1.0, max(0.0, 1.0 - float(share[n])))


def report(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, psi, verdict, ks_statistic, ks_p, ks_drift, significant. The statistics (one row a feature) come to the driver."""
    found = ks(reference, current, features).collect()
    rows = [(r["feature"], float(r["statistic"]), ks_p_value(float(r["statistic"]), int(r["n_reference"]), int(r["n_current"]))) for r in found]
    table = F.broadcast(reference.sparkSession.createDataFrame(rows, "feature string, ks_statistic double, ks_p double"))
    joined = psi(reference, current, features, bins).join(table, "feature")
    return joined.select("feature", "psi", verdict(F.col("psi")).alias("verdict"), "ks_statistic", "ks_p", (F.col("ks_p") < P_LEVEL).alias("ks_drift"), (F.col("psi") >= SIGNIFICANT).alias("significant"))


def recommend(found: DataFrame) -> DataFrame:
    """n_significant and recommend (any feature drifts significantly)."""
    return found.agg(F.count_if("significant").alias("n_significant"), F.coalesce(F.bool_or("significant"), F.lit(False)).alias("recommend"))


def weighted(found: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """feature, weight (share of all |coefficients|, null if unknown or all are 0) and significant."""
    total = sum(abs(c) for c in coefficients.values())
    weight = F.lit(None).cast("double")
    if total:
        table = F.create_map(*(F.lit(x) for f, c in sorted(coefficients.items()) for x in (f, abs(c) / total)))
        weight = F.try_element_at(table, F.col("feature"))
    return found.select("feature", "significant", weight.alias("weight"))


def weighted_share(found: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """share: the weight that lies on drifting features, 0 where there is none."""
    return weighted(found, coefficients).agg(F.coalesce(F.sum(F.when(F.col("significant"), F.col("weight"))), F.lit(0.0)).alias("share"))


def psi_by_period(df: DataFrame, period: str, value: str, bins: int = 10) -> DataFrame:
    """period, psi and verdict of each period's values against those of the period before it (periods are whole numbers)."""
    rows = df.select(F.col(period).cast("long").alias("p"), F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    known = rows.select("p").distinct()
    pairs = F.broadcast(known.select((F.col("p") + 1).alias("p")).intersect(known))
    found = psi_of_rows(rows.withColumn("feature", F.col("p") + 1).join(pairs.withColumnRenamed("p", "feature"), "feature").select("feature", "value"), rows.withColumnRenamed("p", "feature").join(pairs.withColumnRenamed("p", "feature"), "feature").select("feature", "value"), bins)
    return found.select(F.col("feature").alias("period"), "psi", verdict(F.col("psi")).alias("verdict"))

"""Exact classification metrics and threshold search.

Everything starts from one row a distinct score (partial aggregation), and the cumulative
sums over those rows come from sums by score bucket first, so no window runs over all
events. Scores lie in [0, 1]; NaN and null scores are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ieee_ratio, safe_ratio
from .quantiles import exact_quantiles

#: Buckets of scores: between approximate quantiles of the distinct scores, so that crowded scores are spread as well.
BUCKETS = 128


def confusion(df: DataFrame, score: str, label: str, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, n and precision, recall, f1 (0 where undefined) at score >= threshold."""
    fired = (F.col(score) >= threshold) & ~F.isnan(score)
    yes = F.col(label) == 1
    grouped = df.groupBy(*keys) if keys else df
    out = grouped.agg(*(F.count_if(c).alias(n) for n, c in (("tp", fired & yes), ("fp", fired & ~yes), ("fn", ~fired & yes), ("tn", ~fired & ~yes))), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_table(df: DataFrame, score: str, label: str, amount: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a distinct score (of each key): pos, neg, amount of positives (missed if the score is below the threshold)."""
    yes = F.col(label) == 1
    money = F.sum(F.when(yes, F.col(amount)).otherwise(0.0)) if amount else F.lit(0.0)
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"), money.alias("pos_amount"))


def bucketed(table: DataFrame, value: str, buckets: int, keys: tuple[str, ...] = (), name: str = "__b") -> DataFrame:
    """A bucket that grows with the value: the number of (each key's) approximate quantiles that don't exceed it.

    Any edges give right results; quantiles give buckets of like sizes, whatever the values' spread.
    """
    cuts = F.percentile_approx(value, F.array(*(F.lit(k / buckets) for k in range(1, buckets))), 20 * buckets)
    edges = F.broadcast((table.groupBy(*keys) if keys else table).agg(F.array_distinct(cuts).alias("__edges")))  # one row a key
    joined = table.join(edges, list(keys)) if keys else table.join(edges)
    return joined.withColumn(name, F.coalesce(F.size(F.filter("__edges", lambda e: e <= F.col(value))), F.lit(0))).drop("__edges")


def cumulative(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score (of each key): tp, fp and amount at scores >= it, and the totals p, n, total_amount."""
    rows = bucketed(table, "score", BUCKETS)
    names = (("pos", "tp"), ("neg", "fp"), ("pos_amount", "amount_at"))
    sums = rows.groupBy(*keys, "__b").agg(*(F.sum(a).alias(f"__{a}") for a, _ in names))  # bounded by BUCKETS rows a key
    above = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    sums = sums.select(*keys, "__b", *(F.coalesce(F.sum(f"__{a}").over(above), F.lit(0)).alias(f"__up_{a}") for a, _ in names), *(F.sum(f"__{a}").over(every).alias(t) for (a, _), t in zip(names, ("p", "n", "total_amount"), strict=True)))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.desc("score"))
    rows = rows.withColumns({b: F.sum(a).over(inside) for a, b in names})
    return rows.join(sums if keys else F.broadcast(sums), [*keys, "__b"]).select(*keys, "score", "pos", "neg", *((F.col(b) + F.col(f"__up_{a}")).alias(b) for a, b in names), "p", "n", "total_amount")


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, precision, recall, f1 at every distinct score."""
    out = cumulative(score_table(df, score, label)).select(F.col("score").alias("threshold"), "tp", "fp", "p")
    out = out.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("p")))
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("p")


def _best(df: DataFrame, metric: Column, threshold: str, *names: str) -> DataFrame:
    """The row of least (metric, threshold): one aggregate, no sort."""
    return df.agg(F.min(F.struct(metric.alias("__m"), F.col(threshold).alias("__t"), *(F.col(n).alias(n) for n in names))).alias("__best")).where("__best IS NOT NULL").select(F.col("__best.__t").alias(threshold), *(f"__best.{n}" for n in names))


def best_threshold_f1(df: DataFrame, score: str, label: str, digits: int = 12) -> DataFrame:
    """threshold and f1 of the best F1; the lowest threshold among equals (to `digits`), 0.5 where there are no scores."""
    curve = pr_curve(df, score, label)
    best = _best(curve, -F.round("f1", digits), "threshold", "f1")
    return best.agg(F.coalesce(F.max("threshold"), F.lit(0.5)).alias("threshold"), F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc: chance that a positive scores above a negative, ties counted half; null with one class only."""
    c = cumulative(score_table(df, score, label))
    wins = F.sum((F.col("fp") - F.col("neg")) * F.lit(-1.0) * F.col("pos") + F.col("pos") * (F.col("n") - F.lit(0.5) * F.col("neg")))
    return c.agg(F.try_divide(wins, F.max("p") * F.max("n").cast("double")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """ap (of each key): sum over distinct scores of precision times the gain in recall."""
    c = cumulative(score_table(df, score, label, keys=keys), keys)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("p").cast("double")).alias("ap"))


def expected_cost(df: DataFrame, score: str, label: str, amount: str, threshold: float, false_alarm: float) -> DataFrame:
    """cost: false alarms times their cost, and the amounts of what was missed."""
    if false_alarm <= 0:
        raise ValueError("the cost of a false alarm must be positive")
    fired = (F.col(score) >= threshold) & ~F.isnan(score)
    return df.agg((F.count_if(fired & (F.col(label) == 0)) * F.lit(float(false_alarm)) + F.coalesce(F.sum(F.when(~fired & (F.col(label) == 1), F.col(amount))), F.lit(0.0))).alias("cost"))


def cost_curve(df: DataFrame, score: str, label: str, amount: str, false_alarm: float) -> DataFrame:
    """threshold and cost at every distinct score, by cumulative sums."""
    if false_alarm <= 0:
        raise ValueError("the cost of a false alarm must be positive")
    c = cumulative(score_table(df, score, label, amount))
    return c.select(F.col("score").alias("threshold"), (F.col("fp") * F.lit(float(false_alarm)) + F.col("total_amount") - F.col("amount_at")).alias("cost"))


def best_threshold_cost(df: DataFrame, score: str, label: str, amount: str, false_alarm: float, candidates: list[float] | None = None, digits: int = 9) -> DataFrame:
    """threshold and cost of least cost, the lowest threshold among equals; over the observed scores or given candidates."""
    if candidates is None:
        return _best(cost_curve(df, score, label, amount, false_alarm), F.round("cost", digits), "threshold", "cost")
    if false_alarm <= 0:
        raise ValueError("the cost of a false alarm must be positive")
    marks = sorted(set(candidates))
    fired = F.size(F.filter(F.array(*(F.lit(float(c)) for c in marks)), lambda c: c <= F.col(score)))  # candidates that fire
    sums = df.groupBy(fired.alias("__k")).agg(F.count_if(F.col(label) == 0).alias("__fp"), F.sum(F.when(F.col(label) == 1, F.col(amount)).otherwise(0.0)).alias("__m"))
    grid = df.sparkSession.createDataFrame(list(enumerate(map(float, marks), 1)), "__i int, threshold double")
    cost = grid.join(F.broadcast(sums)).groupBy("threshold").agg(F.sum(F.when(F.col("__k") >= F.col("__i"), F.col("__fp") * F.lit(float(false_alarm))).otherwise(F.col("__m"))).alias("cost"))
    return _best(cost, F.round("cost", digits), "threshold", "cost")


def baseline_rule(train: DataFrame, test: DataFrame, amount: str, label: str, quantile: float = 0.999) -> DataFrame:
    """cut and the confusion of the naive rule: an amount over a quantile of the training amounts."""
    rows = train.where(F.col(amount).isNotNull() & ~F.isnan(amount)).select(F.lit("amount").alias("feature"), F.col(amount).alias("value"))
    cut = exact_quantiles(rows, [quantile]).select(F.get("quantiles", F.lit(0)).alias("cut"))
    fired, yes = F.col(amount) > F.col("cut"), F.col(label) == 1
    out = test.join(F.broadcast(cut)).groupBy("cut").agg(F.count_if(fired & yes).alias("tp"), F.count_if(fired & ~yes).alias("fp"), F.count_if(~fired & yes).alias("fn"))
    out = out.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, rate over equal-width bins of the score."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def precision_at_prevalence(df: DataFrame, score: str, label: str, prevalence: float) -> DataFrame:
    """threshold, precision as it would be at another share of positives."""
    c = cumulative(score_table(df, score, label))
    tpr, fpr = safe_ratio(F.col("tp"), F.col("p")), safe_ratio(F.col("fp"), F.col("n"))
    return c.select(F.col("score").alias("threshold"), safe_ratio(tpr * prevalence, tpr * prevalence + fpr * (1 - prevalence)).alias("precision"))


def alarm_rates(df: DataFrame, fired: str, label: str) -> DataFrame:
    """f1, far (false alarms among negatives) and mar (missed among positives); NaN where there is nothing to divide by."""
    f, y = F.col(fired), F.col(label) == 1
    out = df.agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"), F.count_if(~f & ~y).alias("tn"))
    return out.select(ieee_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ieee_ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("far"), ieee_ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("mar"))

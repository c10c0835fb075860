"""Metrics, thresholds and drift: hand-worked cases and statistical controls."""

import itertools
import math

import numpy as np
import pytest

from sluicegate.operators import drift, metrics, splits
from sluicegate.operators.quantiles import exact_quantiles


def scored(spark, y, s, amount=None):
    return spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, s, amount or [1.0] * len(y), strict=True)], "label int, score double, amount double")


def test_best_f1_separates(spark):
    got = metrics.best_threshold_f1(scored(spark, [0, 0, 0, 1, 1], [0.991, 0.993, 0.995, 0.998, 0.9995]), "score", "label").first()
    assert got["threshold"] == 0.998 and got["f1"] == 1.0


def test_best_f1_without_scores(spark):
    assert metrics.best_threshold_f1(scored(spark, [], []), "score", "label").first()["threshold"] == 0.5


def test_cost(spark):
    df = scored(spark, [0, 0, 1, 1], [0.2, 0.6, 0.3, 0.9], [10, 10, 500, 800])
    assert metrics.expected_cost(df, "score", "label", "amount", 0.5, 50).first()["cost"] == 550


def test_best_cost(spark):
    df = scored(spark, [0, 0, 1], [0.4, 0.6, 0.5], [5, 5, 1000])
    got = metrics.best_threshold_cost(df, "score", "label", "amount", 20).first()
    assert (got["threshold"], got["cost"]) == (0.5, 20.0)
    assert metrics.cost_curve(df, "score", "label", "amount", 20).count() == 3


def test_f1_against_cost(spark):
    df = scored(spark, [0, 0, 1, 1], [0.5, 0.9, 0.3, 0.7], [5, 5, 10, 1000])
    assert metrics.best_threshold_f1(df, "score", "label").first()["threshold"] == 0.3
    got = metrics.best_threshold_cost(df, "score", "label", "amount", 50).first()
    assert (got["threshold"], got["cost"]) == (0.7, 60.0)


@pytest.mark.parametrize("c", [0, -5])
def test_cost_guard(spark, c):
    with pytest.raises(ValueError):
        metrics.cost_curve(scored(spark, [0], [0.5]), "score", "label", "amount", c)


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    s = np.clip(s + 0.1 * y, 0, 1)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = scored(spark, y, s)
    assert metrics.roc_auc(df, "score", "label").first()["auc"] == pytest.approx(want)
    ap = 0.0
    for v in np.unique(s)[::-1]:
        at = s >= v
        ap += (y[s == v].sum() / y.sum()) * y[at].sum() / at.sum()
    assert metrics.average_precision(df, "score", "label").first()["ap"] == pytest.approx(ap)
    assert metrics.roc_auc(scored(spark, [1, 1], [0.1, 0.2]), "score", "label").first()["auc"] is None


def normal(spark, mean, seed, n=5000):
    return spark.createDataFrame([(float(x),) for x in np.random.default_rng(seed).normal(mean, 1, n)], "x double")


def test_drift_controls(spark):
    ref = normal(spark, 0, 0)
    same, moved = drift.report(ref, normal(spark, 0, 1), ["x"]).first(), drift.report(ref, normal(spark, 5, 1), ["x"]).first()
    assert same["verdict"] == "none" and not same["ks_drift"]
    assert moved["verdict"] == "significant" and moved["ks_drift"] and moved["significant"]


def test_psi_of_constant_reference(spark):
    ref = spark.createDataFrame([(5.0,)] * 100, "x double")
    assert drift.psi(ref, spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), ["x"]).first()["psi"] == 0.0


def test_weighted(spark):
    found = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "feature string, significant boolean")
    rows = {r["feature"]: r["weight"] for r in drift.weighted(found, {"a": 3.0, "b": 1.0, "c": 0.0}).collect()}
    assert rows == {"a": 0.75, "b": 0.25, "c": 0.0}
    assert drift.weighted_share(found, {"a": 3.0, "b": 1.0, "c": 0.0}).first()["share"] == 0.75
    assert drift.weighted_share(found, {"a": 0.0}).first()["share"] == 0.0
    assert drift.weighted(found, {"a": 0.0}).first()["weight"] is None


def test_ks_p_counts_orders():
    """Against all orders of two small samples, and near the series for large ones."""
    for n, m in ((3, 3), (4, 6), (5, 2)):
        gaps = []
        for own in itertools.combinations(range(n + m), n):
            walk = np.cumsum([1 / n if k in own else -1 / m for k in range(n + m)])
            gaps.append(np.abs(walk).max())
        for d in {round(g, 9) for g in gaps}:
            assert drift.ks_p_value(d, n, m) == pytest.approx(np.mean([g >= d - 1e-6 for g in gaps]))
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 0.03**2 * 2500) for k in range(1, 100))
    assert drift.ks_p_value(0.03, 5000, 5000) == pytest.approx(series, abs=0.005)
    assert drift.ks_p_value(0.99, 5000, 5000) < 1e-9 < 0.01 < drift.ks_p_value(0.025, 5000, 5000)


def test_splits_and_folds():
    assert splits.split_bounds(1000) == (600, 800)
    folds = splits.walk_forward(6000, 5)
    assert [f.train_end for f in folds] == [3000, 3600, 4200, 4800, 5400] and folds[-1].test_end == 6000
    with pytest.raises(ValueError):
        splits.walk_forward(3, 5)


@pytest.mark.parametrize("small", [0, 10**6])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=1500), "b": np.round(rng.exponential(3, 700), 1), "c": np.full(10, 2.5), "d": np.array([1.0])}
    rows = spark.createDataFrame([(f, float(v)) for f, x in data.items() for v in x], "feature string, value double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for r in exact_quantiles(rows, probabilities, small).collect():
        assert r["quantiles"] == pytest.approx(np.quantile(data[r["feature"]], probabilities).tolist(), abs=1e-12)


def test_crowded_scores_are_spread(spark):
    """Nearly all scores near 0 and one far away: buckets of like sizes, exact sums."""
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 4000), np.r_[rng.random(3999) * 1e-6, 1.0]
    table = metrics.score_table(scored(spark, y, s), "score", "label")
    sizes = [r["count"] for r in metrics.bucketed(table, "score", 32).groupBy("__b").count().collect()]
    assert max(sizes) < 4 * 4000 / 32
    got = {r["score"]: (r["tp"], r["fp"]) for r in metrics.cumulative(table).collect()}
    for v in (s[0], s[77], 1.0):
        assert got[v] == ((y[s >= v] == 1).sum(), (y[s >= v] == 0).sum())


def test_alarm_rates_of_one_class(spark):
    """A rate without anything to divide by is NaN, as in the query's SQL."""
    rows = spark.createDataFrame([(True, 0), (False, 0)], "fired boolean, label int")
    got = metrics.alarm_rates(rows, "fired", "label").first()
    assert (got["f1"], got["far"]) == (0.0, 0.5) and math.isnan(got["mar"])

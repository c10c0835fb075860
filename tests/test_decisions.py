"""Scores, vetoes, policies: hand-worked cases and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from sluicegate.functions.numeric import isotonic, sigmoid
from sluicegate.operators.decisions import decide, linear_score, veto, with_table_score
from sluicegate.plans.policy import InvalidPolicy, LinearPolicy, PolicyHolder, TablePolicy, load, publish

LINEAR = LinearPolicy(("amount",), (0.1,), -1.0, 0.5)
TABLE = TablePolicy(("amount",), {"amount": [100.0]}, (2,), (0.1, 0.9), (0.0, 1.0), (0.0, 1.0), 0.5, {"a": 1.0})


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_linear_score(spark):
    df = spark.createDataFrame([(20.0,), (5.0,)], "amount double")
    got = [r["s"] for r in df.select(linear_score(LINEAR).alias("s")).collect()]
    assert got[0] == pytest.approx(0.7310585786300049) and got[1] < 0.5


@pytest.mark.parametrize("z, want", [(-1e5, 0.0), (1e5, 1.0)])
def test_sigmoid_extremes(spark, z, want):
    assert one(spark, sigmoid(F.lit(z))) == want


@pytest.mark.parametrize("x, want", [(0.25, 0.4), (0.0, 0.0), (2.0, 1.0)])
def test_isotonic(spark, x, want):
    assert one(spark, isotonic(F.lit(x), [0, 0.5, 1], [0, 0.8, 1])) == pytest.approx(want)


@pytest.mark.parametrize("x, want", [(-5.0, 0.1), (5.0, 0.9)])
def test_isotonic_clips(spark, x, want):
    assert one(spark, isotonic(F.lit(x), [0.2, 0.8], [0.1, 0.9])) == want


def test_table(spark):
    df = spark.createDataFrame([(20.0,), (500.0,), (float("nan"),)], "amount double")
    assert [r["score"] for r in with_table_score(df, TABLE).collect()] == pytest.approx([0.1, 0.9, 0.1])


def test_large_table_is_joined(spark):
    n = 5000
    policy = TablePolicy(("amount",), {"amount": [float(k) for k in range(n - 1)]}, (n,), tuple(k / n for k in range(n)), (0.0, 1.0), (0.0, 1.0), 0.5, {"a": 1.0}).validated()
    got = with_table_score(spark.createDataFrame([(10.5,), (4000.0,)], "amount double"), policy).orderBy("amount").collect()
    assert [r["score"] for r in got] == pytest.approx([11 / n, 4000 / n])


NAN = float("nan")


@pytest.mark.parametrize(
    "score, amount, kind, suspicious",
    [(NAN, 1.0, "score_invalid", True), (1.5, 1.0, "score_invalid", True), (None, 1.0, "score_invalid", True), (0.1, 50_000.0, "amount_limit", True), (0.1, -50_000.0, "amount_limit", True), (0.1, 10_000.0, "model", False), (0.9, 1.0, "model", True), (0.1, NAN, "model", False), (NAN, 50_000.0, "score_invalid", True)],
)
def test_veto(spark, score, amount, kind, suspicious):
    got = one(spark, veto(F.lit(score).cast("double"), F.lit(amount), 0.5))
    assert (got["decision_type"], got["suspicious"]) == (kind, suspicious)


def test_missing_input_escalates(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "amount double")
    got = [r["decision_type"] for r in decide(df, linear_score(LINEAR), 0.5).collect()]
    assert got == ["executor_error", "model"]


def test_publish_and_reload(tmp_path):
    path = tmp_path / "p" / "policy.json"
    with pytest.raises(FileNotFoundError):
        load(path)
    with pytest.raises(InvalidPolicy):
        publish(LinearPolicy(("a",), (1.0,), 0.0, 2.0), path)
    assert not path.exists()
    assert publish(LINEAR, path).version == 1 and publish(LINEAR, path).version == 2
    assert [p.name for p in path.parent.iterdir()] == ["policy.json"]
    holder = PolicyHolder(path)
    publish(LinearPolicy(("amount",), (0.1,), -1.0, 0.99), path)
    assert holder.reload() and holder.policy.threshold == 0.99
    path.write_text("{broken")
    assert not holder.reload() and holder.policy.threshold == 0.99 and holder.stale
    path.write_text(json.dumps({"version": 1}))
    with pytest.raises(InvalidPolicy):
        load(path)


def test_table_round_trip(tmp_path):
    publish(TABLE, tmp_path / "t.json")
    assert load(tmp_path / "t.json") == TABLE


@pytest.mark.parametrize(
    "change",
    [{"cuts": {"b": [1.0]}}, {"cuts": {"amount": [2.0, 1.0]}}, {"table_shape": (3,)}, {"table": (0.1,)}, {"isotonic_x": (1.0, 0.0)}, {"isotonic_y": (0.0,)}, {"threshold": 1.5}, {"category_prior": {}}, {"features": (), "cuts": {}}],
)
def test_table_contract(change):
    with pytest.raises(InvalidPolicy):
        TablePolicy(**{**TABLE.__dict__, **change}).validated()


@pytest.mark.parametrize("change", [{"features": ()}, {"coefficients": (1.0, 2.0)}, {"coefficients": (True,)}, {"threshold": -0.1}, {"features": (1,)}])
def test_linear_contract(change):
    with pytest.raises(InvalidPolicy):
        LinearPolicy(**{**LINEAR.__dict__, **change}).validated()

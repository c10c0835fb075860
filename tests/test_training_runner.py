"""Training, retraining, the decision log, the runner and the stream."""

import inspect
import json
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicegate.operators import decision_log, features, retrain, splits, training
from sluicegate.operators.decisions import decide, linear_score, with_table_score
from sluicegate.operators.triage import BudgetSpent, Circuit, CircuitOpen, DailyBudget, TriageAgent, client_from, grounded, parse_reply, strip_fence
from sluicegate.plans.policy import LinearPolicy, PolicyHolder, TreesPolicy, load, publish
from sluicegate.schema import EventMapping, InvalidDataset, canonical, clean_label
from sluicegate.streaming import stateful
from sluicegate.streaming.runner import decide_stream, run_cycle


def stream_rows(spark, n=1500, seed=1, late_fraud=None):
    rng = np.random.default_rng(seed)
    fraud = rng.random(n) < 0.08
    if late_fraud is not None:
        fraud[late_fraud:] = False
    amount = np.where(fraud, rng.normal(500, 100, n), rng.normal(50, 20, n)).clip(0)
    return spark.createDataFrame([(k, float(k * 5), k % 5, "abc"[k % 3], float(amount[k]), int(fraud[k])) for k in range(n)], "seq long, t double, account long, category string, amount double, label int")


def test_linear_calibration(spark):
    rows = features.with_position(stream_rows(spark))
    train, val, test = splits.parts(splits.temporal_split(rows, 1500))
    policy = training.calibrate_linear(train, val, ["amount"])
    assert policy.metrics["f1"] > 0.95 and policy.metrics["auc_roc"] > 0.99
    hits = test.select((linear_score(policy) >= policy.threshold).alias("f"), "label").where(F.col("f") == (F.col("label") == 1)).count()
    assert hits / test.count() > 0.97


def test_no_positives(spark):
    rows = stream_rows(spark, 200).withColumn("label", F.lit(0))
    with pytest.raises(InvalidDataset):
        training.calibrate_linear(rows, rows, ["amount"])


def test_table_equals_model(spark):
    rows = stream_rows(spark, 800).withColumn("hour", (F.col("seq") % 24).cast("double"))
    model = training.fit_boosted(rows, ["amount", "hour"], iterations=5)
    cuts = training.tree_cuts(model, ["amount", "hour"])
    table = training.lookup_table(model, cuts, ["amount", "hour"], spark)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from sluicegate.plans.policy import TablePolicy

    policy = TablePolicy(("amount", "hour"), cuts, tuple(len(cuts[f]) + 1 for f in ("amount", "hour")), tuple(table), (0.0, 1.0), (0.0, 1.0), 0.5, {"a": 1.0}).validated()
    both = model.transform(VectorAssembler(inputCols=["amount", "hour"], outputCol="__x").transform(with_table_score(rows, policy)))
    assert both.select(F.max(F.abs(F.col("score") - vector_to_array("probability")[1])).alias("d")).first()["d"] < 1e-9
    grid = [tuple(r) for r in training.grid(spark, cuts, ["amount", "hour"]).orderBy("cell").select("amount", "hour").collect()]
    assert grid == training.representatives(cuts, ["amount", "hour"])


def test_trees_equal_model(spark, monkeypatch, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = stream_rows(spark, 800).withColumn("hour", (F.col("seq") % 24).cast("double"))
    names = ["amount", "hour"]
    model = training.first_rounds(training.fit_boosted(rows, names, iterations=5), 3)
    assert len(model.trees) == 3
    plain = TreesPolicy(tuple(names), training.plain_trees(model), tuple(model.treeWeights), (0.0, 1.0), (0.0, 1.0), 0.5, {"a": 1.0})
    publish(plain, tmp_path / "p.json")
    both = model.transform(VectorAssembler(inputCols=names, outputCol="__x").transform(with_table_score(rows, load(tmp_path / "p.json"))))
    assert both.select(F.max(F.abs(F.col("score") - vector_to_array("probability")[1])).alias("d")).first()["d"] < 1e-9
    train, val, _ = splits.parts(splits.temporal_split(features.with_position(rows), 800))
    table = training.calibrate_table(train, val, names, {"a": 1.0}, iterations=5)
    monkeypatch.setattr(training, "MAX_CELLS", 1)
    trees = training.calibrate_table(train, val, names, {"a": 1.0}, iterations=5)
    assert isinstance(trees, TreesPolicy) and trees.threshold == pytest.approx(table.threshold)


def test_rounds_kept():
    falling = [1 / (k + 1) for k in range(30)]
    assert training.rounds_kept(falling) == 30
    assert training.rounds_kept([*falling[:15], *[0.9] * 15]) == 25
    assert training.rounds_kept([*falling[:15], 0.9, *falling[15:]]) == 31  # one bad round does not end it


def test_boosting_stages_are_sized_by_rows(spark, monkeypatch):
    """Each of the hundreds of small stages has as many tasks as its rows ask for, and lineage is cut."""
    seen, fit = [], training.GBTClassifier.fit

    def fitted(self, df):
        seen.append((df.rdd.getNumPartitions(), df.count()))
        return fit(self, df)

    monkeypatch.setattr(training.GBTClassifier, "fit", fitted)
    monkeypatch.setattr(training, "BOOST_ROWS", 500)
    training.fit_boosted(stream_rows(spark, 800).repartition(40), ["amount"], iterations=2)
    assert seen == [(2, 800)] and spark.sparkContext.getCheckpointDir()


def test_boosted_query_is_whole(spark, monkeypatch):
    from sluicegate.plans import queries as engine

    seen = {}
    fit, walk = training.fit_boosted, training.walk_forward_validation

    def fitted(train, names, label="label", **boosting):
        seen.update(features=names, boosting=boosting)
        return fit(train, names, label, iterations=3)

    def calibrated(train, val, names, prior, *args, calibrate=training.calibrate_table, **boosting):
        seen["prior"] = prior
        return calibrate(train, val, names, prior, *args, **boosting)

    monkeypatch.setattr(training, "fit_boosted", fitted)
    monkeypatch.setattr(training, "calibrate_table", calibrated)
    assert engine.queries()["train_boosted_scores"](spark, "/root/testdata/sf0.001").where("score BETWEEN 0 AND 1").count() == 200
    assert seen["features"] == list(training.TABLE_FEATURES) and not seen["boosting"]
    assert len(seen["prior"]) == 5 and sum(seen["prior"].values()) == pytest.approx(1)
    default = inspect.signature(fit).parameters
    assert (default["iterations"].default, default["bins"].default) == (200, 255)
    monkeypatch.setattr(training, "walk_forward_validation", lambda *a, **k: seen.update(folds=inspect.signature(walk).bind(*a, **k)) or ([], {}))
    engine.queries()["walk_forward_validation"](spark, "/root/testdata/sf0.001")
    seen["folds"].apply_defaults()
    assert seen["folds"].arguments["folds"] == 5


def test_walk_forward_records_failures(spark):
    rows = features.with_position(stream_rows(spark, 1200, late_fraud=800))
    folds, summary = training.walk_forward_validation(rows, ["amount"], 3)
    assert [f["ok"] for f in folds] == [True, False, False] and summary["n_ok"] == 1 and "auc_mean" in summary


def test_retrain(spark, tmp_path):
    path = tmp_path / "p.json"
    ref = stream_rows(spark, 1000, 1)
    out = retrain.check_and_retrain(ref, ref, ["amount"], str(path))
    assert not out.recommend and not out.retrained and out.score_psi is None
    path.write_text("{broken")  # a broken policy leaves its parts empty
    moved = stream_rows(spark, 1000, 2).withColumn("amount", F.col("amount") * 5 + 1000)
    out = retrain.check_and_retrain(ref, moved, ["amount"], str(path), ["amount"])
    assert out.recommend and out.retrained and out.score_psi is None and load(path).features == ("amount",)
    again = retrain.check_and_retrain(ref, moved.withColumn("label", F.lit(0)), ["amount"], str(path))
    assert again.recommend and not again.retrained and "positives" in again.error and again.weighted_share == 1.0


def test_runner(spark, tmp_path):
    events = stream_rows(spark, 1500)
    args = [str(tmp_path / x) for x in ("policy.json", "log", "state.json")]
    first = run_cycle(events, *args, batch=400)
    assert (first.next_position, first.rows) == (850, 400)
    assert decision_log.read(spark, args[1]).count() == 850
    (tmp_path / "state.json").write_text(json.dumps({"next_position": 450}))  # as if it had crashed before saving
    again = run_cycle(events, *args, batch=500)
    assert again.next_position == 950 and decision_log.read(spark, args[1]).count() == 950
    last = run_cycle(events, *args, batch=5000)
    assert last.next_position == 1500
    assert run_cycle(events, *args).exhausted
    log = decision_log.read(spark, args[1])
    assert log.count() == log.select("row_index").distinct().count() == 1500
    assert log.where("policy_version >= 1").count() == 1500


def test_log_tolerates_broken_lines(spark, tmp_path):
    assert decision_log.read(spark, str(tmp_path / "none")).count() == 0
    folder = tmp_path / "log"
    folder.mkdir()
    good = json.dumps({"ts": "2024-01-01T00:00:00+00:00", "decision_type": "model", "suspicious": False, "reason": "model", "score": 0.5, "row_index": 1})
    nan = good.replace("0.5", "NaN").replace('"model", "susp', '"score_invalid", "susp')
    (folder / "a.json").write_text(f'{good}\n{nan}\n\n{{"ts": "2024')
    log = decision_log.read(spark, str(folder))
    assert log.count() == 2 and decision_log.operational(log).count() == 1
    assert decision_log.since(log, "2024-01-02T00:00:00+00:00").count() == 0


def test_stream_matches_batch_over_restart(spark, tmp_path):
    rows = stream_rows(spark, 600)
    source, out = tmp_path / "in", tmp_path / "out"
    prior = {"a": 0.5, "b": 0.5}
    schema = rows.drop("label").schema

    def run():
        s = stateful.account_features(spark.readStream.schema(schema).parquet(str(source)), prior)
        s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    rows.drop("label").where("seq < 300").coalesce(1).write.parquet(str(source))
    run()
    rows.drop("label").where("seq >= 300").coalesce(1).write.mode("append").parquet(str(source))
    run()
    late = spark.createDataFrame([(9999, 0.0, 1, "a", 5.0), (10000, 1e9, 1, "a", float("nan"))], "seq long, t double, account long, category string, amount double")
    late.coalesce(1).write.mode("append").parquet(str(source))
    run()
    got = {r["seq"]: r for r in spark.read.parquet(str(out)).collect()}
    want = features.footprint(features.ewma_account(rows), prior).collect()
    for r in want:
        assert got[r["seq"]]["ewma_account"] == pytest.approx(r["ewma_account"], abs=1e-9)
        assert got[r["seq"]]["footprint"] == pytest.approx(r["footprint"])
    assert got[9999]["late"] and not got[9999]["invalid"] and got[10000]["invalid"]


def test_stream_decides_once_and_reloads(spark, tmp_path):
    rows = stream_rows(spark, 200).drop("label")
    source, log = tmp_path / "in", str(tmp_path / "log")
    rows.coalesce(1).write.parquet(str(source))
    publish(LinearPolicy(("amount", "ewma_account"), (0.1, 0.0), -20.0, 0.5), tmp_path / "p.json")
    holder = PolicyHolder(tmp_path / "p.json")

    def run():
        stream = stateful.account_features(spark.readStream.schema(rows.schema).parquet(str(source)), {"a": 1.0})
        decide_stream(stream, holder, log, str(tmp_path / "check")).awaitTermination()

    run()
    late = spark.createDataFrame([(7000, 0.0, 1, "a", 5.0), (7001, 1e9, 1, "a", 900.0), (3, 1e9 + 1, 1, "a", 900.0)], rows.schema)
    late.coalesce(1).write.mode("append").parquet(str(source))
    publish(LinearPolicy(("amount", "ewma_account"), (0.1, 0.0), -20.0, 0.9), tmp_path / "p.json")
    run()
    got = {r["row_index"]: r for r in decision_log.read(spark, log).collect()}
    assert len(got) == 202 and got[7000]["decision_type"] == "executor_error" and got[7001]["suspicious"]
    assert (got[3]["policy_version"], got[7001]["policy_version"]) == (1, 2)  # row 3 was logged before


def test_canonical(spark):
    df = spark.createDataFrame([(1, "'1'", 2.0)], "i long, y string, x double")
    assert df.select(clean_label("y").alias("y")).first()["y"] == 1
    with pytest.raises(InvalidDataset):
        canonical(df, EventMapping("i", "when"))


REPLY = {"hypothesis": "amount is broken", "severity": "high", "action": "investigate", "evidence": ["the amount is missing"], "confidence": 0.8}


def test_triage_layers():
    assert strip_fence("```json\n{}\n```") == "{}"
    assert parse_reply(json.dumps(REPLY)).confidence == 0.8
    for change in ({"severity": "huge"}, {"confidence": True}, {"confidence": 1.5}, {"evidence": "x"}, {"hypothesis": " "}):
        with pytest.raises(ValueError):
            parse_reply(json.dumps({**REPLY, **change}))
    with pytest.raises(ValueError):
        parse_reply("[1]")
    assert grounded(parse_reply(json.dumps(REPLY)), {"amount": None}, {})
    assert not grounded(parse_reply(json.dumps({**REPLY, "evidence": []})), {"amount": None}, {})


def test_triage_agent_and_circuit():
    replies = iter([json.dumps(REPLY), '```\n{"agree": true}\n```', json.dumps(REPLY), '{"agree": false}'])
    agent = TriageAgent(lambda _: next(replies), audit_rate=1.0, rng=random.Random(0))
    assert not agent.triage({"amount": 1}, {}).discarded
    assert agent.triage({"amount": 1}, {}).discarded
    broken = TriageAgent(lambda _: "no", circuit=Circuit(4))
    assert all(broken.triage({}, {}).discarded for _ in range(4))
    with pytest.raises(CircuitOpen):
        broken.triage({}, {})
    with pytest.raises(ValueError):
        TriageAgent().triage({}, {})
    assert client_from(lambda _: [{"text": "a"}, {"image": 1}, {"text": "b"}])("") == "ab"


def test_daily_budget(tmp_path):
    day = [date(2024, 1, 1)]
    make = lambda: DailyBudget(lambda p: p, 3, lambda: day[0], tmp_path / "b.json")
    b = make()
    b("x"), b("y")
    assert make().left == 1
    make()("z")
    with pytest.raises(BudgetSpent):
        make()("w")
    day[0] = date(2024, 1, 2)
    assert make().left == 3


def test_hot_policy_decides(spark, tmp_path):
    publish(LinearPolicy(("amount",), (0.1,), -1.0, 0.5), tmp_path / "p.json")
    df = decide(spark.createDataFrame([(20.0,)], "amount double"), linear_score(load(tmp_path / "p.json")), 0.5)
    assert df.first()["suspicious"]

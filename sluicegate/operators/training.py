"""Training of policies: a scaled logistic model, and boosted trees turned into an exact lookup table."""

from __future__ import annotations

import itertools
import math
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import LinearPolicy, TablePolicy, TreesPolicy
from ..schema import InvalidDataset
from ..session import scratch_dir
from . import features as feats
from . import metrics, splits
from .decisions import linear_score, with_table_score

TABLE_FEATURES = ("amount", "hour", "count_window", "ewma_account", "footprint", "category_frequency")
#: Not monitored for drift: an expanding frequency moves by design.
UNSTABLE = ("category_frequency",)
#: A lookup table larger than this is not built; the policy then holds the trees.
MAX_CELLS = 5_000_000
#: Boosting stops early beyond so many rows: a tenth is held out, and PATIENCE rounds must lower its loss by more than TOLERANCE.
EARLY_ROWS, PATIENCE, TOLERANCE = 10_000, 10, 1e-7
#: Rows of one partition while boosting: a round is some six small stages, whose cost is that of their tasks.
BOOST_ROWS = 32_768


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def class_counts(df: DataFrame, label: str, what: str) -> tuple[int, int]:
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if not pos:
        raise InvalidDataset(f"no positives in {what}")
    return n, pos


def _weights(df: DataFrame, label: str, n: int, pos: int) -> DataFrame:
    """Balanced class weights n / (2 n_class)."""
    return df.withColumn("__w", F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * max(n - pos, 1))))


def fit_linear(train: DataFrame, features: list[str], label: str = "label", max_iter: int = 1000, c: float = 1.0) -> tuple[list[float], float]:
    """Coefficients and intercept on the original scale of a balanced logistic regression with L2 penalty."""
    n, pos = class_counts(train, label, "training")
    stats = train.agg(*(f(x).alias(f"{g}_{x}") for x in features for g, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = [stats[f"m_{x}"] for x in features]
    scale = [stats[f"s_{x}"] or 1.0 for x in features]
    scaled = train.select(F.col(label).cast("double").alias("__y"), *((F.col(x) - m) / s for x, m, s in zip(features, mean, scale, strict=True)))
    scaled = _weights(scaled.toDF("__y", *features), "__y", n, pos)
    vector = VectorAssembler(inputCols=features, outputCol="__x").transform(scaled)
    # The weighted mean loss with 1 / (c n) has the same minimum as the summed loss with 1 / c.
    model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10).fit(vector)
    coefficients = [float(w) / s for w, s in zip(model.coefficients, scale, strict=True)]
    return coefficients, float(model.intercept) - sum(w * m for w, m in zip(coefficients, mean, strict=True))


def calibrate_linear(train: DataFrame, val: DataFrame, features: list[str], label: str = "label") -> LinearPolicy:
    """A validated policy whose threshold is the best F1 on validation."""
    class_counts(val, label, "validation")
    coefficients, intercept = fit_linear(train, features, label)
    policy = LinearPolicy(tuple(features), tuple(coefficients), intercept, 0.5, calibrated_at=_now())
    scored = val.select(label, linear_score(policy).alias("score"))
    threshold = metrics.best_threshold_f1(scored, "score", label).first()["threshold"]
    got = metrics.confusion(scored, "score", label, threshold).first()
    auc = metrics.roc_auc(scored, "score", label).first()["auc"]
    found = {"precision": got["precision"], "recall": got["recall"], "f1": got["f1"], "auc_roc": auc, "n": got["n"]}
    return LinearPolicy(policy.features, policy.coefficients, intercept, float(threshold), calibrated_at=policy.calibrated_at, metrics=found).validated()


def tree_cuts(model, features: list[str]) -> dict[str, list[float]]:
    """The thresholds at which any tree splits, by feature."""
    cuts: dict[str, set[float]] = {f: set() for f in features}
    todo = [t._java_obj.rootNode() for t in model.trees]
    while todo:
        node = todo.pop()
        if node.subtreeDepth() > 0:
            split = node.split()
            cuts[features[split.featureIndex()]].add(float(split.threshold()))
            todo += [node.leftChild(), node.rightChild()]
    return {f: sorted(v) for f, v in cuts.items()}


def grid(spark, cuts: dict[str, list[float]], features: list[str]) -> DataFrame:
    """cell and one representative value a feature for every cell, in row-major order.

    A bin's representative is its upper cut (a tree sends x <= cut left), the last bin's lies beyond.
    """
    shape = [len(cuts[f]) + 1 for f in features]
    cells = math.prod(shape)
    if cells > MAX_CELLS:
        raise ValueError(f"the table would have {cells} cells")
    out = spark.range(cells).withColumnRenamed("id", "cell")
    step = 1
    for f, size in zip(reversed(features), reversed(shape), strict=True):
        values = [*cuts[f], cuts[f][-1] + 1.0] if cuts[f] else [0.0]
        table = F.array(*(F.lit(float(v)) for v in values))
        out = out.withColumn(f, F.get(table, (F.floor(F.col("cell") / step) % size).cast("int")))
        step *= size
    return out


def lookup_table(model, cuts: dict[str, list[float]], features: list[str], spark) -> list[float]:
    """The model's probability in every cell."""
    from pyspark.ml.functions import vector_to_array

    vector = VectorAssembler(inputCols=features, outputCol="__x").transform(grid(spark, cuts, features))
    rows = model.transform(vector).select("cell", vector_to_array("probability")[1].alias("p")).orderBy("cell").toArrow()
    return rows.column("p").to_pylist()


def plain_trees(model) -> tuple:
    """The trees as nested lists, as TreesPolicy holds them."""

    def plain(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return [int(split.featureIndex()), float(split.threshold()), plain(node.leftChild()), plain(node.rightChild())]

    return tuple(plain(t._java_obj.rootNode()) for t in model.trees)


def rounds_kept(losses: list[float]) -> int:
    """Rounds until none of the last PATIENCE losses is below the one before them by more than TOLERANCE."""
    for n in range(PATIENCE + 1, len(losses) + 1):
        if min(losses[n - PATIENCE : n]) >= losses[n - PATIENCE - 1] - TOLERANCE:
            return n
    return len(losses)


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first n rounds."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    jvm = context._jvm
    trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = context._gateway.new_array(jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = model.trees[k]._java_obj, float(model.treeWeights[k])
    out = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, 2))
    out._resetUid(model.uid)
    return model._copyValues(out)


def fit_boosted(train: DataFrame, features: list[str], label: str = "label", iterations: int = 200, depth: int = 3, rate: float = 0.1, seed: int = 42, bins: int = 255) -> GBTClassificationModel:
    """Boosted trees with balanced weights, stopped early beyond EARLY_ROWS rows.

    MLlib's own stopping ends at the first round that gains nothing, so all rounds are fitted and those after the stop dropped.
    The rounds' lineage is cut by checkpoints, in the scratch folder where the context has no other.
    """
    n, pos = class_counts(train, label, "training")
    rows = _weights(train.select(F.col(label).cast("double").alias("__y"), *(F.col(f).cast("double").alias(f) for f in features)), "__y", n, pos)
    held = (F.pmod(F.xxhash64(*features), F.lit(10)) == 0) if n > EARLY_ROWS else F.lit(False)
    vector = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(rows.withColumn("__held", held))
    vector = vector.select("__y", "__w", "__x", "__held").repartition(-(-n // BOOST_ROWS)).persist()
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{scratch_dir(train.sparkSession)}/boosting")
    try:
        boosting = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=iterations, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed)
        model = boosting.fit(vector.where(~F.col("__held")))
        if n <= EARLY_ROWS or vector.where("__held").isEmpty():
            return model
        kept = rounds_kept(model.evaluateEachIteration(vector.where("__held")))
        return model if kept == len(model.trees) else first_rounds(model, kept)
    finally:
        vector.unpersist()


def fit_isotonic(val: DataFrame, raw: str, label: str) -> tuple[list[float], list[float]]:
    vector = VectorAssembler(inputCols=[raw], outputCol="__x").transform(val.select(F.col(label).cast("double").alias("__y"), raw))
    model = IsotonicRegression(featuresCol="__x", labelCol="__y").fit(vector)
    return [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def calibrate_table(train: DataFrame, val: DataFrame, features: list[str], prior: dict[str, float], label: str = "label", **boosting) -> TablePolicy | TreesPolicy:
    """Boosted trees as an exact table (or as they are, where it would be too large), isotonic calibration and threshold from validation."""
    class_counts(val, label, "validation")
    model = fit_boosted(train, features, label, **boosting)
    cuts = tree_cuts(model, features)
    shape = tuple(len(cuts[f]) + 1 for f in features)
    if math.prod(shape) <= MAX_CELLS:
        plain = TablePolicy(tuple(features), cuts, shape, tuple(lookup_table(model, cuts, features, train.sparkSession)), (0.0, 1.0), (0.0, 1.0), 0.5, prior, calibrated_at=_now())
    else:
        plain = TreesPolicy(tuple(features), plain_trees(model), tuple(map(float, model.treeWeights)), (0.0, 1.0), (0.0, 1.0), 0.5, prior, calibrated_at=_now())
    raw = with_table_score(val, plain, "raw").select(label, "raw")
    xs, ys = fit_isotonic(raw, "raw", label)
    policy = replace(plain, isotonic_x=tuple(xs), isotonic_y=tuple(ys))
    scored = with_table_score(val, policy).select(label, "score").cache()
    threshold = float(metrics.best_threshold_f1(scored, "score", label).first()["threshold"])
    got = metrics.confusion(scored, "score", label, threshold).first()
    found = {"precision_val": got["precision"], "recall_val": got["recall"], "f1_val": got["f1"], "auc_roc": metrics.roc_auc(scored, "score", label).first()["auc"], "auc_pr": metrics.average_precision(scored, "score", label).first()["ap"]}
    scored.unpersist()
    return replace(policy, threshold=threshold, metrics=found).validated()


def train_table_pipeline(events: DataFrame, label: str = "label", seconds: float = feats.WINDOW_SECONDS, **boosting) -> tuple[TablePolicy | TreesPolicy, DataFrame]:
    """The policy and the test part: prior from the raw training part, features over the whole history, then fit on the split."""
    placed = feats.with_position(events)
    n = placed.count()
    first, _ = splits.split_bounds(n)
    prior = {r["category"]: r["prior"] for r in feats.category_prior(placed.where(F.col("position") < first)).collect()}
    rows = splits.temporal_split(feats.account_features(placed, prior, seconds), n).cache()
    train, val, test = splits.parts(rows)
    return calibrate_table(train, val, list(TABLE_FEATURES), prior, label, **boosting), test


def walk_forward_validation(rows: DataFrame, features: list[str], folds: int = 5, first: float = 0.5, label: str = "label", position: str = "position") -> tuple[list[dict], dict]:
    """Each fold's outcome (a fold that can't be trained says why), and mean and population deviation over the others."""
    n = rows.count()
    out = []
    for fold in splits.walk_forward(n, folds, first):
        seen = rows.where(F.col(position) < fold.train_end)
        cut = int(fold.train_end * 0.75)
        test = rows.where((F.col(position) >= fold.train_end) & (F.col(position) < fold.test_end))
        try:
            policy = calibrate_linear(seen.where(F.col(position) < cut), seen.where(F.col(position) >= cut), features, label)
            auc = metrics.roc_auc(test.select(label, linear_score(policy).alias("score")), "score", label).first()["auc"]
            if auc is None:
                raise InvalidDataset("one class only in test")
            out.append({"fold": fold.number, "ok": True, "auc": auc, "threshold": policy.threshold, "error": None})
        except InvalidDataset as e:
            out.append({"fold": fold.number, "ok": False, "auc": None, "threshold": None, "error": str(e)})
    good = [f for f in out if f["ok"]]
    summary: dict = {"n_folds": len(out), "n_ok": len(good)}
    for name in ("auc", "threshold") if good else ():
        values = [f[name] for f in good]
        mean = sum(values) / len(values)
        summary |= {f"{name}_mean": mean, f"{name}_std": math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))}
    return out, summary


def permutation_importance(rows: DataFrame, policy: LinearPolicy, label: str = "label", seed: int = 42) -> dict[str, float]:
    """Loss of average precision when one feature is shuffled (by joining random orders of one block each)."""
    base = metrics.average_precision(rows.select(label, linear_score(policy).alias("score")), "score", label).first()["ap"]
    out = {}
    for f in policy.features:
        keyed = feats.with_position(rows.withColumn("t", F.rand(seed)).withColumn("seq", F.monotonically_increasing_id()), "__a", block_seconds=0.001)
        other = feats.with_position(rows.select(F.col(f).alias("__v"), F.rand(seed + 1).alias("t"), F.monotonically_increasing_id().alias("seq")), "__a", block_seconds=0.001).select("__a", "__v")
        mixed = keyed.join(other, "__a").withColumn(f, F.col("__v"))
        out[f] = base - metrics.average_precision(mixed.select(label, linear_score(policy).alias("score")), "score", label).first()["ap"]
    return out


def demo_policy(train: DataFrame, features: list[str], label: str = "label") -> LinearPolicy:
    """A quick policy with the threshold fixed at one half."""
    coefficients, intercept = fit_linear(train, features, label)
    return LinearPolicy(tuple(features), tuple(coefficients), intercept, 0.5, calibrated_at=_now()).validated()


def representatives(cuts: dict[str, list[float]], features: list[str]) -> list[tuple[float, ...]]:
    """The grid's rows on the driver, for small tables and tests."""
    return list(itertools.product(*([*cuts[f], cuts[f][-1] + 1.0] if cuts[f] else [0.0] for f in features)))

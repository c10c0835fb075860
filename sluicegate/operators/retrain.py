"""Whether to retrain, and retraining: drift of features and of the score in force, then calibration and publication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.policy import LinearPolicy, load, publish
from ..schema import InvalidDataset
from . import drift, features, splits, training
from .decisions import linear_score


@dataclass(frozen=True)
class RetrainOutcome:
    recommend: bool
    n_significant: int
    weighted_share: float | None
    score_psi: float | None
    score_verdict: str | None
    retrained: bool
    new_version: int | None
    error: str | None


def check_and_retrain(reference: DataFrame, current: DataFrame, monitored: list[str], policy_path: str, model_features: list[str] | None = None, label: str = "label") -> RetrainOutcome:
    """Retrain on the current window (60/20/20) if a feature or the score drifts significantly.

    A missing or invalid policy leaves the parts that need one empty; a window that can't be trained on publishes nothing.
    """
    found = drift.report(reference, current, monitored).cache()
    n, by_feature = drift.recommend(found).first()
    share = score_psi = verdict = None
    try:
        policy = load(policy_path)
    except (OSError, ValueError):
        policy = None
    if isinstance(policy, LinearPolicy) and set(policy.features) <= set(reference.columns):
        share = drift.weighted_share(found, dict(zip(policy.features, policy.coefficients, strict=True))).first()["share"]
        scores = [d.select(linear_score(policy).alias("score")) for d in (reference, current)]
        row = drift.psi(*scores, ["score"]).select("psi", drift.verdict(drift.F.col("psi")).alias("v")).first()
        score_psi, verdict = (row["psi"], row["v"]) if row else (None, None)
    found.unpersist()
    recommend = bool(by_feature) or verdict == "significant"
    if not recommend:
        return RetrainOutcome(False, n, share, score_psi, verdict, False, None, None)
    names = model_features or (list(policy.features) if policy else monitored)
    try:
        placed = features.with_position(current, "__at")
        train, val, _ = splits.parts(splits.temporal_split(placed, placed.count(), "__at"))
        new = publish(training.calibrate_linear(train, val, names, label), policy_path)
    except InvalidDataset as e:
        return RetrainOutcome(True, n, share, score_psi, verdict, False, None, str(e))
    return RetrainOutcome(True, n, share, score_psi, verdict, True, new.version, None)

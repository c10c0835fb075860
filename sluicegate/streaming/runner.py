"""The maintenance loop: resumable batches that decide, log once, watch drift and retrain."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decision_log, features, retrain, splits, training
from ..operators.decisions import AMOUNT_LIMIT, decide, linear_score
from ..operators.triage import TriageAgent
from ..plans.policy import LinearPolicy, PolicyHolder, publish
from ..sources.reports import write_report

MONITORED = ["amount", "ewma_global", "count_window"]


@dataclass(frozen=True)
class RunOutcome:
    exhausted: bool
    rows: int
    next_position: int
    retrain: retrain.RetrainOutcome | None = None
    triages: int = 0
    triages_ok: int = 0
    triages_failed: int = 0


def _log_new(decided: DataFrame, log_path: str, version: int) -> int:
    """Append decisions that have no entry yet; a rerun after a crash logs nothing twice."""
    new = decision_log.not_logged(decided, decision_log.read(decided.sparkSession, log_path))
    rows = decision_log.entries(new, version).cache()
    n = rows.count()
    if n:
        decision_log.append(rows, log_path)
    rows.unpersist()
    return n


def run_cycle(events: DataFrame, policy_path: str, log_path: str, state_path: str, batch: int = 5000, bootstrap: float = 0.3, seconds: float = features.WINDOW_SECONDS, limit: float = AMOUNT_LIMIT, agent: TriageAgent | None = None, context: Callable[[], dict] | dict | None = None) -> RunOutcome:
    """One run: bootstrap on the first share of the history if there is no state, then decide the next batch.

    Features are window expressions over the history, so state needs no replay: the position alone is saved.
    """
    rows = features.linear_features(features.with_position(events), seconds).cache()
    n = rows.count()
    started = rows.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("now")).first()["now"]
    try:
        position = json.loads(Path(state_path).read_text())["next_position"]
    except FileNotFoundError:
        position = int(n * bootstrap)
        first = rows.where(F.col("position") < position)
        train, val, _ = splits.parts(splits.temporal_split(first, position))
        publish(training.calibrate_linear(train, val, MONITORED), policy_path)
        policy = PolicyHolder(policy_path).policy
        _log_new(decide(first, linear_score(policy), policy.threshold, limit), log_path, policy.version)
        write_report(state_path, {"next_position": position})
    if position >= n:
        rows.unpersist()
        return RunOutcome(True, 0, position)
    policy: LinearPolicy = PolicyHolder(policy_path).policy
    current = splits.batch_slice(rows, position, batch)
    end = min(position + batch, n)
    _log_new(decide(current, linear_score(policy), policy.threshold, limit), log_path, policy.version)
    write_report(state_path, {"next_position": end})
    outcome = retrain.check_and_retrain(splits.reference_slice(rows, position, batch), current, MONITORED, policy_path)
    tried = ok = failed = 0
    if agent is not None:
        about = context() if callable(context) else (context or {})
        for entry in decision_log.operational(decision_log.since(decision_log.read(rows.sparkSession, log_path), started)).toLocalIterator():
            tried += 1
            try:
                ok += not agent.triage(entry.asDict(True), about).discarded
            except Exception:  # a failed triage never fails the run
                failed += 1
    rows.unpersist()
    return RunOutcome(False, end - position, end, outcome, tried, ok, failed)


def decide_stream(stream: DataFrame, holder: PolicyHolder, log_path: str, checkpoint: str, limit: float = AMOUNT_LIMIT, **trigger):
    """Decide a stream of events with features: each micro-batch takes the policy then in force and logs each row once."""

    def batch(rows: DataFrame, _number: int) -> None:
        holder.reload()
        policy = holder.policy
        fine = ~F.coalesce(F.col("late") | F.col("invalid"), F.lit(True))
        needed = rows.withColumn("amount", F.when(fine | F.isnan("amount"), F.col("amount")))
        _log_new(decide(needed, linear_score(policy), policy.threshold, limit), log_path, policy.version)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def outcome_report(outcome: RunOutcome, path: str | os.PathLike) -> None:
    write_report(path, asdict(outcome))

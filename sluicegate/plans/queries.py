"""The engine's registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import bin_index, isotonic
from ..operators import decision_log, detectors, drift, metrics, splits, training
from ..operators import features as feats
from ..operators.decisions import classify_reason, decide, linear_score, with_table_score
from ..operators.quantiles import exact_quantiles
from ..schema import EventMapping, canonical, clean_label
from ..session import scratch_dir, staged
from ..sources.events import EVENTS, ORDERS, from_values, read_csv, read_stream, transactions_schema
from ..streaming import stateful
from .policy import LinearPolicy, TablePolicy

Query = Callable[[SparkSession, str], DataFrame]
SECONDS = 3600.0
LIMIT = 200.0
FALSE_ALARM = 25.0
#: Fixed policies of the registered queries.
LINEAR = LinearPolicy(("amount", "ewma_global", "count_window"), (0.03, -0.01, 0.02), -3.5, 0.6).validated()
TABLE = TablePolicy(("amount", "hour"), {"amount": [50.0, 150.0], "hour": [6.0, 12.0, 18.0]}, (3, 4), (0.05, 0.1, 0.15, 0.2, 0.3, 0.35, 0.4, 0.45, 0.7, 0.8, 0.9, 0.95), (0.1, 0.4, 0.9), (0.0, 0.5, 1.0), 0.5, {"x": 1.0}).validated()
LABEL = "CASE WHEN (value > 150 AND event_id % 10 <> 0) OR event_id % 97 = 0 THEN 1 ELSE 0 END"
#: A score that needs no model: exact in binary on both sides.
PLAIN_SCORE = "CAST(least(floor(amount), 600) AS DOUBLE) / CAST(600 AS DOUBLE)"

EV = f"ev AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS t, user_id AS account, event_type AS category, value AS amount, {LABEL} AS label FROM events)"
POS = f"{EV}, n AS (SELECT count(*) AS n FROM ev), pos AS (SELECT *, row_number() OVER (ORDER BY t, seq) - 1 AS position FROM ev)"
EWMA = "r AS (SELECT position, seq, amount AS s, amount AS f FROM pos WHERE position = 0 UNION ALL SELECT pos.position, pos.seq, 0.98::DOUBLE * r.s + (1 - 0.98::DOUBLE) * pos.amount, r.s FROM r JOIN pos ON pos.position = r.position + 1)"
APOS = "apos AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, seq) AS k FROM ev)"
AEWMA = "ra AS (SELECT account, k, seq, amount AS s, amount AS f FROM apos WHERE k = 1 UNION ALL SELECT apos.account, apos.k, apos.seq, 0.98::DOUBLE * ra.s + (1 - 0.98::DOUBLE) * apos.amount, ra.s FROM ra JOIN apos ON apos.account = ra.account AND apos.k = ra.k + 1)"
CNT = "row_number() OVER (ORDER BY t, seq) - 1 - count(*) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 3600 PRECEDING)"
PRIOR = "first AS (SELECT * FROM pos, n WHERE position < CAST(floor(n.n * 0.6) AS BIGINT)), prior AS (SELECT category, count(*) AS c, count(*) / (SELECT count(*) FROM first)::DOUBLE AS prior FROM first GROUP BY category)"
FOOT = "list(category) OVER (PARTITION BY account ORDER BY t, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
HOUR = "CAST(floor((t - floor(t / 86400) * 86400) / 3600) AS INTEGER)"
LIN = f"feat AS (SELECT pos.*, r.f AS ewma_global, {CNT.replace('t, seq', 'pos.t, pos.seq').replace('ORDER BY t RANGE', 'ORDER BY pos.t RANGE')} AS count_window FROM pos JOIN r USING (seq)), sc AS (SELECT *, 1 / (1 + exp(-(-3.5 + 0.03 * amount - 0.01 * ewma_global + 0.02 * count_window))) AS score FROM feat)"
CURVE = f"s AS (SELECT *, {PLAIN_SCORE} AS score FROM ev), g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg, sum(CASE WHEN label = 1 THEN amount ELSE 0 END) AS m FROM s GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(m) OVER (ORDER BY score DESC) AS ma, sum(pos) OVER () AS p, sum(neg) OVER () AS nn, sum(m) OVER () AS mm FROM g)"
PRC = f"{CURVE}, pr AS (SELECT score AS threshold, tp, fp, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with the derived label."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    labelled = raw.withColumn("__label", F.expr(LABEL))
    return canonical(labelled, replace(EVENTS, label="__label"))


def plain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("score", F.expr(PLAIN_SCORE))


def _prior(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The valid rows, and the categories' shares in the training part of them."""
    fine = rows.where(feats.valid(rows))
    placed = feats.with_position(fine, source=fine)
    first, _ = splits.split_bounds(fine.count())
    return fine, {r["category"]: r["prior"] for r in feats.category_prior(placed.where(F.col("position") < first)).collect()}


def _round(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(feats.linear_features(events(spark, sf_dir), SECONDS), linear_score(LINEAR), LINEAR.threshold, LIMIT)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and current table of the drift queries: even events, and later odd ones with amounts moved."""
    e = events(spark, sf_dir).withColumn("hour", feats.hour_utc())
    return e.where("seq % 2 = 0"), e.where("seq % 2 = 1").withColumn("amount", F.col("amount") * 2 + 50)


HALVES = f"{EV}, ref AS (SELECT amount, CAST({HOUR} AS DOUBLE) AS hour FROM ev WHERE seq % 2 = 0), cur AS (SELECT amount * 2 + 50 AS amount, CAST({HOUR} AS DOUBLE) AS hour FROM ev WHERE seq % 2 = 1)"


def _psi_sql(ref: str, cur: str, f: str) -> str:
    """PSI of one column of two tables, as a scalar query."""
    edges = ", ".join(f"quantile_cont({f}, {k / 10})" for k in range(11))
    return f"""(WITH e AS (SELECT list_sort(list_distinct([{edges}])) AS all_e FROM {ref}), i AS (SELECT CASE WHEN len(all_e) > 2 THEN all_e[2:len(all_e) - 1] ELSE []::DOUBLE[] END AS inner_e FROM e),
      sp AS (SELECT unnest(range(0, len(inner_e) + 1)) AS b FROM i),
      rb AS (SELECT len(list_filter(inner_e, lambda x: x <= {f})) AS b, count(*) AS c FROM {ref}, i GROUP BY 1), cb AS (SELECT len(list_filter(inner_e, lambda x: x <= {f})) AS b, count(*) AS c FROM {cur}, i GROUP BY 1),
      q AS (SELECT coalesce(rb.c / (SELECT sum(c) FROM rb)::DOUBLE, 1e-4) AS r, coalesce(cb.c / (SELECT sum(c) FROM cb)::DOUBLE, 1e-4) AS a FROM sp LEFT JOIN rb USING (b) LEFT JOIN cb USING (b))
      SELECT sum((a - r) * ln(a / r)) FROM q)"""


def _ks_sql(ref: str, cur: str, f: str) -> str:
    return f"""(WITH u AS (SELECT {f} AS v, 1 AS r FROM {ref} UNION ALL SELECT {f}, 0 FROM {cur}), g AS (SELECT v, sum(r) AS r, sum(1 - r) AS c FROM u GROUP BY v),
      w AS (SELECT sum(r) OVER (ORDER BY v) / (sum(r) OVER ())::DOUBLE - sum(c) OVER (ORDER BY v) / (sum(c) OVER ())::DOUBLE AS d FROM g) SELECT max(abs(d)) FROM w)"""


VERDICT = "CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"
PSI_ROWS = f"p AS (SELECT 'amount' AS feature, {_psi_sql('ref', 'cur', 'amount')} AS psi UNION ALL SELECT 'hour', {_psi_sql('ref', 'cur', 'hour')})"
_REASONS = ("error: missing input", "score out of range", "amount exceeds the limit", "Exceeds and out of RANGE", "all well")

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None):
    def keep(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return keep


@register(f"WITH RECURSIVE {POS}, {EWMA} SELECT seq, round(f, 6) AS ewma_global FROM r")
def feat_ewma_global(spark, sf_dir):
    return feats.ewma_global(events(spark, sf_dir)).select("seq", _round("ewma_global"))


@register(f"WITH {EV} SELECT seq, {CNT} AS count_window FROM ev")
def feat_count_window(spark, sf_dir):
    return feats.count_window(events(spark, sf_dir), seconds=SECONDS).select("seq", "count_window")


@register("WITH ev AS (SELECT o_orderkey AS seq, epoch_us(o_orderdate) / 1e6 AS t FROM orders) SELECT seq, row_number() OVER (ORDER BY t, seq) - 1 - count(*) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 259200 PRECEDING) AS count_window FROM ev")
def feat_count_window_ties(spark, sf_dir):
    """Orders have many equal dates: earlier rows of the same time count, later ones don't."""
    return feats.count_window(canonical(spark.read.parquet(f"{sf_dir}/orders.parquet"), ORDERS), seconds=259_200.0).select("seq", "count_window")


@register(f"WITH RECURSIVE {EV}, {APOS}, {AEWMA} SELECT seq, round(f, 6) AS ewma_account FROM ra")
def feat_ewma_account(spark, sf_dir):
    return feats.ewma_account(events(spark, sf_dir)).select("seq", _round("ewma_account"))


@register(f"WITH {POS}, {PRIOR}, h AS (SELECT seq, category, {FOOT} AS h FROM ev) SELECT seq, round(CASE WHEN len(coalesce(h.h, [])) < 5 THEN coalesce(prior, 0) ELSE len(list_filter(h.h, lambda c: c = category)) / len(h.h)::DOUBLE END, 6) AS footprint FROM h LEFT JOIN prior USING (category)")
def feat_footprint(spark, sf_dir):
    rows, prior = _prior(events(spark, sf_dir))
    return feats.footprint(rows, prior).select("seq", _round("footprint"))


@register(f"WITH {POS}, {PRIOR} SELECT seq, round(row_number() OVER (PARTITION BY category ORDER BY t, seq) / (position + (SELECT count(*) FROM prior))::DOUBLE, 6) AS category_frequency FROM pos")
def feat_expanding_freq(spark, sf_dir):
    rows, prior = _prior(events(spark, sf_dir))
    return feats.expanding_frequency(rows, len(prior)).select("seq", _round("category_frequency"))


@register(f"WITH {POS}, {PRIOR} SELECT category, c AS n, round(prior, 6) AS prior FROM prior")
def feat_category_prior(spark, sf_dir):
    e = events(spark, sf_dir)
    first, _ = splits.split_bounds(e.count())
    return feats.category_prior(feats.with_position(e).where(F.col("position") < first)).select("category", "n", _round("prior"))


@register(f"WITH {EV} SELECT hour, count(*) AS n FROM (SELECT {HOUR} AS hour FROM ev) GROUP BY hour")
def feat_hour(spark, sf_dir):
    return events(spark, sf_dir).groupBy(feats.hour_utc().alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@register(
    f"WITH RECURSIVE {POS}, {PRIOR}, {APOS}, {AEWMA}, h AS (SELECT *, {FOOT} AS h, {CNT} AS count_window FROM pos) SELECT h.seq, h.amount, {HOUR} AS hour, count_window, round(ra.f, 6) AS ewma_account, round(CASE WHEN len(coalesce(h.h, [])) < 5 THEN coalesce(prior, 0) ELSE len(list_filter(h.h, lambda c: c = category)) / len(h.h)::DOUBLE END, 6) AS footprint, round(row_number() OVER (PARTITION BY category ORDER BY t, h.seq) / (position + (SELECT count(*) FROM prior))::DOUBLE, 6) AS category_frequency FROM h JOIN ra ON ra.seq = h.seq LEFT JOIN prior USING (category)"
)
def feat_all(spark, sf_dir):
    rows, prior = _prior(events(spark, sf_dir))
    return feats.account_features(rows, prior, SECONDS).select("seq", "amount", "hour", "count_window", _round("ewma_account"), _round("footprint"), _round("category_frequency"))


@register(f"WITH {POS} SELECT CASE WHEN position < CAST(floor(n * 0.6) AS BIGINT) THEN 'train' WHEN position < CAST(floor(n * 0.8) AS BIGINT) THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(label) AS BIGINT) AS positives FROM pos, n GROUP BY 1")
def split_temporal(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = splits.temporal_split(feats.with_position(e), e.count())
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("label").alias("positives"))


@register(f"WITH {POS}, k AS (SELECT unnest(range(1, 6)) AS fold), b AS (SELECT fold, n // 2 + (fold - 1) * ((n - n // 2) // 5) AS a, n // 2 + fold * ((n - n // 2) // 5) AS z FROM k, n) SELECT fold, count(*) FILTER (position < a) AS n_train, count(*) FILTER (position >= a AND position < z) AS n_test, CAST(sum(label) FILTER (position >= a AND position < z) AS BIGINT) AS test_positives FROM pos, b GROUP BY fold")
def walk_forward_folds(spark, sf_dir):
    rows = feats.with_position(events(spark, sf_dir))
    folds = splits.walk_forward(rows.count(), 5)
    table = spark.createDataFrame([(f.number, f.train_end, f.test_end) for f in folds], "fold long, a long, z long")
    test = (F.col("position") >= F.col("a")) & (F.col("position") < F.col("z"))
    return rows.join(F.broadcast(table)).groupBy("fold").agg(F.count_if(F.col("position") < F.col("a")).alias("n_train"), F.count_if(test).alias("n_test"), F.sum(F.when(test, F.col("label"))).alias("test_positives"))


@register(f"WITH RECURSIVE {POS}, {EWMA}, {LIN} SELECT seq, round(score, 6) AS score FROM sc")
def score_linear(spark, sf_dir):
    return _linear(spark, sf_dir).select("seq", _round("score"))


DECIDED = "d AS (SELECT *, CASE WHEN abs(amount) > 200 THEN 'amount_limit' ELSE 'model' END AS decision_type, abs(amount) > 200 OR score >= 0.6 AS suspicious FROM sc)"


@register(f"WITH RECURSIVE {POS}, {EWMA}, {LIN}, {DECIDED} SELECT seq, round(score, 6) AS score, decision_type, suspicious FROM d")
def decide_linear(spark, sf_dir):
    return _linear(spark, sf_dir).select("seq", _round("score"), "decision_type", "suspicious")


@register(f"WITH RECURSIVE {POS}, {EWMA}, {LIN}, {DECIDED} SELECT category, decision_type, suspicious, count(*) AS n FROM d GROUP BY ALL")
def decide_counts(spark, sf_dir):
    return _linear(spark, sf_dir).groupBy("category", "decision_type", "suspicious").agg(F.count(F.lit(1)).alias("n"))


_BAD = "SELECT seq, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 7 = 0 THEN 'NaN'::DOUBLE ELSE amount END AS amount, CASE WHEN seq % 5 = 0 THEN 'NaN'::DOUBLE WHEN seq % 13 = 0 THEN 1.5 ELSE CAST(least(floor(amount), 600) AS DOUBLE) / CAST(600 AS DOUBLE) END AS score FROM ev"


@register(
    f"WITH {EV}, b AS ({_BAD}), k AS (SELECT seq, CASE WHEN amount IS NULL THEN 'executor_error' WHEN isnan(score) OR NOT score BETWEEN 0 AND 1 THEN 'score_invalid' WHEN NOT isnan(amount) AND abs(amount) > 200 THEN 'amount_limit' ELSE 'model' END AS decision_type, score FROM b) SELECT seq, decision_type, decision_type <> 'model' OR score >= 0.25 AS suspicious FROM k"
)
def decide_invalid_inputs(spark, sf_dir):
    e = plain_scores(spark, sf_dir)
    nan = F.lit(float("nan"))
    e = e.withColumn("amount", F.when(F.col("seq") % 11 == 0, F.lit(None)).when(F.col("seq") % 7 == 0, nan).otherwise(F.col("amount")))
    e = e.withColumn("given", F.when(F.col("seq") % 5 == 0, nan).when(F.col("seq") % 13 == 0, 1.5).otherwise(F.col("score"))).drop("score")
    return decide(e, F.col("given"), 0.25, LIMIT).select("seq", "decision_type", "suspicious")


@register(f"WITH {EV} SELECT bin, count(*) AS n FROM (SELECT len(list_filter([10.0, 25.0, 50.0, 100.0, 200.0], lambda c: c < amount)) AS bin FROM ev) GROUP BY bin")
def bin_index_counts(spark, sf_dir):
    b = bin_index(F.col("amount"), [10.0, 25.0, 50.0, 100.0, 200.0]).cast("long").alias("bin")
    return events(spark, sf_dir).groupBy(b).agg(F.count(F.lit(1)).alias("n"))


ISO = "CASE WHEN x <= 0.1 THEN 0.0 WHEN x >= 0.9 THEN 1.0 WHEN x < 0.4 THEN 0.5 * (x - 0.1) / 0.3 ELSE 0.5 + 0.5 * (x - 0.4) / 0.5 END"
CELLS = f"cell AS (SELECT seq, amount, [0.05, 0.1, 0.15, 0.2, 0.3, 0.35, 0.4, 0.45, 0.7, 0.8, 0.9, 0.95][1 + 4 * (CASE WHEN amount > 150 THEN 2 WHEN amount > 50 THEN 1 ELSE 0 END) + (CASE WHEN h > 18 THEN 3 WHEN h > 12 THEN 2 WHEN h > 6 THEN 1 ELSE 0 END)]::DOUBLE AS x FROM (SELECT *, {HOUR} AS h FROM ev))"


@register(f"WITH {EV} SELECT seq, round({ISO}, 6) AS calibrated FROM (SELECT seq, ({PLAIN_SCORE}) AS x FROM ev)")
def score_isotonic(spark, sf_dir):
    return plain_scores(spark, sf_dir).select("seq", F.round(isotonic(F.col("score"), TABLE.isotonic_x, TABLE.isotonic_y), 6).alias("calibrated"))


@register(f"WITH {EV}, {CELLS} SELECT seq, round({ISO}, 6) AS score FROM cell")
def score_table(spark, sf_dir):
    return with_table_score(events(spark, sf_dir).withColumn("hour", feats.hour_utc()), TABLE).select("seq", _round("score"))


@register(f"WITH {EV}, {CELLS}, s AS (SELECT seq, amount, {ISO} AS score FROM cell) SELECT seq, CASE WHEN abs(amount) > 200 THEN 'amount_limit' ELSE 'model' END AS decision_type, abs(amount) > 200 OR score >= 0.5 AS suspicious FROM s")
def decide_table(spark, sf_dir):
    rows = with_table_score(events(spark, sf_dir).withColumn("hour", feats.hour_utc()), TABLE, "s")
    return decide(rows, F.col("s"), TABLE.threshold, LIMIT).select("seq", "decision_type", "suspicious")


@register(f"WITH {EV}, {PRC} SELECT round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def pr_curve(spark, sf_dir):
    c = metrics.pr_curve(plain_scores(spark, sf_dir), "score", "label")
    return c.select(*(_round(x, 9) for x in ("threshold", "precision", "recall", "f1")))


@register(f"WITH {EV}, {PRC} SELECT round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM f ORDER BY round(f.f1, 12) DESC, f.threshold LIMIT 1")
def best_threshold_f1(spark, sf_dir):
    return metrics.best_threshold_f1(plain_scores(spark, sf_dir), "score", "label").select(_round("threshold", 9), _round("f1", 9))


@register(f"WITH {EV}, s AS (SELECT *, {PLAIN_SCORE} >= 0.25 AS f FROM ev), k AS (SELECT category, count(*) FILTER (f AND label = 1) AS tp, count(*) FILTER (f AND label = 0) AS fp, count(*) FILTER (NOT f AND label = 1) AS fn, count(*) FILTER (NOT f AND label = 0) AS tn, count(*) AS n FROM s GROUP BY category) SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1 FROM k")
def cls_metrics(spark, sf_dir):
    c = metrics.confusion(plain_scores(spark, sf_dir), "score", "label", 0.25, ("category",))
    return c.select("category", "tp", "fp", "fn", "tn", "n", _round("precision", 9), _round("recall", 9), _round("f1", 9))


@register(f"WITH {EV}, {CURVE} SELECT round(sum(pos * (nn - fp + 0.5 * neg)) / (max(p) * max(nn))::DOUBLE, 9) AS auc FROM c")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(plain_scores(spark, sf_dir), "score", "label").select(_round("auc", 9))


@register(f"WITH {EV}, {CURVE} SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)::DOUBLE), 9) AS ap FROM c")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(plain_scores(spark, sf_dir), "score", "label").select(_round("ap", 9))


@register(f"WITH {EV}, {CURVE} SELECT round(score, 9) AS threshold, round(fp * 25.0::DOUBLE + mm - ma, 4) AS cost FROM c")
def cost_curve(spark, sf_dir):
    return metrics.cost_curve(plain_scores(spark, sf_dir), "score", "label", "amount", FALSE_ALARM).select(_round("threshold", 9), _round("cost", 4))


@register(f"WITH {EV}, {CURVE} SELECT round(score, 9) AS threshold, round(fp * 25.0::DOUBLE + mm - ma, 4) AS cost FROM c ORDER BY round(fp * 25.0::DOUBLE + mm - ma, 9), score LIMIT 1")
def best_threshold_cost(spark, sf_dir):
    return metrics.best_threshold_cost(plain_scores(spark, sf_dir), "score", "label", "amount", FALSE_ALARM).select(_round("threshold", 9), _round("cost", 4))


@register(f"WITH {EV}, s AS (SELECT *, {PLAIN_SCORE} AS score FROM ev), k AS (SELECT unnest([0.1, 0.25, 0.4, 0.7])::DOUBLE AS threshold) SELECT threshold, round(sum(CASE WHEN score >= threshold AND label = 0 THEN 25.0 WHEN score < threshold AND label = 1 THEN amount ELSE 0 END)::DOUBLE, 4) AS cost FROM s, k GROUP BY threshold ORDER BY 2, 1 LIMIT 1")
def best_threshold_candidates(spark, sf_dir):
    return metrics.best_threshold_cost(plain_scores(spark, sf_dir), "score", "label", "amount", FALSE_ALARM, [0.1, 0.25, 0.4, 0.7]).select("threshold", _round("cost", 4))


@register(f"WITH {EV}, s AS (SELECT *, {PLAIN_SCORE} AS score FROM ev) SELECT round(sum(CASE WHEN score >= 0.25 AND label = 0 THEN 25.0 WHEN score < 0.25 AND label = 1 THEN amount ELSE 0 END)::DOUBLE, 4) AS cost FROM s")
def expected_cost(spark, sf_dir):
    return metrics.expected_cost(plain_scores(spark, sf_dir), "score", "label", "amount", 0.25, FALSE_ALARM).select(_round("cost", 4))


@register(f"WITH {POS}, q AS (SELECT quantile_cont(amount, 0.99) AS cut FROM pos, n WHERE position < CAST(floor(n.n * 0.6) AS BIGINT)), k AS (SELECT cut, count(*) FILTER (amount > cut AND label = 1) AS tp, count(*) FILTER (amount > cut AND label = 0) AS fp, count(*) FILTER (amount <= cut AND label = 1) AS fn FROM pos, n, q WHERE position >= CAST(floor(n.n * 0.6) AS BIGINT) GROUP BY cut) SELECT round(cut, 6) AS cut, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM k")
def baseline_rule(spark, sf_dir):
    e = events(spark, sf_dir)
    rows, (first, _) = feats.with_position(e), splits.split_bounds(e.count())
    out = metrics.baseline_rule(rows.where(F.col("position") < first), rows.where(F.col("position") >= first), "amount", "label", 0.99)
    return out.select(_round("cut"), "tp", "fp", "fn", _round("f1", 9))


@register(f"WITH {HALVES}, {PSI_ROWS} SELECT feature, round(psi, 6) AS psi FROM p")
def psi_by_feature(spark, sf_dir):
    return drift.psi(*_halves(spark, sf_dir), ["amount", "hour"]).select("feature", _round("psi"))


@register(f"WITH {HALVES}, {PSI_ROWS} SELECT feature, {VERDICT} AS verdict FROM p")
def psi_verdict(spark, sf_dir):
    return drift.psi(*_halves(spark, sf_dir), ["amount", "hour"]).select("feature", drift.verdict(F.col("psi")).alias("verdict"))


KS_ROWS = f"k AS (SELECT 'amount' AS feature, {_ks_sql('ref', 'cur', 'amount')} AS statistic UNION ALL SELECT 'hour', {_ks_sql('ref', 'cur', 'hour')})"


@register(f"WITH {HALVES}, {KS_ROWS} SELECT feature, round(statistic, 9) AS statistic FROM k")
def ks_stat(spark, sf_dir):
    return drift.ks(*_halves(spark, sf_dir), ["amount", "hour"]).select("feature", _round("statistic", 9))


#: Kolmogorov's series; the operator counts paths at these sizes, which agrees on the verdict.
KS_DRIFT = "CASE WHEN statistic * z.s < 0.2 THEN false ELSE 2 * list_sum(list_transform(range(1, 21), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * (statistic * z.s) ** 2))) < 0.05 END"
_SIZES = "z AS (SELECT sqrt((SELECT count(*) FROM ref) * (SELECT count(*) FROM cur) / ((SELECT count(*) FROM ref) + (SELECT count(*) FROM cur))::DOUBLE) AS s)"


@register(f"WITH {HALVES}, {PSI_ROWS}, {KS_ROWS}, {_SIZES} SELECT feature, round(psi, 6) AS psi, {VERDICT} AS verdict, round(statistic, 9) AS ks_statistic, {KS_DRIFT} AS ks_drift, psi >= 0.25 AS significant FROM p JOIN k USING (feature), z")
def drift_report(spark, sf_dir):
    return drift.report(*_halves(spark, sf_dir), ["amount", "hour"]).select("feature", _round("psi"), "verdict", _round("ks_statistic", 9), "ks_drift", "significant")


@register(f"WITH {HALVES}, {PSI_ROWS}, w AS (SELECT * FROM (VALUES ('amount', 0.75), ('hour', 0.25)) AS v(feature, weight)) SELECT round(coalesce(sum(CASE WHEN psi >= 0.25 THEN weight END), 0)::DOUBLE, 6) AS share FROM p JOIN w USING (feature)")
def drift_weighted(spark, sf_dir):
    return drift.weighted_share(drift.report(*_halves(spark, sf_dir), ["amount", "hour"]), {"amount": 3.0, "hour": -1.0}).select(_round("share"))


_SCORED = f"rs AS (SELECT ({PLAIN_SCORE}) AS score FROM ref), cs AS (SELECT ({PLAIN_SCORE}) AS score FROM cur)"


@register(f"WITH {HALVES}, {_SCORED}, p AS (SELECT {_psi_sql('rs', 'cs', 'score')} AS psi) SELECT round(psi, 6) AS psi, {VERDICT} AS verdict FROM p")
def score_drift(spark, sf_dir):
    scores = [d.select(F.expr(PLAIN_SCORE).cast("double").alias("score")) for d in _halves(spark, sf_dir)]
    return drift.psi(*scores, ["score"]).select(_round("psi"), drift.verdict(F.col("psi")).alias("verdict"))


@register(f"WITH {HALVES}, {PSI_ROWS} SELECT count(*) FILTER (psi >= 0.25) AS n_significant, coalesce(bool_or(psi >= 0.25), false) AS recommend FROM p")
def retrain_recommendation(spark, sf_dir):
    return drift.recommend(drift.report(*_halves(spark, sf_dir), ["amount", "hour"]))


_LOG = "SELECT seq, ['" + "', '".join(_REASONS) + "'][1 + seq % 5] AS reason FROM ev"
_TYPE = "CASE WHEN contains(lower(reason), 'error') THEN 'executor_error' WHEN contains(lower(reason), 'range') THEN 'score_invalid' WHEN contains(lower(reason), 'exceeds') THEN 'amount_limit' ELSE 'model' END"


def _log(spark, sf_dir):
    reason = F.get(F.array(*(F.lit(r) for r in _REASONS)), (F.col("seq") % 5).cast("int"))
    return events(spark, sf_dir).withColumn("reason", reason).withColumn("decision_type", classify_reason(F.col("reason")))


@register(f"WITH {EV}, l AS ({_LOG}) SELECT {_TYPE} AS decision_type, count(*) AS n FROM l GROUP BY 1")
def log_classify(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("decision_type").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {EV}, l AS ({_LOG}) SELECT seq FROM l WHERE {_TYPE} IN ('score_invalid', 'executor_error')")
def log_operational(spark, sf_dir):
    return decision_log.operational(_log(spark, sf_dir)).select("seq")


@register(f"WITH {EV} SELECT seq FROM ev WHERE seq % 3 <> 0")
def log_dedup(spark, sf_dir):
    log = _log(spark, sf_dir)
    return decision_log.not_logged(log, log.where("seq % 3 = 0").withColumnRenamed("seq", "row_index")).select("seq")


@register("SELECT (a.k * 4 + b.k) AS cell, a.v AS amount, b.v AS hour FROM (VALUES (0, 50.0::DOUBLE), (1, 150.0), (2, 151.0)) a(k, v), (VALUES (0, 6.0::DOUBLE), (1, 12.0), (2, 18.0), (3, 19.0)) b(k, v)")
def grid_cross(spark, sf_dir):
    return training.grid(spark, TABLE.cuts, list(TABLE.features)).withColumn("cell", F.col("cell").cast("int"))


_FIRST = "m AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(h) AS mh, stddev_pop(h) AS sh, var_pop(amount) AS va, var_pop(h) AS vh, covar_pop(amount, h) AS c FROM x WHERE seq < 400)"
_X = f"x AS (SELECT *, CAST({HOUR} AS DOUBLE) AS h FROM ev)"


def _with_hour(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", feats.hour_utc().cast("double"))
    return e, e.where("seq < 400")


@register(f"WITH {EV}, {_X}, {_FIRST} SELECT seq, round(greatest(abs(amount - ma) / sa, abs(h - mh) / sh), 6) AS z FROM x, m")
def zscore_detector(spark, sf_dir):
    e, first = _with_hour(spark, sf_dir)
    return detectors.max_z(e, first, ["amount", "h"]).select("seq", _round("z"))


@register(f"WITH {EV}, {_X}, {_FIRST} SELECT seq, round((vh * (amount - ma) ** 2 - 2 * c * (amount - ma) * (h - mh) + va * (h - mh) ** 2) / (va * vh - c * c), 6) AS d2 FROM x, m")
def mahalanobis(spark, sf_dir):
    e, first = _with_hour(spark, sf_dir)
    return detectors.mahalanobis(e, first, "amount", "h").select("seq", _round("d2"))


@register(f"WITH {EV} SELECT seq, round(quantile_cont(amount, 0.5) OVER (PARTITION BY account ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS median FROM ev")
def rolling_median(spark, sf_dir):
    return detectors.rolling_median(events(spark, sf_dir), "amount", ("account",)).select("seq", _round("median"))


@register(f"WITH {EV} SELECT round(avg(({PLAIN_SCORE} - label) ** 2), 9) AS brier FROM ev")
def brier(spark, sf_dir):
    return metrics.brier(plain_scores(spark, sf_dir), "score", "label").select(_round("brier", 9))


@register(f"WITH {EV}, {CURVE}, q AS (SELECT score, tp / p::DOUBLE AS a, fp / nn::DOUBLE AS b FROM c) SELECT round(score, 9) AS threshold, round(coalesce(a * 0.01 / nullif(a * 0.01 + b * 0.99, 0), 0), 9) AS precision FROM q")
def bayes_precision(spark, sf_dir):
    return metrics.precision_at_prevalence(plain_scores(spark, sf_dir), "score", "label", 0.01).select(_round("threshold", 9), _round("precision", 9))


@register(f"WITH {EV}, s AS (SELECT ({PLAIN_SCORE}) AS score, label FROM ev) SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS rate FROM s GROUP BY 1")
def reliability(spark, sf_dir):
    return metrics.reliability(plain_scores(spark, sf_dir), "score", "label").select("bin", "n", _round("mean_score", 9), _round("rate", 9))


@register(f"WITH {EV}, {_X}, {_FIRST}, d AS (SELECT label, greatest(abs(amount - ma) / sa, abs(h - mh) / sh) > 3 AS f FROM x, m), k AS (SELECT count(*) FILTER (f AND label = 1) AS tp, count(*) FILTER (f AND label = 0) AS fp, count(*) FILTER (NOT f AND label = 1) AS fn, count(*) FILTER (NOT f AND label = 0) AS tn FROM d) SELECT round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round(fp / (fp + tn)::DOUBLE, 9) AS far, round(fn / (fn + tp)::DOUBLE, 9) AS mar FROM k")
def alarm_rates(spark, sf_dir):
    e, first = _with_hour(spark, sf_dir)
    rows = detectors.max_z(e, first, ["amount", "h"]).withColumn("fired", F.col("z") > 3)
    return metrics.alarm_rates(rows, "fired", "label").select(_round("f1", 9), _round("far", 9), _round("mar", 9))


@register(f"WITH RECURSIVE {EV}, {APOS}, {AEWMA} SELECT seq, round(ev.amount - ra.f, 6) AS delta FROM ev JOIN ra USING (seq)")
def causal_delta(spark, sf_dir):
    return feats.ewma_account(events(spark, sf_dir)).select("seq", F.round(detectors.causal_delta("amount", "ewma_account"), 6).alias("delta"))


@register(f"WITH {EV} SELECT seq, count(*) OVER w = 20 AND avg((amount > 50)::INT) OVER w >= 0.5 AS open FROM ev WINDOW w AS (PARTITION BY account ORDER BY t, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def circuit_state(spark, sf_dir):
    return detectors.circuit_state(events(spark, sf_dir).withColumn("f", F.col("amount") > 50), "f").select("seq", "open")


@register(f"WITH {EV}, h AS (SELECT seq, category AS own, {FOOT} AS h FROM ev), u AS (SELECT seq, unnest(h) AS category FROM h), c AS (SELECT seq, category, count(*) AS n FROM u GROUP BY ALL), b AS (SELECT seq, category, row_number() OVER (PARTITION BY seq ORDER BY n DESC, category) AS k FROM c) SELECT h.seq, coalesce(b.category, own) AS category FROM h LEFT JOIN b ON b.seq = h.seq AND k = 1")
def substituted_category(spark, sf_dir):
    return detectors.substitute_category(events(spark, sf_dir)).select("seq", "category")


@register("WITH q AS (SELECT o_orderkey AS seq, chr(39) || CAST(o_orderkey % 2 AS VARCHAR) || chr(39) AS label FROM orders) SELECT seq, CAST(trim(label, chr(39)) AS INTEGER) AS label FROM q")
def quoted_labels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("'"), (F.col("o_orderkey") % 2).cast("string"), F.lit("'")).alias("raw"))
    return rows.select("seq", clean_label("raw").alias("label"))


@register("WITH q AS (SELECT year(o_orderdate) AS y, o_totalprice AS v FROM orders), a AS (SELECT y, min(v) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.999) AS top, count(*) AS n FROM q GROUP BY y) SELECT CAST(y AS INTEGER) AS y, round(mid, 6) AS mid, round(top, 6) AS top, n FROM a")
def yearly_percentiles(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("feature"), F.col("o_totalprice").alias("value"))
    cuts = exact_quantiles(o, [0.5, 0.999]).select(F.col("feature").alias("y"), F.round(F.get("quantiles", F.lit(0)), 6).alias("mid"), F.round(F.get("quantiles", F.lit(1)), 6).alias("top"))
    return cuts.join(o.groupBy(F.col("feature").alias("y")).agg(F.count(F.lit(1)).alias("n")), "y")


@register(f"WITH {EV}, v AS (SELECT seq AS vseq, t AS vt, 1 + seq // 1000 AS version FROM ev WHERE seq % 1000 = 0) SELECT seq, coalesce((SELECT max_by(version, vt) FROM v WHERE v.vt <= ev.t), 0) AS policy_version FROM ev")
def policy_in_force(spark, sf_dir):
    """The policy version published last before each event: an as-of join as a running maximum per time block."""
    e = events(spark, sf_dir)
    marked = feats.with_position(e.withColumn("__v", F.when(F.col("seq") % 1000 == 0, 1 + F.floor(F.col("seq") / 1000))))
    w = Window.partitionBy("__b").orderBy("position")
    rows = marked.withColumn("__b", F.floor(F.col("position") / 4096)).withColumn("__here", F.max("__v").over(w))
    # Blocks of blocks: only the outer table, a row for 16.8 million events, is ordered as a whole.
    tops = rows.groupBy("__b").agg(F.max("__v").alias("__top")).withColumn("__o", F.floor(F.col("__b") / 4096))
    outer = tops.groupBy("__o").agg(F.max("__top").alias("__top"))
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select("__o", F.max("__top").over(before(Window.orderBy("__o"))).alias("__far"))
    past = tops.withColumn("__near", F.max("__top").over(before(Window.partitionBy("__o").orderBy("__b")))).join(outer, "__o").select("__b", "__near", "__far")
    return rows.join(past, "__b").select("seq", F.coalesce(F.greatest("__here", "__near", "__far"), F.lit(0)).alias("policy_version"))


@register(f"WITH RECURSIVE {POS}, {PRIOR}, {APOS}, {AEWMA}, h AS (SELECT *, {FOOT} AS h FROM pos) SELECT h.seq, round(ra.f, 6) AS ewma_account, round(CASE WHEN len(coalesce(h.h, [])) < 5 THEN coalesce(prior, 0) ELSE len(list_filter(h.h, lambda c: c = category)) / len(h.h)::DOUBLE END, 6) AS footprint FROM h JOIN ra ON ra.seq = h.seq LEFT JOIN prior USING (category)")
def stream_parity(spark, sf_dir):
    """The stateful processor over the same rows as the window forms, run as a stream to its end."""
    _, prior = _prior(events(spark, sf_dir))
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = read_stream(spark, sf_dir, schema, EVENTS, pathGlobFilter="events.parquet")
    out = f"{scratch_dir(spark)}/stream-parity-{uuid.uuid4().hex}"
    features = stateful.account_features(stream, prior)
    features.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("seq", _round("ewma_account"), _round("footprint"))


@register(f"WITH {EV}, {CURVE.replace('FROM s GROUP BY score', 'FROM s GROUP BY category, score').replace('SELECT score, sum(label)', 'SELECT category, score, sum(label)').replace('OVER (ORDER BY score DESC)', 'OVER (PARTITION BY category ORDER BY score DESC)').replace('OVER ()', 'OVER (PARTITION BY category)')} SELECT category, round(sum(pos / p::DOUBLE * tp / (tp + fp)::DOUBLE), 9) AS ap FROM c GROUP BY category")
def avg_precision_by_category(spark, sf_dir):
    return metrics.average_precision(plain_scores(spark, sf_dir), "score", "label", ("category",)).select("category", _round("ap", 9))


@register(f"WITH RECURSIVE ev AS (SELECT * REPLACE ({PLAIN_SCORE} AS amount) FROM (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS t, user_id AS account, value AS amount FROM events)), {APOS}, {AEWMA} SELECT seq, round(0.98 * ra.f + (1 - 0.98::DOUBLE) * ev.amount, 6) AS smoothed FROM ev JOIN ra USING (seq)")
def smoothed_score(spark, sf_dir):
    rows = feats.ewma_account(plain_scores(spark, sf_dir).withColumn("amount", F.col("score")))
    return rows.select("seq", F.round(feats.DECAY * F.col("ewma_account") + (1 - feats.DECAY) * F.col("amount"), 6).alias("smoothed"))


@register(
    "WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS p, o_totalprice AS v FROM orders), e AS (SELECT p + 1 AS period, list_sort(list_distinct([" + ", ".join(f"quantile_cont(v, {k / 10})" for k in range(11)) + "])) AS a FROM o GROUP BY p), i AS (SELECT period, a[2:len(a) - 1] AS ie FROM e WHERE period IN (SELECT p FROM o)), sp AS (SELECT period, unnest(range(0, len(ie) + 1)) AS b FROM i), rb AS (SELECT period, len(list_filter(ie, lambda x: x <= v)) AS b, count(*) AS c FROM o JOIN i ON i.period = o.p + 1 GROUP BY ALL), cb AS (SELECT period, len(list_filter(ie, lambda x: x <= v)) AS b, count(*) AS c FROM o JOIN i ON i.period = o.p GROUP BY ALL), rs AS (SELECT *, c / (sum(c) OVER (PARTITION BY period))::DOUBLE AS s FROM rb), cs AS (SELECT *, c / (sum(c) OVER (PARTITION BY period))::DOUBLE AS s FROM cb), q AS (SELECT sp.period, coalesce(rs.s, 1e-4) AS r, coalesce(cs.s, 1e-4) AS a FROM sp LEFT JOIN rs USING (period, b) LEFT JOIN cs USING (period, b)) SELECT period, round(sum((a - r) * ln(a / r)), 6) AS psi FROM q GROUP BY period"
)
def psi_by_year(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("y"), "o_totalprice")
    return drift.psi_by_period(o, "y", "o_totalprice").select("period", _round("psi"))


@register()
def train_linear_scores(spark, sf_dir):
    rows = staged(feats.linear_features(feats.with_position(events(spark, sf_dir)), SECONDS).select("seq", "label", "position", *LINEAR.features), "train-rows")
    train, val, test = splits.parts(splits.temporal_split(rows, rows.count()))
    policy = training.calibrate_linear(train, val, list(LINEAR.features))
    return test.select("seq", "label", linear_score(policy).alias("score"))


@register()
def train_boosted_scores(spark, sf_dir):
    policy, test = training.train_table_pipeline(events(spark, sf_dir), seconds=SECONDS)
    return with_table_score(test, policy).select("seq", "label", "score")


@register()
def walk_forward_validation(spark, sf_dir):
    rows = staged(feats.linear_features(feats.with_position(events(spark, sf_dir)), SECONDS).select("label", "position", *LINEAR.features), "fold-rows")
    folds, _ = training.walk_forward_validation(rows, list(LINEAR.features))
    return spark.createDataFrame([(f["fold"], f["ok"], f["auc"], f["threshold"], f["error"]) for f in folds], "fold int, ok boolean, auc double, threshold double, error string")


@register(
    f"WITH RECURSIVE {EV}, s AS (SELECT ({PLAIN_SCORE}) * 0.8 + 0.05::DOUBLE AS score FROM ev), k AS (SELECT 0 AS i, 0.05::DOUBLE AS now, NULL::DOUBLE AS last UNION ALL SELECT i + 1, (SELECT avg(score * (now / 0.05::DOUBLE) / (score * (now / 0.05::DOUBLE) + (1 - score) * ((1 - now) / (1 - 0.05::DOUBLE)))) FROM s), now FROM k WHERE i < 50 AND (last IS NULL OR abs(now - last) >= 1e-9)) SELECT round(now, 8) AS prior FROM k ORDER BY i DESC LIMIT 1"
)
def prior_shift(spark, sf_dir):
    s = staged(plain_scores(spark, sf_dir).select((F.col("score") * 0.8 + 0.05).alias("score")), "shift-scores")
    return spark.createDataFrame([(detectors.prior_shift(s, "score", 0.05),)], "prior double").select(_round("prior", 8))


#: Events some of whose amounts are missing or no number: features leave them out and flag them.
_BAD_EVENT = "(event_id % 11 = 0 OR event_id % 7 = 0)"
EVV = f"{EV[:-1]} WHERE NOT {_BAD_EVENT})"


def _with_bad(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.withColumn("amount", F.when(F.col("seq") % 11 == 0, F.lit(None)).when(F.col("seq") % 14 == 0, float("inf")).when(F.col("seq") % 7 == 0, float("nan")).otherwise(F.col("amount")))


@register(
    f"WITH RECURSIVE {EVV}, pos AS (SELECT *, row_number() OVER (ORDER BY t, seq) - 1 AS position FROM ev), {APOS}, {AEWMA}, h AS (SELECT *, {FOOT} AS h, {CNT} AS count_window FROM pos) SELECT h.seq, false AS invalid, count_window, round(ra.f, 6) AS ewma_account, round(CASE WHEN len(coalesce(h.h, [])) < 5 THEN 0 ELSE len(list_filter(h.h, lambda c: c = category)) / len(h.h)::DOUBLE END, 6) AS footprint, round(row_number() OVER (PARTITION BY category ORDER BY t, h.seq) / (position + 1)::DOUBLE, 6) AS category_frequency FROM h JOIN ra ON ra.seq = h.seq UNION ALL SELECT event_id, true, -1, -1, -1, -1 FROM events WHERE {_BAD_EVENT}"
)
def feat_invalid_events(spark, sf_dir):
    rows = feats.account_features(_with_bad(spark, sf_dir), {}, SECONDS)
    return rows.select("seq", "invalid", "count_window", _round("ewma_account"), _round("footprint"), _round("category_frequency")).fillna(-1)


@register(f"WITH RECURSIVE {EVV}, pos AS (SELECT *, row_number() OVER (ORDER BY t, seq) - 1 AS position FROM ev), {EWMA}, {LIN}, {DECIDED} SELECT seq, round(score, 6) AS score, decision_type, suspicious FROM d UNION ALL SELECT event_id, -1, CASE WHEN event_id % 11 = 0 THEN 'executor_error' ELSE 'score_invalid' END, true FROM events WHERE {_BAD_EVENT}")
def decide_invalid_events(spark, sf_dir):
    """Bad events escalate, and leave the decisions on the others as they were."""
    rows = decide(feats.linear_features(_with_bad(spark, sf_dir), SECONDS), linear_score(LINEAR), LINEAR.threshold, LIMIT)
    return rows.select("seq", _round("score"), "decision_type", "suspicious").fillna(-1, "score")


@register(f"WITH RECURSIVE {EVV}, pos AS (SELECT *, row_number() OVER (ORDER BY t, seq) - 1 AS position FROM ev), {EWMA}, q AS (SELECT r.seq, r.f, {CNT.replace('t, seq', 'pos.t, pos.seq').replace('ORDER BY t RANGE', 'ORDER BY pos.t RANGE')} AS count_window, row_number() OVER (PARTITION BY category ORDER BY pos.t, pos.seq) / (pos.position + 1)::DOUBLE AS share FROM pos JOIN r USING (seq)) SELECT seq, false AS invalid, round(f, 6) AS ewma_global, count_window, round(share, 6) AS category_frequency FROM q UNION ALL SELECT event_id, true, -1, -1, -1 FROM events WHERE {_BAD_EVENT}")
def stream_global_parity(spark, sf_dir):
    """The stream's global features over events of which some are bad, run to its end, against the same SQL."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = read_stream(spark, sf_dir, schema, EVENTS, pathGlobFilter="events.parquet")
    bad = F.when(F.col("seq") % 11 == 0, F.lit(None)).when(F.col("seq") % 7 == 0, float("nan")).otherwise(F.col("amount"))
    out = f"{scratch_dir(spark)}/stream-global-{uuid.uuid4().hex}"
    features = stateful.global_features(stream.withColumn("amount", bad), 1, SECONDS)
    features.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("seq", "invalid", _round("ewma_global"), "count_window", _round("category_frequency")).fillna(-1)


#: A fixed policy over all six features.
FULL = TablePolicy(training.TABLE_FEATURES, {"amount": [50.0, 150.0], "hour": [12.0], "count_window": [3.0], "ewma_account": [60.0], "footprint": [0.25], "category_frequency": [0.2]}, (3, 2, 2, 2, 2, 2), tuple((k * 37 % 97) / 97 for k in range(96)), (0.1, 0.4, 0.9), (0.0, 0.5, 1.0), 0.5, {"x": 1.0}).validated()
SIX = f"{POS}, {PRIOR}, {APOS}, {AEWMA}, h AS (SELECT *, {FOOT} AS h, {CNT} AS count_window FROM pos), six AS (SELECT h.seq, h.amount, {HOUR} AS hour, count_window, ra.f AS ewma_account, CASE WHEN len(coalesce(h.h, [])) < 5 THEN coalesce(prior, 0) ELSE len(list_filter(h.h, lambda c: c = category)) / len(h.h)::DOUBLE END AS footprint, row_number() OVER (PARTITION BY category ORDER BY t, h.seq) / (position + (SELECT count(*) FROM prior))::DOUBLE AS category_frequency FROM h JOIN ra ON ra.seq = h.seq LEFT JOIN prior USING (category))"


@register(
    f"WITH RECURSIVE {SIX}, cell AS (SELECT seq, amount, ((((CASE WHEN amount > 150 THEN 2 WHEN amount > 50 THEN 1 ELSE 0 END * 2 + (hour > 12)::INT) * 2 + (count_window > 3)::INT) * 2 + (ewma_account > 60)::INT) * 2 + (footprint > 0.25)::INT) * 2 + (category_frequency > 0.2)::INT AS k FROM six), x AS (SELECT seq, amount, (k * 37 % 97) / 97::DOUBLE AS x FROM cell), s AS (SELECT seq, amount, {ISO} AS score FROM x) SELECT seq, round(score, 6) AS score, CASE WHEN abs(amount) > 200 THEN 'amount_limit' ELSE 'model' END AS decision_type, abs(amount) > 200 OR score >= 0.5 AS suspicious FROM s"
)
def decide_table_full(spark, sf_dir):
    """The table policy's whole path: six features, lookup, calibration, veto."""
    rows, prior = _prior(events(spark, sf_dir))
    rows = with_table_score(feats.account_features(rows, prior, SECONDS), FULL, "s")
    return decide(rows, F.col("s"), FULL.threshold, LIMIT).select("seq", _round("score"), "decision_type", "suspicious")


@register(f"WITH {POS} SELECT seq, CASE WHEN position >= 300 THEN 'batch' ELSE 'reference' END AS part FROM pos WHERE position >= 100 AND position < 500")
def batch_slices(spark, sf_dir):
    rows = feats.with_position(events(spark, sf_dir))
    named = [f(rows, 300, 200).select("seq", F.lit(name).alias("part")) for f, name in ((splits.batch_slice, "batch"), (splits.reference_slice, "reference"))]
    return named[0].unionAll(named[1])


@register(f"WITH RECURSIVE {POS}, {EWMA}, {LIN}, {DECIDED} SELECT seq AS row_index, round(score, 6) AS score, decision_type, suspicious, round(amount, 6) AS amount, CAST(3 AS BIGINT) AS policy_version FROM d")
def log_round_trip(spark, sf_dir):
    """Decisions appended to the log in two parts and read back."""
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    made = decision_log.entries(_linear(spark, sf_dir), 3)
    for part in (0, 1):
        decision_log.append(made.where(F.col("row_index") % 2 == part), path)
    log = decision_log.since(decision_log.read(spark, path), "2000-01-01T00:00:00Z")
    return log.select("row_index", _round("score"), "decision_type", "suspicious", F.round("event.amount", 6).alias("amount"), "policy_version")


@register("SELECT event_id AS seq, epoch_us(ts) / 1e6 AS t, user_id AS account, event_type AS category, value AS amount, CAST(event_id % 2 AS INTEGER) AS label FROM events")
def csv_events(spark, sf_dir):
    """Events written as CSV with quoted labels and read with a declared schema."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    e = events(spark, sf_dir).withColumn("label", F.concat(F.lit("'"), (F.col("seq") % 2).cast("string"), F.lit("'")))
    e.write.csv(path, header=True)
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("account", T.LongType()), T.StructField("category", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("label", T.StringType())])
    return read_csv(spark, path, EventMapping("seq", "t", "account", "category", "amount", "label"), schema)


@register("SELECT CAST(l_orderkey * 10 + l_linenumber AS DOUBLE) AS t, l_extendedprice AS amount, CAST(l_linenumber % 2 AS INTEGER) AS label FROM lineitem")
def csv_transactions(spark, sf_dir):
    """A wide card table (time, components, amount, quoted class) written as CSV and read with its declared schema."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("Time"), *((F.col("l_quantity") / k).cast("double").alias(f"V{k}") for k in range(1, 29)), F.col("l_extendedprice").cast("double").alias("Amount"), F.concat(F.lit("'"), (F.col("l_linenumber") % 2).cast("string"), F.lit("'")).alias("Class"))
    wide.write.csv(path, header=True)
    return read_csv(spark, path, EventMapping("Time", "Time", amount="Amount", label="Class"), transactions_schema()).select("t", "amount", "label")


@register("SELECT event_id AS seq, epoch_us(ts) / 1e6 AS t, user_id AS account, event_type AS category, value AS amount FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT -1, -1, -1, 'none', -1 FROM events WHERE event_id % 10 = 0")
def message_events(spark, sf_dir):
    """Events out of JSON messages, a tenth of which are broken."""
    e = events(spark, sf_dir).drop("label")
    messages = e.select(F.when(F.col("seq") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("*"))).cast("binary").alias("value"))
    return from_values(messages, e.schema, EventMapping("seq", "t", "account", "category", "amount")).drop("label").fillna(-1).fillna("none")


@register(f"WITH {EV}, {_X}, {_FIRST} SELECT seq, round((vh * (amount - ma) ** 2 - 2 * c * (amount - ma) * (h - mh) + va * (h - mh) ** 2) / (va * vh - c * c), 5) AS d2 FROM x, m")
def mahalanobis_many(spark, sf_dir):
    e, first = _with_hour(spark, sf_dir)
    return detectors.mahalanobis_many(e, first, ["amount", "h"]).select("seq", _round("d2", 5))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}

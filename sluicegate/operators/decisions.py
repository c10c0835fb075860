"""Scoring by a policy, and the veto that no score overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_index, dot, flat_index, isotonic, sigmoid
from ..plans.policy import LinearPolicy, TablePolicy, TreesPolicy

AMOUNT_LIMIT = 10_000.0
#: Lookup tables up to this many cells become an array literal; larger ones are joined by cell.
LITERAL_CELLS = 4096
#: Reasons, and the type of decision that each stands for.
INVALID_SCORE, EXECUTOR_ERROR, AMOUNT, MODEL = "score_invalid", "executor_error", "amount_limit", "model"


def linear_score(policy: LinearPolicy) -> Column:
    return sigmoid(dot(policy.intercept, [(c, F.col(f).cast("double")) for f, c in zip(policy.features, policy.coefficients, strict=True)]))


def table_cell(policy: TablePolicy) -> Column:
    return flat_index([bin_index(F.col(f).cast("double"), policy.cuts[f]) for f in policy.features], policy.table_shape)


def trees_sum(policy: TreesPolicy) -> Column:
    """The weighted sum of the boosted trees, null where a feature is null."""

    def sql(node) -> str:
        if not isinstance(node, (list, tuple)):
            return f"{float(node)!r}D"
        x = f"CAST(`{policy.features[node[0]]}` AS DOUBLE)"
        return f"IF({x} <= {float(node[1])!r}D OR isnan({x}), {sql(node[2])}, {sql(node[3])})"

    terms = ", ".join(f"{float(w)!r}D * {sql(t)}" for w, t in zip(policy.weights, policy.trees, strict=True))
    known = " AND ".join(f"`{f}` IS NOT NULL" for f in policy.features)
    return F.when(F.expr(known), F.expr(f"aggregate(array({terms}), 0D, (a, x) -> a + x)"))


def with_table_score(df: DataFrame, policy: TablePolicy | TreesPolicy, name: str = "score") -> DataFrame:
    """Cell of the lookup table (or the trees' sum), then isotonic calibration."""
    if isinstance(policy, TreesPolicy):
        # The long sum is a column of its own, as the expressions after it name it several times.
        scored = df.withColumn("__sum", trees_sum(policy)).withColumn("__raw", sigmoid(2 * F.col("__sum"))).drop("__sum")
        return scored.withColumn(name, isotonic(F.col("__raw"), policy.isotonic_x, policy.isotonic_y)).drop("__raw")
    if len(policy.table) <= LITERAL_CELLS:
        raw = F.get(F.array(*(F.lit(float(v)) for v in policy.table)), table_cell(policy).cast("int"))
        return df.withColumn(name, isotonic(raw, policy.isotonic_x, policy.isotonic_y))
    spark = df.sparkSession
    cells = spark.createDataFrame([(k, float(v)) for k, v in enumerate(policy.table)], "__cell long, __raw double")
    return df.withColumn("__cell", table_cell(policy)).join(cells, "__cell", "left").withColumn(name, isotonic(F.col("__raw"), policy.isotonic_x, policy.isotonic_y)).drop("__cell", "__raw")


def valid_score(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0)


def veto(score: Column, amount: Column, threshold: float, limit: float = AMOUNT_LIMIT, error: Column | None = None) -> Column:
    """A struct (suspicious, decision_type, reason): missing inputs, then invalid scores, then the amount limit, then the model.

    NaN is no number here: it passes neither the limit nor the threshold.
    """
    bad_input = error if error is not None else F.lit(False)
    invalid = ~F.coalesce(valid_score(score), F.lit(False))
    over = ~F.isnan(amount) & (F.abs(amount) > limit)
    fired = ~F.isnan(score) & (score >= threshold)

    def verdict(suspicious: Column, kind: str, reason: str) -> Column:
        return F.struct(suspicious.alias("suspicious"), F.lit(kind).alias("decision_type"), F.lit(reason).alias("reason"))

    yes = F.lit(True)
    return (
        F.when(bad_input, verdict(yes, EXECUTOR_ERROR, "error: a required input is missing"))
        .when(invalid, verdict(yes, INVALID_SCORE, "score out of range [0, 1]"))
        .when(F.coalesce(over, F.lit(False)), verdict(yes, AMOUNT, "amount exceeds the limit"))
        .otherwise(verdict(fired, MODEL, "model"))
    )


def decide(df: DataFrame, score: Column, threshold: float, limit: float = AMOUNT_LIMIT, required: tuple[str, ...] = ("amount",)) -> DataFrame:
    """score, suspicious, decision_type and reason beside the columns; a row whose required inputs are missing has no score."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    scored = df.withColumn("score", F.when(missing, F.lit(None).cast("double")).otherwise(score))
    made = scored.withColumn("__d", veto(F.col("score"), F.col("amount"), threshold, limit, missing))
    return made.select("*", "__d.suspicious", "__d.decision_type", "__d.reason").drop("__d")


def classify_reason(reason: Column) -> Column:
    """Type of a decision from a free-text reason of an old log; the first that fits counts."""
    low = F.lower(reason)
    return F.when(low.contains("error"), EXECUTOR_ERROR).when(low.contains("range"), INVALID_SCORE).when(low.contains("exceeds"), AMOUNT).otherwise(MODEL)

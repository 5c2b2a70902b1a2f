"""Comparing two systems by win rate over held-out comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import minimum_detectable_effect, ratio
from plumbline.operators.bootstrap import bootstrap_ci, bootstrap_hash_ci, cluster_sums

#: Instability above this multiple of that in calibration is worth a caveat.
DRIFT_RATIO = 1.5


def usable() -> Column:
    return ~F.col("position_unstable") & ~F.col("parse_failed")


def policy_score(judged: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts, win rate of the system in slot A, rates, and whether the gap is too small to detect. ``judged``: all held-out items."""
    def wins(label: str) -> Column:
        return F.count_if(usable() & (F.col("winner") == label))

    counts = judged.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(usable()).alias("n_scored"), wins("A").alias("n_wins_1"), wins("B").alias("n_wins_2"),
        wins("tie").alias("n_ties"), F.count_if(F.col("position_unstable") & ~F.col("parse_failed")).alias("n_position_unstable"),
        F.count_if("parse_failed").alias("n_parse_failures"))
    rate = ratio(F.col("n_wins_1") + F.col("n_ties").cast("double") * 0.5, F.col("n_scored"))
    out = counts.withColumns({
        "win_rate": rate, "minimum_detectable_effect": minimum_detectable_effect(F.col("n_scored")),
        "decisive_rate": ratio(F.col("n_wins_1") + F.col("n_wins_2"), F.col("n_scored")),
        "instability_rate": F.coalesce(ratio(F.col("n_position_unstable"), F.col("n")), F.lit(0.0)),
        "parse_failure_rate": F.coalesce(ratio(F.col("n_parse_failures"), F.col("n")), F.lit(0.0))})
    return out.withColumn("underpowered", F.col("win_rate").isNull() | (F.abs(F.col("win_rate") - 0.5) < F.col("minimum_detectable_effect")))


def win_sums(judged: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per-cluster sums of the win rate; clusters without a usable row stay, with nothing in them."""
    value = F.when(usable(), F.when(F.col("winner") == "A", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0))
    return cluster_sums(judged, "cluster_id", value, F.when(usable(), 1.0), group_cols)


def policy_report(judged: DataFrame, group_cols: Sequence[str] = (), method: str = "vector", **bootstrap: float) -> DataFrame:
    """policy_score with the bootstrap interval of the win rate. ``method``: vector, or hash for small inputs."""
    sums = win_sums(judged, group_cols)
    ci = bootstrap_ci(sums, group_cols, **bootstrap) if method == "vector" else bootstrap_hash_ci(sums, **bootstrap)
    score = policy_score(judged, group_cols)
    return score.join(ci, list(group_cols), "left") if group_cols else score.join(F.broadcast(ci))     # one row each


def scored_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(usable()).select("row_id")


def decision() -> Column:
    """Of a row with gate_passed, underpowered, ci_lower, ci_upper; power is looked at before the interval."""
    return (F.when(~F.col("gate_passed"), F.lit("no conclusion")).when(F.col("underpowered"), F.lit("not enough data"))
            .when(F.col("ci_lower") > 0.5, F.lit("first preferred")).when(F.col("ci_upper") < 0.5, F.lit("second preferred"))
            .otherwise(F.lit("no reliable difference")))


def drift_caveat() -> Column:
    """Of a row with position_flip_rate (calibration), instability_rate and n_position_unstable (held out)."""
    return (F.when(F.col("position_flip_rate").isNotNull(), F.when(
        F.col("instability_rate") > DRIFT_RATIO * F.col("position_flip_rate"), F.lit("less stable than in calibration")))
        .when(F.col("n_position_unstable") > 0, F.lit("no calibration rate to compare with")))

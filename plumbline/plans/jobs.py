"""The three workloads as jobs over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.calibration import calibration_report, trust_gate
from plumbline.operators.judging import Judge, judge_many, length_disclosed, length_normalized
from plumbline.operators.labels import sample_comparisons
from plumbline.operators.robustness import gaming_outcomes, gaming_summary
from plumbline.operators.scoring import policy_report
from plumbline.operators.verdicts import replay
from plumbline.sources.records import exploded_labels


def calibrate_judge(comparisons: DataFrame, verdicts: DataFrame, n_sample: int = 0, seed: int = 7, **bootstrap: float) -> DataFrame:
    """Merged comparisons and recorded verdicts -> one gated report row."""
    items = sample_comparisons(comparisons.select("row_id", "cluster_id", "annotations"), n_sample, seed)
    judged = replay(items, verdicts)
    return trust_gate(calibration_report(items, exploded_labels(items), judged, order_invariant=True, **bootstrap))


def score_systems(held_out: DataFrame, judged: DataFrame, group_cols: Sequence[str] = (), **bootstrap: float) -> DataFrame:
    """Held-out comparisons and their judged rows -> one score row per group."""
    return policy_report(held_out.select(*group_cols, "row_id", "cluster_id").join(judged, "row_id"), group_cols, **bootstrap)


def live_scores(judge: Judge, held_out: DataFrame, **bootstrap: float) -> DataFrame:
    return score_systems(held_out, judge_many(judge, held_out), **bootstrap)


def padding_experiment(judge: Judge, comparisons: DataFrame, tolerance: float = 1.15) -> DataFrame:
    """One summary row per mitigation: none, length-normalized, length-disclosed."""
    out = None
    for mitigation, j in (("none", judge), ("length-normalized", length_normalized(judge, tolerance)), ("length-disclosed", length_disclosed(judge, tolerance))):
        row = gaming_summary(gaming_outcomes(j, comparisons)).select(F.lit(mitigation).alias("mitigation"), "*")
        out = row if out is None else out.unionByName(row)
    return out

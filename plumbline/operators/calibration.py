"""How far a judge agrees with human labels, against how far humans agree with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import kappa, ratio
from plumbline.operators.bootstrap import bootstrap_ci, bootstrap_statistic, cluster_sums, cluster_vectors
from plumbline.operators.labels import human_kappa, label_quality

#: Share of the human kappa that a judge must reach.
LEAST_SHARE = 0.5


def label_verdict_cells(labels: DataFrame, judged: DataFrame, group_cols: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Number of labels per item, human label and verdict, parsed items only.

    Labels collapse to one row per item and label before the join, so an item
    with many labels costs a few rows.
    """
    collapsed = labels.groupBy(*group_cols, *extra, "row_id", F.col("preferred").alias("human")).agg(F.count(F.lit(1)).alias("n"))
    verdicts = judged.filter(~F.col("parse_failed")).select(*group_cols, "row_id", F.col("winner").alias("judge_label"))
    return collapsed.join(verdicts, [*group_cols, "row_id"])


def confusion(labels: DataFrame, judged: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return label_verdict_cells(labels, judged, group_cols).groupBy(*group_cols, "human", F.col("judge_label").alias("judge")).agg(F.sum("n").alias("n"))


def judge_agreement(labels: DataFrame, judged: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """n, agreement (0 without pairs) and kappa (NULL where undefined)."""
    out = kappa(confusion(labels, judged, group_cols), "human", "judge", "n", group_cols)
    return out.select(*group_cols, F.col("n_pairs").alias("n"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"), "kappa")


def flip_rate(judged: DataFrame, group_cols: Sequence[str] = (), order_invariant: bool = False) -> DataFrame:
    """Share of parsed rows on which the judge contradicted itself; NULL for a judge that is asked once, or without rows."""
    rate = F.lit(None).cast("double") if order_invariant else ratio(
        F.count_if(F.col("position_unstable") & ~F.col("parse_failed")), F.count_if(~F.col("parse_failed")))
    return judged.groupBy(*group_cols).agg(F.count_if(~F.col("parse_failed")).alias("n_parsed"), F.count_if("parse_failed").alias("n_parse_failures"),
                                           rate.alias("position_flip_rate"))


def _beside(left: DataFrame, right: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Joins one-row-per-group results; without groups both have exactly one row."""
    return left.join(right, list(group_cols), "left") if group_cols else left.join(F.broadcast(right))


def calibration_report(items: DataFrame, labels: DataFrame, judged: DataFrame, group_cols: Sequence[str] = (), order_invariant: bool = False,
                       with_ci: bool = True, **bootstrap: float) -> DataFrame:
    """One row per group. Human ceiling and kappa use all items; the judge's numbers and clusters only parsed ones."""
    in_scope = judged.join(items.select(*group_cols, "row_id"), [*group_cols, "row_id"], "left_semi")
    out = flip_rate(in_scope, group_cols, order_invariant).withColumnRenamed("n_parsed", "n_comparisons")
    out = _beside(out, judge_agreement(labels, judged, group_cols), group_cols)
    out = _beside(out, label_quality(items, labels, group_cols), group_cols)
    out = _beside(out, human_kappa(labels, group_cols).select(*group_cols, "human_kappa"), group_cols)
    if with_ci:
        parsed = items.select(*group_cols, "row_id", "cluster_id").join(
            judged.filter(~F.col("parse_failed")).select(*group_cols, "row_id"), [*group_cols, "row_id"])
        cells = label_verdict_cells(labels, judged, group_cols)
        per_item = cells.groupBy(*group_cols, "row_id").agg(F.sum(F.when(F.col("human") == F.col("judge_label"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("all"))
        sums = cluster_sums(parsed.join(per_item, [*group_cols, "row_id"], "left"), "cluster_id", F.col("hit"), F.col("all"), group_cols)
        out = _beside(out, bootstrap_ci(sums, group_cols, **bootstrap).select(
            *group_cols, F.col("ci_lower").alias("agreement_ci_lower"), F.col("ci_upper").alias("agreement_ci_upper")), group_cols)
    return out.withColumns({"agreement": F.coalesce("agreement", F.lit(0.0)), "n": F.coalesce("n", F.lit(0).cast("bigint"))}).withColumns({
        "share_of_human_agreement": ratio(F.col("agreement"), F.nullif(F.col("human_agreement"), F.lit(0.0))),
        "share_of_human_kappa": ratio(F.col("kappa"), F.nullif(F.col("human_kappa"), F.lit(0.0)))})


#: Labels that the agreement interval tells apart; all others count as one more.
CATEGORIES = ("A", "B", "tie")


def kappa_of_cells(n: int, cell: str = "c_{}_{}") -> str:
    """SQL of kappa over the columns of an n x n table of counts; NULL without counts or where chance agreement is 1."""
    cells = [[cell.format(i, j) for j in range(n)] for i in range(n)]
    total = "(" + " + ".join(c for row in cells for c in row) + ")"
    agree = "(" + " + ".join(cells[i][i] for i in range(n)) + ")"
    products = "(" + " + ".join(f"({' + '.join(cells[i])}) * ({' + '.join(row[i] for row in cells)})" for i in range(n)) + ")"
    return f"CASE WHEN {total} > 0 AND {products} < {total} * {total} THEN ({agree} / {total} - {products} / ({total} * {total})) / (1E0 - {products} / ({total} * {total})) END"


def cluster_cells(items: DataFrame, labels: DataFrame, judged: DataFrame, group_cols: Sequence[str] = (), categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per cluster of parsed items: the table of human label x verdict as columns c_i_j, by ``categories`` and one for all others."""
    parsed = items.select(*group_cols, "row_id", "cluster_id").join(judged.filter(~F.col("parse_failed")).select(*group_cols, "row_id"), [*group_cols, "row_id"])
    rows = parsed.join(label_verdict_cells(labels, judged, group_cols), [*group_cols, "row_id"], "left")

    def place(c: str) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, categories)), F.col(c)) - 1, F.lit(-1)).cast("int")

    n = len(categories)
    at = {c: F.when(place(c) < 0, F.lit(n)).otherwise(place(c)) for c in ("human", "judge_label")}
    values = {f"c_{i}_{j}": F.when((at["human"] == i) & (at["judge_label"] == j), F.col("n")) for i in range(n + 1) for j in range(n + 1)}
    return cluster_vectors(rows, "cluster_id", values, group_cols)


def kappa_interval(items: DataFrame, labels: DataFrame, judged: DataFrame, group_cols: Sequence[str] = (), categories: Sequence[str] = CATEGORIES, **bootstrap: float) -> DataFrame:
    """group_cols, ci_lower, ci_upper of the judge's kappa: whole clusters are drawn, kappa is taken over each resample's table."""
    n = len(categories) + 1
    return bootstrap_statistic(cluster_cells(items, labels, judged, group_cols, categories), [f"c_{i}_{j}" for i in range(n) for j in range(n)],
                               F.expr(kappa_of_cells(n)), group_cols, **bootstrap)


def gate_reason(least_share: float = LEAST_SHARE) -> Column:
    """Why a report does not pass the gate, first reason that applies; NULL if it passes."""
    share = F.col("kappa") / F.col("human_kappa")
    return (F.when(F.col("kappa").isNull(), F.lit("kappa undefined"))
            .when(F.col("human_kappa").isNull(), F.lit("no human ceiling"))
            .when(F.col("human_kappa") <= 0, F.lit("human kappa not above chance"))
            .when(share < least_share, F.lit("share of human kappa too low")))


def trust_gate(report: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    return report.withColumn("gate_reason", gate_reason(least_share)).withColumn("gate_passed", F.col("gate_reason").isNull())

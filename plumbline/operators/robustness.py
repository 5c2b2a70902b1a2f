"""Whether padding or length moves a judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import ratio
from plumbline.functions.text import length_cap, pad_response
from plumbline.operators.judging import Judge, judge_many


def gaming_outcomes(judge: Judge, comparisons: DataFrame) -> DataFrame:
    """row_id, baseline and padded outcome: each comparison as it is, and with only answer A padded.

    Both variants are judged in one pass.
    """
    variants = comparisons.withColumn("_variant", F.explode(F.array(F.lit("b"), F.lit("p")))).withColumn(
        "response_a", F.when(F.col("_variant") == "p", pad_response(F.col("response_a"))).otherwise(F.col("response_a"))).withColumn(
        "row_id", F.concat("_variant", "row_id")).drop("_variant")
    judged = judge_many(judge, variants)
    variant = F.substring("row_id", 1, 1)

    def of(v: str, c: str) -> Column:
        return F.max(F.when(variant == v, F.col(c)))

    return judged.groupBy(F.expr("substring(row_id, 2)").alias("row_id")).agg(
        of("b", "winner").alias("baseline_winner"), of("b", "position_unstable").alias("baseline_unstable"),
        of("p", "winner").alias("padded_winner"), of("p", "position_unstable").alias("padded_unstable"))


def gaming_summary(outcomes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Win rates of A before and after padding, their difference, and the share of other baselines that padding turned to A."""
    usable = ~F.col("baseline_unstable") & ~F.col("padded_unstable")
    base, padded = F.col("baseline_winner") == "A", F.col("padded_winner") == "A"
    sums = outcomes.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("n_usable"), F.count_if(usable & base).alias("a"), F.count_if(usable & padded).alias("pa"),
        F.count_if(usable & ~base).alias("other"), F.count_if(usable & ~base & padded).alias("flipped"))
    return sums.select(*group_cols, "n", "n_usable", ratio(F.col("a"), F.col("n_usable")).alias("baseline_a_rate"),
                       ratio(F.col("pa"), F.col("n_usable")).alias("padded_a_rate"),
                       (ratio(F.col("pa"), F.col("n_usable")) - ratio(F.col("a"), F.col("n_usable"))).alias("padding_effect"),
                       ratio(F.col("flipped"), F.col("other")).alias("flip_rate"))


def truncation_rates(comparisons: DataFrame, group_cols: Sequence[str] = (), tolerance: float = 1.15) -> DataFrame:
    """Share of comparisons in which length normalisation cuts an answer, as they are and with answer A padded."""
    def cut(a: Column, b: Column) -> Column:
        return F.greatest(F.length(a), F.length(b)) > length_cap(a, b, tolerance)

    a, b = F.col("response_a"), F.col("response_b")
    return comparisons.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(cut(a, b), 1.0).otherwise(0.0)).alias("baseline_cut_rate"),
        F.avg(F.when(cut(pad_response(a), b), 1.0).otherwise(0.0)).alias("padded_cut_rate"))

"""Chance-corrected agreement, detectable effects and other statistics as DataFrame code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: z-scores by (alpha, power): two-sided significance, power; fixed values.
Z_SCORES = {
    (0.05, 0.80): (1.959963985, 0.841621234),
    (0.05, 0.90): (1.959963985, 1.281551566),
    (0.01, 0.80): (2.575829304, 0.841621234),
    (0.10, 0.80): (1.644853627, 0.841621234),
}


def ratio(x: Column, y: Column) -> Column:
    """x / y as double; NULL where y is zero or either is NULL."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def kappa_column(n: Column, n_agree: Column, marginal_products: Column) -> Column:
    """Cohen's kappa from integer counts; NULL without pairs or where chance agreement is 1.

    ``marginal_products``: sum over categories of the two raters' counts. Both
    sides of the test for chance agreement 1 are integers, so rounding cannot
    hide it.
    """
    n = n.cast("decimal(19,0)")
    square = (n * n).cast("decimal(38,0)")
    e = marginal_products.cast("double") / square.cast("double")
    o = n_agree.cast("double") / n.cast("double")
    return F.when((n > 0) & (marginal_products < square), (o - e) / (1 - e))


def kappa(cells: DataFrame, rater1: str, rater2: str, n: str | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """group_cols, n_pairs, agreement, kappa of a table of pairs (``n``: their multiplicity; default one each).

    Every pair becomes two half-rows that meet in one marginal table, so the
    categories of the two raters are united without a join.
    """
    count = F.lit(1).cast("bigint") if n is None else F.col(n).cast("bigint")
    zero = F.lit(0).cast("bigint")
    cells = cells.filter(F.col(rater1).isNotNull() & F.col(rater2).isNotNull())
    pairs = cells.groupBy(*group_cols, F.col(rater1).alias("_r1"), F.col(rater2).alias("_r2")).agg(F.sum(count).alias("_n"))
    halves = pairs.select(*group_cols, F.explode(F.array(
        F.struct(F.col("_r1").alias("category"), F.col("_n").alias("first"), zero.alias("second"),
                 F.when(F.col("_r1") == F.col("_r2"), F.col("_n")).otherwise(zero).alias("agree")),
        F.struct(F.col("_r2").alias("category"), zero.alias("first"), F.col("_n").alias("second"), zero.alias("agree")),
    )).alias("h")).select(*group_cols, "h.*")
    marginals = halves.groupBy(*group_cols, "category").agg(
        F.sum("first").alias("first"), F.sum("second").alias("second"), F.sum("agree").alias("agree"))
    product = F.col("first").cast("decimal(19,0)") * F.col("second").cast("decimal(19,0)")
    sums = marginals.groupBy(*group_cols).agg(
        F.coalesce(F.sum("first"), zero).alias("n_pairs"), F.coalesce(F.sum("agree"), zero).alias("n_agree"),
        F.coalesce(F.sum(product), F.lit(0)).alias("products"))
    return sums.select(*group_cols, "n_pairs", "n_agree", ratio(F.col("n_agree"), F.col("n_pairs")).alias("agreement"),
                       kappa_column(F.col("n_pairs"), F.col("n_agree"), F.col("products")).alias("kappa"))


def minimum_detectable_effect(n: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Smallest deviation from one half that ``n`` scored rows can detect; 0.5 for n <= 0 or NULL."""
    if (alpha, power) not in Z_SCORES:
        raise ValueError(f"unsupported (alpha, power): {(alpha, power)}; known: {sorted(Z_SCORES)}")
    z = sum(Z_SCORES[alpha, power])
    return F.when(n > 0, F.lit(z) * 0.5 / F.sqrt(n.cast("double"))).otherwise(F.lit(0.5))


def percent(value: Column) -> Column:
    """One decimal and a percent sign; ``n/a`` for NULL."""
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string("%.1f%%", value * 100))

"""The report as lines of text, from result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import percent
from plumbline.operators.scoring import decision, drift_caveat


def _kappa(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(F.format_string("%.3f", c))


def report_lines(results: DataFrame) -> DataFrame:
    """line_no and line of the report on one row of joined calibration and score results (with gate columns)."""
    s = F.concat
    lines = [
        s(F.lit("Decision: "), decision()),
        s(F.lit("Gate: "), F.coalesce("gate_reason", F.lit("passed"))),
        s(F.lit("Agreement with humans: "), percent(F.col("agreement"))),
        s(F.lit("Cohen's kappa: "), _kappa("kappa")),
        s(F.lit("Human-human ceiling: "), percent(F.col("human_agreement")), F.lit(" (kappa "), _kappa("human_kappa"), F.lit(")")),
        s(F.lit("Share of the ceiling: "), percent(F.col("share_of_human_agreement")), F.lit(" raw, "), percent(F.col("share_of_human_kappa")), F.lit(" chance-corrected")),
        s(F.lit("Position flips: "), percent(F.col("position_flip_rate"))),
        s(F.lit("Tie rate of labels: "), percent(F.col("tie_rate"))),
        s(F.lit("Contested: "), F.col("n_contested_annotations").cast("string"), F.lit(" labels on "), F.col("n_contested_items").cast("string"), F.lit(" items")),
        s(F.lit("Win rate: "), percent(F.col("win_rate")), F.lit(" ["), percent(F.col("ci_lower")), F.lit(", "), percent(F.col("ci_upper")), F.lit("] of "), F.col("n_scored").cast("string")),
        s(F.lit("Counts: "), F.concat_ws(" - ", F.col("n_wins_1").cast("string"), F.col("n_wins_2").cast("string"), F.col("n_ties").cast("string"))),
        s(F.lit("Smallest detectable gap: "), percent(F.col("minimum_detectable_effect"))),
        s(F.lit("Unstable: "), F.col("n_position_unstable").cast("string"), F.lit(" of "), F.col("n_heldout").cast("string")),
        s(F.lit("Caveat: "), F.coalesce(drift_caveat(), F.lit("none"))),
    ]
    return results.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def confusion_table(confusion: DataFrame) -> DataFrame:
    """human, A, B, tie, total: only these three labels are printed, and only rows that have any."""
    kept = confusion.filter(F.col("human").isin("A", "B", "tie") & F.col("judge").isin("A", "B", "tie"))
    wide = kept.groupBy("human").pivot("judge", ["A", "B", "tie"]).agg(F.sum("n")).na.fill(0)
    return wide.withColumn("total", F.col("A") + F.col("B") + F.col("tie"))


def write_report(lines: DataFrame, path: str) -> None:
    """One text file, lines in order; written whether or not the gate passed."""
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)

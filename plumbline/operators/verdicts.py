"""Recorded verdicts: conflicts, replay, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VerdictError(ValueError):
    """Verdicts are missing or contradict each other; holds a count and a few ids."""


def _raise_if_any(rows: DataFrame, what: str) -> None:
    few = [r["row_id"] for r in rows.select("row_id").limit(5).collect()]
    if few:
        raise VerdictError(f"{what}: {rows.count()} items, among them {sorted(few)}")


def resolve_conflicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per id: one that its records agree on, or an unstable tie. ``conflict`` says which.

    The result does not depend on the order of the records.
    """
    found = verdicts.groupBy(F.col("id").alias("row_id")).agg(
        F.min(F.struct("winner", "position_unstable")).alias("low"), F.max(F.struct("winner", "position_unstable")).alias("high"))
    conflict = F.col("low") != F.col("high")
    return found.select("row_id", F.when(conflict, F.lit("tie")).otherwise(F.col("low.winner")).alias("winner"),
                        F.when(conflict, F.lit(True)).otherwise(F.col("low.position_unstable")).alias("position_unstable"),
                        F.lit(False).alias("parse_failed"), conflict.alias("conflict"))


def missing_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    return items.select("row_id").join(verdicts.select("row_id"), "row_id", "left_anti")


def replay(items: DataFrame, verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """Recorded verdicts of ``items``: row_id, winner, position_unstable, parse_failed.

    An item without a verdict is an error; so is a conflict if ``strict``.
    """
    resolved = resolve_conflicts(verdicts)
    if strict:
        _raise_if_any(resolved.filter("conflict"), "contradictory verdicts")
    _raise_if_any(missing_verdicts(items, resolved), "items without a verdict")
    return items.select("row_id").join(resolved.drop("conflict"), "row_id")

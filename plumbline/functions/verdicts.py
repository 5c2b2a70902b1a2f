"""Reading verdicts out of judge replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The verdict tag of a reply; its white space is ASCII here.
VERDICT_TAG = r"\[\[\s*([ABC])\s*\]\]"


def parse_verdict(reply: Column) -> Column:
    """A, B or tie from the last tag of a reply; NULL if there is none."""
    tag = F.try_element_at(F.regexp_extract_all(reply, F.lit(VERDICT_TAG), F.lit(1)), F.lit(-1))
    return F.when(tag == "C", F.lit("tie")).otherwise(tag)


def flip_slots(winner: Column) -> Column:
    return F.when(winner == "A", F.lit("B")).when(winner == "B", F.lit("A")).otherwise(winner)


def reconcile(first: Column, swapped: Column) -> Column:
    """struct(winner, position_unstable, parse_failed) of the verdicts in both slot orders.

    Without a verdict in one of them: a tie, stable, parse failed. Verdicts
    that contradict each other: a tie, unstable.
    """
    failed = first.isNull() | swapped.isNull()
    same = first == flip_slots(swapped)
    return F.struct(
        F.when(failed, F.lit("tie")).when(same, first).otherwise(F.lit("tie")).alias("winner"),
        F.when(failed, F.lit(False)).otherwise(~same).alias("position_unstable"),
        failed.alias("parse_failed"))

"""The report in sections: what to conclude, how far the judge can be trusted, the comparison, and caveats.

The lines are SQL text over one row of joined calibration and score results, so
that any engine can write the same report. ``{pct:x}`` stands for a percentage
with one decimal, ``{num:x}`` for three decimals; both are ``n/a`` for NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scoring import DRIFT_RATIO

SECTIONS = ("Conclusion", "Trust in the judge", "Where judge and humans differ", "Comparison", "Caveats")
CONFUSION = 2


def _trust_note() -> str:
    return ("CASE WHEN human_agreement IS NULL THEN '' ELSE ' Judge and humans agree on {pct:agreement} of the labels, two humans on {pct:human_agreement}.' END")


def section_lines(first: str, second: str) -> list[tuple[int, str, str]]:
    """(section, condition, line) in order; a line is left out where its condition does not hold."""
    shaky = f"instability_rate > {DRIFT_RATIO}E0 * position_flip_rate"
    unknown = "position_flip_rate IS NULL AND n_position_unstable > 0"
    sure = "gate_reason IS NULL AND NOT underpowered"
    return [
        (0, "gate_reason IS NOT NULL", "'No conclusion: the judge did not pass the gate (' || gate_reason || '), so its verdicts say nothing about preference.'"),
        (0, "gate_reason IS NULL AND underpowered", "'Too little data: {txt:n_scored} scored comparisons show only win rates outside {pct:0.5E0 - minimum_detectable_effect} to "
            "{pct:0.5E0 + minimum_detectable_effect}. That is no evidence of equality.'"),
        (0, f"{sure} AND ci_lower > 0.5E0", f"'{first} is preferred: win rate {{pct:win_rate}}, interval {{pct:ci_lower}} to {{pct:ci_upper}}.' || {_trust_note()}"),
        (0, f"{sure} AND ci_upper < 0.5E0", f"'{second} is preferred: win rate {{pct:1E0 - win_rate}}, interval of the other {{pct:ci_lower}} to {{pct:ci_upper}}.' || {_trust_note()}"),
        (0, f"{sure} AND NOT coalesce(ci_lower > 0.5E0, false) AND NOT coalesce(ci_upper < 0.5E0, false)", f"'No reliable difference: the interval {{pct:ci_lower}} to {{pct:ci_upper}} holds one half.' || {_trust_note()}"),
        (1, "true", "'Measured on {txt:n_comparisons} comparisons with {txt:n} human labels.'"),
        (1, "true", "'Agreement with humans: {pct:agreement}'"),
        (1, "true", "'Cohen''s kappa: {num:kappa}'"),
        (1, "human_agreement IS NOT NULL", "'Agreement between humans (the ceiling): {pct:human_agreement}, kappa {num:human_kappa}'"),
        (1, "human_agreement IS NOT NULL", "'Share of the ceiling: {pct:share_of_human_agreement} raw, {pct:share_of_human_kappa} beyond chance'"),
        (1, "human_agreement IS NULL", "'Agreement between humans is unknown: too few comparisons have several labels.'"),
        (1, "position_flip_rate IS NOT NULL", "'Verdicts that change with the slot order: {pct:position_flip_rate}'"),
        (1, "position_flip_rate IS NULL", "'Slot order: not tested, the judge is asked once.'"),
        (1, "n_parse_failures > 0", "'Left out, no verdict in the reply: {txt:n_parse_failures} comparisons'"),
        (1, "true", "'Labels: {pct:tie_rate} ties; {txt:n_contested_annotations} labels on {txt:n_contested_items} items on which humans disagree'"),
        (3, "win_rate IS NOT NULL", f"'{first} wins {{pct:win_rate}} of {{txt:n_scored}} scored comparisons, interval {{pct:ci_lower}} to {{pct:ci_upper}}.'"),
        (3, "win_rate IS NOT NULL", f"'{first} {{txt:n_wins_1}}, {second} {{txt:n_wins_2}}, ties {{txt:n_wins_0}}'"),
        (3, "win_rate IS NULL", "'Nothing could be scored: the judge contradicted itself or gave no verdict every time.'"),
        (3, "true", "'Decided, not tied: {pct:decisive_rate}'"),
        (3, "true", "'Smallest gap to be seen: {pct:minimum_detectable_effect}'"),
        (3, "n_position_unstable > 0", "'Left out, verdict changes with the slot order: {txt:n_position_unstable} of {txt:n_heldout} ({pct:instability_rate})'"),
        (3, "n_unparsed > 0", "'Left out, no verdict in the reply: {txt:n_unparsed} of {txt:n_heldout} ({pct:parse_failure_rate})'"),
        (4, f"coalesce({shaky}, false)", "'The judge is less stable here ({pct:instability_rate}) than in calibration ({pct:position_flip_rate}).'"),
        (4, unknown, "'There is no calibration rate to compare with: {pct:instability_rate} of the comparisons changed with the slot order.'"),
        (4, f"NOT coalesce({shaky}, false) AND NOT ({unknown})", "'Nothing to report.'"),
    ]


def in_sql(line: str, printf: str) -> str:
    """A line with its placeholders written out; ``printf``: the engine's function of that kind."""
    def one(m: re.Match) -> str:
        kind, x = m.groups()
        shown = {"pct": f"{printf}('%.1f%%', round(({x}) * 100E0, 1))", "num": f"{printf}('%.3f', round({x}, 3))", "txt": f"CAST({x} AS VARCHAR(20))"}[kind]
        return f"' || CASE WHEN ({x}) IS NULL THEN 'n/a' ELSE {shown} END || '"

    return re.sub(r"\{(pct|num|txt):([^}]*)\}", one, line)


def report_sections(results: DataFrame, confusion: DataFrame, first: str = "The first", second: str = "The second") -> DataFrame:
    """section, line_no and line. ``results``: one row, as in ``section_lines``; ``confusion``: human, A, B, tie, total.

    Only rows of the confusion table that have labels are shown.
    """
    lines = [F.when(F.expr(condition), F.struct(F.lit(section).alias("section"), F.lit(n).alias("line_no"), F.expr(in_sql(line, "format_string")).alias("line")))
             for n, (section, condition, line) in enumerate(section_lines(first, second))]
    told = results.select(F.explode(F.array_compact(F.array(*lines))).alias("x")).select("x.*")
    rows = confusion.filter("total > 0").select(
        F.lit(CONFUSION).alias("section"), F.expr("CASE human WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END").alias("line_no"),
        F.concat_ws(" | ", "human", *[F.col(c).cast("string") for c in ("A", "B", "tie", "total")]).alias("line"))
    head = results.select(F.lit(CONFUSION).alias("section"), F.lit(0).alias("line_no"), F.lit("human / judge | A | B | tie | total").alias("line"))
    return told.unionByName(rows).unionByName(head)

"""String functions of the robustness checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler put around an answer; fixed values.
PADDING = ("Let me carefully consider every angle of this question before answering, "
           "since a thorough response should leave no aspect unexamined. ")
RESTATEMENT = (" To summarize and make sure everything above is completely clear: the "
               "points made here reflect a careful, considered treatment of the "
               "question, and I hope this thorough response has been genuinely helpful.")


def pad_response(text: Column) -> Column:
    return F.concat(F.lit(PADDING), text, F.lit(RESTATEMENT))


def truncate_at_word(text: Column, most: Column) -> Column:
    """``text`` if at most ``most`` characters; else cut at the last space before ``most`` (a space at the very start does not count), stripped at the right, and ``...``."""
    head = F.substring(text, F.lit(1), most)
    at = F.length(head) - F.instr(F.reverse(head), " ")          # place of the last space, from 0
    cut = F.when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit("...")))


def length_cap(a: Column, b: Column, tolerance: float = 1.15) -> Column:
    """Whole part of the shorter length times ``tolerance``, in double arithmetic."""
    return F.floor(F.least(F.length(a), F.length(b)).cast("double") * F.lit(float(tolerance))).cast("int")


def length_note(a: Column, b: Column, threshold: float = 1.15) -> Column:
    """Note on both lengths where they differ by more than ``threshold``; empty otherwise, and where one is empty."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    note = F.concat(
        F.lit("Note: Assistant A's answer is "), F.length(a).cast("string"), F.lit(" characters and Assistant B's answer is "),
        F.length(b).cast("string"), F.lit(" characters — a substantial length difference. Judge strictly on substance; "
                                          "a longer answer that says the same thing is not better for being longer.\n\n"))
    return F.when((shorter > 0) & (longer.cast("double") / shorter.cast("double") > F.lit(float(threshold))), note).otherwise(F.lit(""))

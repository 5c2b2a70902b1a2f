"""Operators on comparisons, labels and verdicts."""

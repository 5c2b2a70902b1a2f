"""Spark jobs for pairwise preference labels and judge calibration."""

"""Jobs over append-only logs as streams."""

"""Features, splits, chunks, scoring, metrics."""

"""Column-level helpers that stay inside Spark's own expressions."""

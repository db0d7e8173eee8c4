"""Risk analytics on Spark: batch and streaming operators for financial-crime detection."""

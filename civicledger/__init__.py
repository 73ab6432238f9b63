"""Public-spending analytics on Spark: ingestion, queries, flags and reports."""

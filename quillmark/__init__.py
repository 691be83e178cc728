"""A search and ingest engine for personal history, on Spark DataFrames."""

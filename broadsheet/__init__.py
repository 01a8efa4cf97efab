"""Batch and streaming jobs for news intelligence at scale, on Spark DataFrames."""

"""Millrace: an append-only topic-log engine expressed as Spark DataFrames and streams."""

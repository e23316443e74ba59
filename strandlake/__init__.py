"""Sequence-collection analytics expressed as Spark DataFrames."""

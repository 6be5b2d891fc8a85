"""Anchor-based retrieval analytics and data preparation on Spark DataFrames."""

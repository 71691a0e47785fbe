"""Retrieval analytics over video keyframes, as PySpark DataFrames."""

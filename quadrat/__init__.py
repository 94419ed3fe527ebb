"""Quadrat: linear models with many fixed effects, and table tools, on Spark DataFrames."""

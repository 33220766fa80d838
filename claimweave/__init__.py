"""Claim mining, curation, graph building and evaluation on Spark DataFrames."""

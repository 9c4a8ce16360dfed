"""Temporal property-graph analytics expressed with Spark DataFrames."""

"""Provenance-first graph analytics on Spark DataFrames."""

"""Tracking, lineage and corpus analytics on Spark DataFrames."""

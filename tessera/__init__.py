"""Retrieval and temporal knowledge-graph analytics on PySpark DataFrames."""

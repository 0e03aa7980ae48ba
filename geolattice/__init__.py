"""Manifold learning and neighbourhood-graph analytics on Spark DataFrames."""

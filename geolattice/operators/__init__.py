"""Operators from points and edges to embeddings; each takes and returns DataFrames."""

"""Example-driven document retrieval on Spark: learn from a few documents, rank a corpus."""

"""Retrieval analytics over batches of documents and queries, on Spark."""

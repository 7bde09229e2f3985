"""Spark jobs for weighted digraphs, orderings of their nodes and the geometry of embeddings."""

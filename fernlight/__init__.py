"""Fernlight: a Spark-native indexing and hybrid-retrieval engine for Markdown corpora."""

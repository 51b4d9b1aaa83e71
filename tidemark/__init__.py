"""Tidemark: document ingestion, hybrid search and corpus preparation on Spark DataFrames."""

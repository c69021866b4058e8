"""Spark-first retrieval analytics: chunking, lexical and vector search, fusion, facts, timelines and graphs."""

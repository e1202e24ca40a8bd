"""Operators: schema catalog, profiling, summaries, enrichment, embedding,
vector index, retrieval and reranking. Each takes and returns DataFrames."""

"""lakesonar: dataset discovery over a data lake, expressed as Spark jobs.

Inventory files and catalog tables, profile whole tables as aggregations,
assemble JSON summaries, enrich and embed them in batch, keep them in an
idempotent Parquet vector index and answer a table of questions by top-k
similarity search followed by candidate reranking.
"""

__version__ = "0.1.0"

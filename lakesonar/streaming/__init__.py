"""Periodic indexing: mergeable statistics and the file-stream re-index."""

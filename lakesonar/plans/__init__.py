"""Plans: the registered query catalogue and the end-to-end lake search."""

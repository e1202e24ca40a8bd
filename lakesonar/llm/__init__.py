"""Training-data operators: ten numbered operators over `documents`, `pages`
and `benchmark`, and the stages that ``corpus_pipeline.py`` puts together.

Nothing else in the library imports this subpackage.
"""

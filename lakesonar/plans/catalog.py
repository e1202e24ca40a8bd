"""Imports every query module so that all queries are registered."""

from lakesonar.plans import q_profile, q_search, q_sources, q_stream, q_text  # noqa: F401

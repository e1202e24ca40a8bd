"""Reply parsing and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reply pattern (first ':' followed by a dotted name) and the
# fallback answer when the model call fails.
REPLY_NAME = r"(?U):\s*([\w\.]+)"
UNKNOWN_TABLE = "UnknownTable"


def strip(c: Column) -> Column:
    """Python-style ``strip``: all Unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_table_name(reply: Column) -> Column:
    """First ``:\\s*([\\w.]+)`` of the reply, else the stripped reply."""
    m = F.regexp_extract(reply, REPLY_NAME, 1)
    return F.when(m != "", m).otherwise(strip(reply))


def best_or_unknown(reply: Column, failed: Column) -> Column:
    """A failed call answers ``UnknownTable``."""
    return F.when(failed | reply.isNull(), F.lit(UNKNOWN_TABLE)).otherwise(parse_table_name(reply))

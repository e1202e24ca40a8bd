"""JSON repair as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The repair patterns.
JSON_SPAN = r"(?s)\{.*\}"          # first '{' to last '}' (greedy)
TRAILING_COMMA = r",\s*(\}|\])"     # a comma before a closing brace or bracket


def extract_json(text: Column) -> Column:
    """Substring from the first '{' to the last '}'; NULL when there is none."""
    span = F.regexp_extract(text, JSON_SPAN, 0)
    return F.when(span != "", span)


def remove_trailing_commas(s: Column) -> Column:
    """Delete commas before '}' or ']' (also inside string literals, as the reference) (R2)."""
    return F.regexp_replace(s, TRAILING_COMMA, "$1")


def repair(text: Column) -> Column:
    """R1 then R2."""
    return remove_trailing_commas(extract_json(text))


def try_parse(s: Column) -> Column:
    """Variant of the repaired text, NULL when it is not valid JSON."""
    return F.try_parse_json(s)


def indented(js: Column) -> Column:
    """A JSON text indented by two spaces, its keys in their order; NULL if it does
    not parse. For the few candidates of a question, one Arrow batch at a time."""
    @F.pandas_udf("string")
    def indent(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False) if t else None
            except ValueError:
                return None
        return texts.map(one)
    return indent(js)

"""Deterministic offline semantic types and descriptions (E5), by column name, sample and dtype."""

from __future__ import annotations

# Fixed values: (semantic type, column-name regex), first match wins.
NAME_RULES = [
    ("latitude", r"(?i)(^|_)lat(itude)?$"),
    ("longitude", r"(?i)(^|_)(lon|lng|longitude)$"),
    ("email", r"(?i)e_?mail"),
    ("url", r"(?i)(url|link|href)"),
    ("ip", r"(?i)((^|_)ip(_|$)|ip_?addr)"),
    ("zip", r"(?i)(zip|postal)"),
    ("city", r"(?i)(city|town)"),
    ("gender", r"(?i)(gender|sex)"),
    ("supplier", r"(?i)(supp|vendor)"),
    ("company", r"(?i)(company|cust|brand|org)"),
    ("location", r"(?i)(nation|region|country|location|address|geo)"),
]
# Fixed values: (semantic type, sample regex) for string columns.
SAMPLE_RULES = [
    ("url", r"^https?://"),
    ("email", r"^[^@ ]+@[^@ ]+\.[a-z]+$"),
]


def sql_semantic_type(column: str = "column_name", dtype: str = "dtype",
                      first_sample: str = "element_at(samples, 1)", duck: bool = False) -> str:
    """SQL CASE giving the semantic type; ``duck=True`` renders DuckDB syntax."""
    def m(e, rx):
        return f"regexp_matches({e}, '{rx}')" if duck else f"{e} RLIKE r'{rx}'"
    whens = [f"WHEN {m(column, rx)} THEN '{t}'" for t, rx in NAME_RULES]
    whens.append(f"WHEN {dtype} = 'number' THEN 'number'")
    whens.append(f"WHEN {dtype} = 'date' THEN 'date'")
    whens += [f"WHEN {first_sample} IS NOT NULL AND {m(first_sample, rx)} THEN '{t}'"
              for t, rx in SAMPLE_RULES]
    whens.append(f"WHEN {dtype} = 'category' THEN 'category'")
    return "CASE " + " ".join(whens) + " ELSE 'text' END"


def sql_description(table: str = "table_name", column: str = "column_name",
                    semantic: str = "semantic_type", dtype: str = "dtype") -> str:
    """Template description of a column (Spark and DuckDB syntax alike)."""
    return (f"concat('Column ', {column}, ' of table ', {table}, ' holds ', {dtype}, "
            f"' values of semantic type ', {semantic}, '.')")

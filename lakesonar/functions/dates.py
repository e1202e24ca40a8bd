"""Date detection for string columns.

One format must parse every non-blank value of a column; formats are tried
in the order below and the first that covers the whole column wins. The ISO 'T'
form may end in a zone (Z or an offset); without one it is in the session's zone.
"""

from __future__ import annotations

# Fixed values: (name, guard regex, Spark datetime pattern) in priority order.
DATE_FORMATS = [
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$", "yyyy-MM-dd HH:mm:ss[.SSSSSS]"),
    ("iso_t", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$",
     "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"),
    ("compact", r"^\d{8}$", "yyyyMMdd"),
    ("year", r"^\d{4}$", "yyyy"),
    ("us", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("eu", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]
# The year range a bare four-digit year must fall in.
YEAR_MIN, YEAR_MAX = 1678, 2261
# Cheap conditions that every value of a format meets; others reach neither the regex nor the parser, whose
# refusals are dear.
_MONTH = "substr({e}, %d, 2) BETWEEN '01' AND '12'"
QUICK = {
    "iso_date": "length({e}) = 10 AND " + _MONTH % 6,
    "iso_datetime": "length({e}) >= 19 AND " + _MONTH % 6,
    "iso_t": "length({e}) >= 19 AND " + _MONTH % 6,
    "compact": "length({e}) = 8 AND " + _MONTH % 5,
    "year": "length({e}) = 4",
    "us": "length({e}) BETWEEN 8 AND 10 AND try_cast(split_part({e}, '/', 1) AS INT) BETWEEN 1 AND 12",
    "eu": "length({e}) BETWEEN 8 AND 10 AND try_cast(split_part({e}, '/', 2) AS INT) BETWEEN 1 AND 12",
}


def sql_parse_with(e: str, name: str, regex: str, pattern: str) -> str:
    """SQL text that parses ``e``: NULL when the value does not fit the format."""
    guard = f"{QUICK[name].format(e=e)} AND {e} RLIKE r'{regex}'" if name in QUICK else f"{e} RLIKE r'{regex}'"
    if name == "year":
        guard += f" AND try_cast({e} AS INT) BETWEEN {YEAR_MIN} AND {YEAR_MAX}"
    pat = pattern.replace("'", "\\'")
    return f"(CASE WHEN {guard} THEN try_to_timestamp({e}, '{pat}') END)"

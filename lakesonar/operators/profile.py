"""Whole-table column profiling.

A profile is made of small plans, each reading only the columns and doing only the work that it needs:

* :func:`column_stats`: one global aggregate for each table (and for each ``WIDE`` columns of it) with
  counts, spread and extremes on native values, turned into one row per column at its end.
* :func:`typed_cells`: (column number, value) streams, one for each native type, so that a key holds one
  value and not a place for every type. :func:`distinct_counts`, :func:`date_formats` and
  :func:`sample_values` read them; map-side partial aggregation collapses repeated values (a flag, a
  constant) before their exchanges.
* :func:`sample_values`: values that cannot be among the smallest ``md5`` of their column are dropped in the scan.

Statistics of files (``streaming/stats.py``) read the generic *cell* stream (:func:`cells`), which
carries every type and the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.functions.dates import DATE_FORMATS, sql_parse_with
from lakesonar.functions.render import (INTEGRAL, iso_text, kind_of, quote, sql_double_text, sql_iso_text,
                                        sql_local_text, sql_nan_to_null, sql_value_text)

# The cardinality ratio under which a string column is a category.
CATEGORY_RATIO = 0.5
# Texts longer than this are grouped by their md5 (32 bytes) instead of the
# text itself, so the value-count shuffle does not carry whole documents.
LONG_TEXT = 256

KEYS = ["table_name", "ordinal"]
EXTREMES = ["min_num", "max_num", "min_lnum", "max_lnum", "min_ts", "max_ts", "min_tn", "max_tn", "min_dec", "max_dec"]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _as_items(tables) -> list[tuple[str, DataFrame]]:
    if isinstance(tables, dict):
        return list(tables.items())
    return list(tables)


def column_catalog(tables) -> DataFrame:
    """(table_name, ordinal, column_name, spark_type, kind, integral) from schemas."""
    from pyspark.sql import SparkSession
    rows = []
    for name, df in _as_items(tables):
        for i, f in enumerate(df.schema.fields):
            rows.append((name, i, f.name, f.dataType.simpleString(), kind_of(f.dataType),
                         isinstance(f.dataType, INTEGRAL)))
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, spark_type string, "
              "kind string, integral boolean")


def cells(tables, sample_rows: int | None = None, keep_long: bool = False,
          only: set | None = None, part_col: str | None = None) -> DataFrame | None:
    """(table_name, ordinal, num, lnum, ts, tn, text, hkey, is_str): one row per cell of every table.

    Values keep a cheap native key: integers in ``lnum``, doubles in ``num``
    (NaN → NULL, -0.0 → 0.0), instants in ``ts``, dates and times without a zone in ``tn``; strings, floats, decimals,
    booleans and nested values in ``text`` (``sql_value_text``). Text is
    rendered for numbers and temporals only later, for distinct values.
    Decimals also fill ``num`` (for std/min/max). ``only``: the
    (table_name, ordinal) pairs to emit (other tables are not read, other
    columns are pruned); ``None`` when nothing is left. ``part_col``: a
    column of every table carried on each cell as ``part`` (not profiled).
    """
    parts = []
    for name, df in _as_items(tables):
        if only is not None and not any(t == name for t, _ in only):
            continue
        if sample_rows is not None:
            df = df.limit(sample_rows)
        structs = []
        for i, f in enumerate(df.schema.fields):
            if (only is not None and (name, i) not in only) or f.name == part_col:
                continue
            c = quote(f.name)
            dt = f.dataType
            k = kind_of(dt)
            num, lnum, ts, tn, text = "NULL", "NULL", "NULL", "NULL", sql_value_text(c, dt)
            if isinstance(dt, INTEGRAL):
                lnum, text = f"CAST({c} AS BIGINT)", "NULL"
            elif isinstance(dt, T.DoubleType):
                num, text = sql_nan_to_null(c, dt), "NULL"
            elif k == "number":
                num = f"CAST({sql_nan_to_null(c, dt)} AS DOUBLE)"
            elif isinstance(dt, T.TimestampType):
                ts, text = c, "NULL"
            elif k == "temporal":  # no zone: the session's must not move it
                tn, text = f"CAST({c} AS TIMESTAMP_NTZ)", "NULL"
            hkey = "NULL"
            if text != "NULL" and (k == "string" or k == "other"):
                v = text
                hkey = f"CASE WHEN length({v}) > {LONG_TEXT} THEN md5({v}) END"
                if not keep_long:
                    text = f"CASE WHEN length({v}) <= {LONG_TEXT} THEN {v} END"
            structs.append(f"named_struct('ordinal', {i}, 'num', CAST({num} AS DOUBLE), "
                           f"'lnum', CAST({lnum} AS BIGINT), 'ts', CAST({ts} AS TIMESTAMP), 'tn', CAST({tn} AS TIMESTAMP_NTZ), "
                           f"'text', CAST({text} AS STRING), 'hkey', CAST({hkey} AS STRING), "
                           f"'is_str', {'true' if k == 'string' else 'false'})")
        lit_name = name.replace("\\", "\\\\").replace("'", "\\'")
        carry = [f"CAST({quote(part_col)} AS STRING) AS part"] if part_col else []
        parts.append(df.selectExpr(f"'{lit_name}' AS table_name", *carry,
                                   f"inline(array({', '.join(structs)}))"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


VALUE_TEXT = (f"coalesce(text, CAST(lnum AS STRING), {sql_double_text('num')}, "
              + sql_iso_text("ts") + ", " + sql_local_text("tn") + ")")
# identity of a value for null tests and sketches: long texts by their hash
VALUE_KEY = f"coalesce({VALUE_TEXT}, hkey)"


def has_decimals(items) -> bool:
    return any(isinstance(f.dataType, T.DecimalType) for _, df in items for f in df.schema.fields)


# A table of one narrow row a column is sent to every task up to this many columns.
MAX_BROADCAST_COLUMNS = 100_000


def per_column(df: DataFrame, n_columns: int) -> DataFrame:
    """A frame of one narrow row for each of ``n_columns`` columns, broadcast within the bound: joined to cells or
    values it must not bring all those of a column into one task."""
    return F.broadcast(df) if n_columns <= MAX_BROADCAST_COLUMNS else df


# The columns of one global aggregate, so that its code stays small.
WIDE = 25


def _table_literal(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _union(parts: list) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.union(p)
    return out


def _per_column_rows(df: DataFrame, aggs: list[str], structs: list[str]) -> DataFrame:
    """Global aggregates of a table, as one row per column; none for an empty table."""
    return (df.selectExpr("count(1) AS n_rows", *aggs).filter("n_rows > 0")
            .selectExpr(f"inline(array({', '.join(structs)}))"))


def column_stats(items) -> DataFrame:
    """(table_name, ordinal, n_rows, n_non_null, std, extremes, nb): row and value counts, sample standard
    deviation, min and max of every column in its own type; ``nb``: the non-blank values of a string column."""
    decimals, parts = has_decimals(items), []
    for name, df in items:
        fields = list(enumerate(df.schema.fields))
        for at in range(0, len(fields), WIDE):
            aggs, structs = [], []
            for i, f in fields[at:at + WIDE]:
                dt, kind = f.dataType, kind_of(f.dataType)
                x = sql_nan_to_null(quote(f.name), dt)
                out = dict.fromkeys(["std", *EXTREMES, "nb"], "NULL")
                aggs.append(f"count({x}) AS n{i}")
                if kind in ("number", "temporal"):
                    if kind == "temporal" and not isinstance(dt, T.TimestampType):  # no zone: the session's must not move it
                        x = f"CAST({x} AS TIMESTAMP_NTZ)"
                    aggs += [f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
                if kind == "number":
                    aggs.append(f"stddev_samp(CAST({x} AS DOUBLE)) AS sd{i}")
                    out |= {"std": f"sd{i}", "min_num": f"lo{i}", "max_num": f"hi{i}"}
                    if isinstance(dt, INTEGRAL):
                        out |= {"min_lnum": f"lo{i}", "max_lnum": f"hi{i}"}
                    elif decimals and not isinstance(dt, T.DoubleType):
                        out |= {"min_dec": f"lo{i}", "max_dec": f"hi{i}"}
                elif kind == "temporal":
                    end = "ts" if isinstance(dt, T.TimestampType) else "tn"
                    out |= {f"min_{end}": f"lo{i}", f"max_{end}": f"hi{i}"}
                elif kind == "string":
                    aggs.append(f"count_if({x} <> '') AS nb{i}")
                    out["nb"] = f"nb{i}"
                typed = ", ".join(f"'{c}', CAST({e} AS {STAT_TYPES[c.split('_')[-1]]})" for c, e in out.items())
                structs.append(f"named_struct('table_name', {_table_literal(name)}, 'ordinal', {i}, 'n_rows', n_rows, "
                               f"'n_non_null', n{i}, {typed})")
            if structs:
                parts.append(_per_column_rows(df, aggs, structs))
    return _union(parts)


STAT_TYPES = {"std": "DOUBLE", "num": "DOUBLE", "lnum": "BIGINT", "ts": "TIMESTAMP", "tn": "TIMESTAMP_NTZ",
              "dec": "STRING", "nb": "BIGINT"}


def approx_counts(items) -> DataFrame:
    """(table_name, ordinal, num_unique_values) from HLL sketches of native values (long texts by their md5)."""
    parts = []
    for name, df in items:
        fields = list(enumerate(df.schema.fields))
        for at in range(0, len(fields), WIDE):
            aggs, structs = [], []
            for i, f in fields[at:at + WIDE]:
                native, v = native_value(f)
                if native == "string" and kind_of(f.dataType) in ("string", "other"):
                    v = f"CASE WHEN length({v}) > {LONG_TEXT} THEN md5({v}) ELSE {v} END"
                elif kind_of(f.dataType) == "number" and native == "string":
                    v = f"CASE WHEN {v} IS NOT NULL THEN named_struct('num', CAST({sql_nan_to_null(quote(f.name), f.dataType)} AS DOUBLE), 't', {v}) END"
                aggs.append(f"approx_count_distinct({v}) AS u{i}")
                structs.append(f"named_struct('table_name', {_table_literal(name)}, 'ordinal', {i}, 'num_unique_values', u{i})")
            if structs:
                parts.append(_per_column_rows(df, aggs, structs))
    return _union(parts)


def native_value(f: T.StructField) -> tuple[str, str]:
    """(type, SQL) of the cheap native value that tells a column's values apart."""
    c, dt = quote(f.name), f.dataType
    if isinstance(dt, INTEGRAL):
        return "bigint", f"CAST({c} AS BIGINT)"
    if isinstance(dt, T.DoubleType):
        return "double", sql_nan_to_null(c, dt)
    if isinstance(dt, T.TimestampType):
        return "timestamp", c
    if kind_of(dt) == "temporal":  # no zone: the session's must not move it
        return "timestamp_ntz", f"CAST({c} AS TIMESTAMP_NTZ)"
    return "string", f"CAST({sql_value_text(c, dt)} AS STRING)"


def native_text(native: str, e: str) -> str:
    """SQL of the text of a native value."""
    make = {"bigint": "CAST({} AS STRING)".format, "double": sql_double_text, "timestamp": sql_iso_text,
            "timestamp_ntz": sql_local_text, "string": str}
    return make[native](e)


NATIVE_TEXT = {native: native_text(native, "v") for native in ("bigint", "double", "timestamp", "timestamp_ntz", "string")}


def column_numbers(items) -> dict[tuple[str, int], int]:
    """The number of every (table_name, ordinal) in the lake: a short key for its cells."""
    keys = [(name, i) for name, df in items for i in range(len(df.columns))]
    return {k: n for n, k in enumerate(keys)}


def numbers_frame(items, spark) -> DataFrame:
    rows = [(n, *k) for k, n in column_numbers(items).items()]
    return spark.createDataFrame(rows, "col int, table_name string, ordinal int")


def typed_cells(items, only: set | None = None, kinds: tuple | None = None, part_col: str | None = None) -> dict[str, DataFrame]:
    """(col, v): the values of every column that are not null, one stream for each native type.
    ``only``: the (table_name, ordinal) pairs to emit; ``kinds``: the kinds of columns to emit; ``part_col``: a
    column of every table carried on each value as ``part``, in front (not a column of the lake)."""
    number, parts = column_numbers(items), {}
    carry = [f"CAST({quote(part_col)} AS STRING) AS part"] if part_col else []
    for name, df in items:
        by_type = {}
        for i, f in enumerate(df.schema.fields):
            if (only is not None and (name, i) not in only) or (kinds is not None and kind_of(f.dataType) not in kinds):
                continue
            if f.name == part_col:
                continue
            native, v = native_value(f)
            by_type.setdefault(native, []).append(f"named_struct('col', {number[name, i]}, 'v', {v})")
        for native, structs in by_type.items():
            parts.setdefault(native, []).append(df.selectExpr(*carry, f"inline(array({', '.join(structs)}))"))
    return {native: _union(ps).filter("v IS NOT NULL") for native, ps in parts.items()}


def _distinct(native: str, c: DataFrame) -> DataFrame:
    """The distinct values of a stream: (col, v), with long texts by their md5 (col, v, hkey)."""
    if native == "string":
        c = c.selectExpr("col", f"CASE WHEN length(v) <= {LONG_TEXT} THEN v END AS v",
                         f"CASE WHEN length(v) > {LONG_TEXT} THEN md5(v) END AS hkey")
    return c.distinct()


def distinct_counts(items, only: set | None = None) -> DataFrame | None:
    """(col, num_unique_values): exact distinct counts. A key is a column's number and one native value."""
    return _union([_distinct(native, c).groupBy("col").agg(F.count(F.lit(1)).alias("num_unique_values"))
                   for native, c in typed_cells(items, only).items()])


# A column of more distinct values than this is cut down to low hashes, of which it is expected to
# have EXPECTED_LOW (or 8 for each sample asked for, if that is more): with a chance under 1e-15 too few are there.
MANY_VALUES = 4096
EXPECTED_LOW = 64


def sample_limits(counts: DataFrame, n_samples: int) -> DataFrame:
    """(col, lim): samples have an ``md5`` under ``lim`` (every md5 is under 'g'), from (col, num_unique_values);
    other columns stay."""
    low = max(EXPECTED_LOW, 8 * n_samples)
    prefix = F.lower(F.hex((F.lit(2.0 ** 60) * F.lit(float(low)) / F.col("num_unique_values")).cast("long")))
    return counts.filter("num_unique_values > 0").withColumn("lim", F.when(
        F.col("num_unique_values") > max(MANY_VALUES, 4 * low), F.lpad(prefix, 15, "0")).otherwise("g")).drop("num_unique_values")


def sample_values(items, counts: DataFrame, n_samples: int = 3) -> DataFrame:
    """(col, samples): up to ``n_samples`` distinct values per column, smallest ``md5`` first.

    ``counts`` (col, num_unique_values), exact or from sketches, tell the columns of many values. Of these only
    low hashes leave the scan; the others collapse to their few values in the tasks. Long texts travel as their
    hash; the few chosen ones are fetched in full by a semi-join of the columns that can hold them.
    """
    n_columns = len(column_numbers(items))
    limits = per_column(sample_limits(counts, n_samples), n_columns)
    parts = []
    for native, c in typed_cells(items).items():
        text = NATIVE_TEXT[native]
        low = c.join(limits, "col").filter(f"lim = 'g' OR md5({text}) < lim").select("col", "v")
        hkey = "hkey" if native == "string" else "CAST(NULL AS STRING) AS hkey"
        parts.append(_distinct(native, low).selectExpr("col", f"{text} AS value", hkey))
    w = Window.partitionBy("col").orderBy(F.col("vhash"), F.col("value"))
    ranked = (_union(parts).withColumn("vhash", F.coalesce("hkey", F.md5("value")))
              .withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n_samples).drop("vhash"))
    long_source = typed_cells(items, kinds=("string", "other")).get("string")
    if long_source is not None:
        chosen = ranked.filter(F.col("hkey").isNotNull()).select("col", "hkey")
        full = (long_source.filter(f"length(v) > {LONG_TEXT}").withColumn("hkey", F.md5("v"))
                .join(per_column(chosen, n_columns), ["col", "hkey"], "left_semi")
                .groupBy("col", "hkey").agg(F.min("v").alias("long_value")))
        ranked = ranked.join(full, ["col", "hkey"], "left").withColumn("value", F.coalesce("value", "long_value"))
    return ranked.groupBy("col").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))),
                    lambda x: x["value"]).alias("samples"))


# Every date format starts with a digit and is 4 to 32
# characters long; other values skip the format regexes.
DATE_LEN = (4, 32)
DATE_LIKE = f"length({{e}}) BETWEEN {DATE_LEN[0]} AND {DATE_LEN[1]} AND substr({{e}}, 1, 1) BETWEEN '0' AND '9'"


def _date_pick() -> list[str]:
    """The first format whose parsed count equals the non-blank count ``nb``."""
    fmt = lo = hi = "NULL"
    for j, (name, _r, _p) in reversed(list(enumerate(DATE_FORMATS))):
        hit = f"nb > 0 AND ok{j} = nb"
        fmt = f"CASE WHEN {hit} THEN '{name}' ELSE {fmt} END"
        lo = f"CASE WHEN {hit} THEN lo{j} ELSE {lo} END"
        hi = f"CASE WHEN {hit} THEN hi{j} ELSE {hi} END"
    return [f"CAST({fmt} AS STRING) AS date_format",
            f"CAST({lo} AS TIMESTAMP) AS date_min", f"CAST({hi} AS TIMESTAMP) AS date_max"]


def date_formats(items, nonblank: DataFrame) -> DataFrame | None:
    """(col, date_format, date_min, date_max) of the string columns with a format that parses every non-blank
    value (T2), the first of them, with the parsed min/max under it (P6). ``nonblank``: (col, nb), the number of
    non-blank values. Only values that may be dates leave the scan, and each distinct one is parsed once."""
    c = typed_cells(items, kinds=("string",)).get("string")
    if c is None:
        return None
    values = c.filter(DATE_LIKE.format(e="v")).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    parsed = ", ".join(f"named_struct('f', {j}, 'p', {sql_parse_with('v', n, r, p)})"
                       for j, (n, r, p) in enumerate(DATE_FORMATS))
    fits = (values.selectExpr("col", "n", f"inline(array({parsed}))").filter("p IS NOT NULL")
            .groupBy("col", "f").agg(F.sum("n").alias("ok"), F.min("p").alias("lo"), F.max("p").alias("hi")))
    names = ", ".join(f"'{n}'" for n, _, _ in DATE_FORMATS)
    return (fits.join(nonblank, "col").filter("ok = nb")
            .groupBy("col").agg(F.min(F.struct("f", "lo", "hi")).alias("d"))
            .selectExpr("col", f"element_at(array({names}), d.f + 1) AS date_format", "d.lo AS date_min", "d.hi AS date_max"))


# The most that a distinct count of approximate mode is off (three standard errors of the
# default sketch, 5% each), as a share of the count.
APPROX_ERROR = 0.15

# In "auto" mode, string columns whose approximate cardinality
# ratio lies within this distance of CATEGORY_RATIO get exact distinct counts
# (0.1 is 20% of the ratio, about four standard errors of the default sketch).
AUTO_RATIO_BAND = 0.1


def exact_near_threshold(items, columns: DataFrame) -> DataFrame:
    """Replace sketch distinct counts by exact ones for the string columns
    whose category/string decision could flip under the sketch's error. Only
    those columns are read again (their keys are metadata, at most one per
    column), and their distinct values are counted with map-side partial
    aggregation."""
    ratio = F.col("num_unique_values") / F.col("n_rows")
    near = (columns.filter((F.col("kind") == "string") & (F.col("n_rows") > 0))
            .filter(F.abs(ratio - F.lit(CATEGORY_RATIO)) <= AUTO_RATIO_BAND))
    keys = {(r[0], r[1]) for r in near.select(*KEYS).collect()}
    if not keys:
        return columns
    exact = distinct_counts(items, keys).withColumnRenamed("num_unique_values", "_exact")
    return (columns.join(exact, "col", "left")
            .withColumns({"num_unique_values": F.coalesce("_exact", "num_unique_values"),
                          "distinct_error": F.when(F.col("_exact").isNotNull(), 0.0).otherwise(F.col("distinct_error"))})
            .drop("_exact"))


def profile(tables, n_samples: int = 3, exact: bool = True,
            sample_rows: int | None = None, materialize: bool = True) -> DataFrame:
    """Profile every column of every table (the ``profile`` schema).

    ``tables`` is a dict or list of (name, DataFrame). ``sample_rows=None``
    profiles whole tables; an integer reproduces the reference's row limit.
    ``exact=False`` takes distinct counts from HLL sketches and runs without
    the per-value shuffle (``approx_counts``); everything else stays exact.
    ``exact="auto"`` does the same but counts exactly the string columns whose
    category decision is near the threshold (``exact_near_threshold``).
    With ``materialize`` (and always in "auto") the statistics, one row a column, are written once to the
    shared folder: dates and samples read them.
    """
    items = _as_items(tables)
    catalog = column_catalog(items)
    spark = catalog.sparkSession
    if materialize or exact == "auto":
        from lakesonar.session import shared_dir
        shared_dir(spark)
    if sample_rows is not None:
        items = [(name, df.limit(sample_rows)) for name, df in items]
        if materialize:  # the same rows for every step
            items = [(name, df.checkpoint(eager=True)) for name, df in items]
    n_columns = len(column_numbers(items))
    out = (catalog.join(F.broadcast(numbers_frame(items, spark)), KEYS)
           .join(column_stats(items), KEYS, "left"))
    if exact and exact != "auto":
        out = out.join(distinct_counts(items), "col", "left").withColumn("distinct_error", F.lit(0.0))
    else:
        out = out.join(approx_counts(items), KEYS, "left").withColumn("distinct_error", F.lit(APPROX_ERROR))
    if materialize or exact == "auto":
        out = out.checkpoint(eager=True)
    counts = out.select("col", "num_unique_values")
    dates = date_formats(items, per_column(out.filter("nb > 0").select("col", "nb"), n_columns))
    if exact == "auto":
        out = exact_near_threshold(items, out)
    if dates is None:
        out = out.selectExpr("*", "CAST(NULL AS STRING) AS date_format", "CAST(NULL AS TIMESTAMP) AS date_min",
                             "CAST(NULL AS TIMESTAMP) AS date_max")
    else:
        out = out.join(dates, "col", "left")
    if n_samples <= 0:                     # no samples asked for: no sample work at all
        out = out.withColumn("samples", F.lit(None).cast("array<string>"))
    else:
        out = out.join(sample_values(items, counts, n_samples), "col", "left")
    return described(out)


def described(out: DataFrame) -> DataFrame:
    """The ``profile`` schema of the statistics of columns: dtype (T1, P5), min and max as text.
    ``num_unique_values`` is off by at most ``distinct_error`` times itself, and exact if that is 0."""
    out = out.withColumn("num_unique_values",
                         F.coalesce("num_unique_values", F.lit(0)).cast("long"))
    kind = F.col("kind")
    ratio = F.col("num_unique_values") / F.col("n_rows")
    dtype = (F.when(kind == "number", "number")
             .when(kind == "boolean", "boolean")
             .when(kind == "temporal", "date")
             .when((kind == "string") & (F.col("n_non_null") == 0), "string")
             .when((kind == "string") & F.col("date_format").isNotNull(), "date")
             .when((kind == "string") & (ratio < CATEGORY_RATIO), "category")
             .when(kind == "string", "string")
             .otherwise(F.col("spark_type")))
    min_text = (F.when(kind == "number",
                       F.when(F.col("integral"), F.col("min_lnum").cast("string"))
                       .otherwise(F.coalesce("min_dec", F.expr(sql_double_text("min_num")))))
                .when(F.col("spark_type") == "date", F.col("min_tn").cast("date").cast("string"))
                .when(kind == "temporal", F.coalesce(iso_text("min_ts"), F.expr(sql_local_text("min_tn"))))
                .when(F.col("date_format").isNotNull(), iso_text("date_min")))
    max_text = (F.when(kind == "number",
                       F.when(F.col("integral"), F.col("max_lnum").cast("string"))
                       .otherwise(F.coalesce("max_dec", F.expr(sql_double_text("max_num")))))
                .when(F.col("spark_type") == "date", F.col("max_tn").cast("date").cast("string"))
                .when(kind == "temporal", F.coalesce(iso_text("max_ts"), F.expr(sql_local_text("max_tn"))))
                .when(F.col("date_format").isNotNull(), iso_text("date_max")))
    return out.select(
        "table_name", "ordinal", "column_name", "spark_type", dtype.alias("dtype"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce("n_non_null", F.lit(0)).cast("long").alias("n_non_null"),
        "num_unique_values",
        (F.coalesce("distinct_error", F.lit(0.0)) == 0).alias("distinct_is_exact"),
        F.coalesce("distinct_error", F.lit(0.0)).alias("distinct_error"),
        F.when(kind == "number", F.col("std")).alias("std"),
        min_text.alias("min"), max_text.alias("max"),
        F.when(kind == "number", F.col("min_num")).alias("min_num"),
        F.when(kind == "number", F.col("max_num")).alias("max_num"),
        "integral", "date_format",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        (F.coalesce("n_non_null", F.lit(0)) < F.coalesce("n_rows", F.lit(0))).alias("observed_nullable"),
        F.lit("").alias("semantic_type"), F.lit("").alias("description"),
    )

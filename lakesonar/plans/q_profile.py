"""Registered profiling queries (P1-P10, T1-T4, J3-J5) and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesonar.operators.profile import profile
from lakesonar.plans.registry import (INTEGRAL_DUCK, LAKE_TABLES, NUMERIC_DUCK, query,
                                      read_lake, union_sql)

# Derived date strings: (column, Spark pattern, DuckDB strftime pattern).
DATE_STRING_COLUMNS = [
    ("d_iso", "yyyy-MM-dd", "%Y-%m-%d"),
    ("d_compact", "yyyyMMdd", "%Y%m%d"),
    ("d_us", "MM/dd/yyyy", "%m/%d/%Y"),
    ("d_time", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("d_year", "yyyy", "%Y"),
]
# (column, DuckDB format list, guard regex) used by the oracle's date detection.
DUCK_DATE_FORMATS = [
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$", ["%Y-%m-%d"]),
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$",
     ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f"]),
    ("iso_t", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$",
     ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f"]),
    ("compact", r"^\d{8}$", ["%Y%m%d"]),
    ("year", r"^\d{4}$", ["%Y"]),
    ("us", r"^\d{1,2}/\d{1,2}/\d{4}$", ["%m/%d/%Y"]),
    ("eu", r"^\d{1,2}/\d{1,2}/\d{4}$", ["%d/%m/%Y"]),
]


def orders_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-like strings made from ``orders.o_orderdate`` (with blanks and bad values)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    cols = [F.col("o_orderkey")] + [F.date_format("o_orderdate", p).alias(c)
                                    for c, p, _ in DATE_STRING_COLUMNS]
    cols += [F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(iso).alias("d_blank"),
             F.when(F.col("o_orderkey") % 101 == 0, F.lit("n/a")).otherwise(iso).alias("d_bad"),
             F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                      F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("+02:30")).alias("d_zoned")]
    return o.select(*cols)


DUCK_ORDERS_DATES = ("(SELECT o_orderkey, "
                     + ", ".join(f"strftime(o_orderdate, '{d}') AS {c}" for c, _, d in DATE_STRING_COLUMNS)
                     + ", CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_blank"
                     + ", CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_bad"
                     + ", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+02:30' END AS d_zoned"
                     + " FROM orders)")
ORDERS_DATES_SCHEMA = ([("o_orderkey", "BIGINT")] + [(c, "VARCHAR") for c, _, _ in DATE_STRING_COLUMNS]
                       + [("d_blank", "VARCHAR"), ("d_bad", "VARCHAR"), ("d_zoned", "VARCHAR")])


def lake_with_dates(spark, sf_dir):
    t = read_lake(spark, sf_dir)
    t["orders_dates"] = orders_dates(spark, sf_dir)
    return t


def all_schemas():
    s = dict(LAKE_TABLES)
    s["orders_dates"] = ORDERS_DATES_SCHEMA
    return s


def duck_source(t: str) -> str:
    return DUCK_ORDERS_DATES if t == "orders_dates" else t


def duck_iso(e: str) -> str:
    return (f"CASE WHEN strftime({e}, '%f') = '000000' THEN strftime({e}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({e}, '%Y-%m-%dT%H:%M:%S.%f') END")


def duck_parse(c: str, name: str, regex: str, fmts: list[str]) -> str:
    guard = f"regexp_matches({c}, '{regex}')"
    if name == "year":
        guard += f" AND try_cast({c} AS INTEGER) BETWEEN 1678 AND 2261"
    local = f"regexp_replace({c}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')" if name == "iso_t" else c
    parse = "coalesce(" + ", ".join(f"try_strptime({local}, '{f}')" for f in fmts) + ")" \
        if len(fmts) > 1 else f"try_strptime({c}, '{fmts[0]}')"
    if name == "iso_t":  # the local time less its offset; no offset: 0
        parse += (f" - to_minutes(CASE WHEN regexp_matches({c}, '[+-][0-9]{{2}}:[0-9]{{2}}$') THEN "
                  f"try_cast(left(right({c}, 6), 1) || '1' AS INTEGER) * (60 * try_cast(left(right({c}, 5), 2) AS INTEGER) "
                  f"+ try_cast(right({c}, 2) AS INTEGER)) ELSE 0 END)")
    return f"CASE WHEN {guard} THEN {parse} END"


def duck_date_choice(c: str) -> tuple[str, str, str]:
    """(format, min, max) SQL aggregates of DuckDB-side date detection."""
    nb = f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} <> '')"
    fmt, lo, hi = "NULL", "NULL", "NULL"
    for name, regex, fmts in reversed(DUCK_DATE_FORMATS):
        p = duck_parse(c, name, regex, fmts)
        hit = f"({nb} > 0 AND count({p}) = {nb})"
        fmt = f"CASE WHEN {hit} THEN '{name}' ELSE {fmt} END"
        lo = f"CASE WHEN {hit} THEN min({p}) ELSE {lo} END"
        hi = f"CASE WHEN {hit} THEN max({p}) ELSE {hi} END"
    return fmt, lo, hi


def duck_dtype(t: str, c: str, ty: str) -> str:
    if ty in NUMERIC_DUCK:
        return "any_value('number')"
    if ty == "TIMESTAMP":
        return "any_value('date')"
    if ty == "FLOAT[]":
        return "any_value('array<float>')"
    fmt, _, _ = duck_date_choice(c)
    return (f"CASE WHEN count({c}) = 0 THEN 'string' WHEN ({fmt}) IS NOT NULL THEN 'date' "
            f"WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'category' ELSE 'string' END")


# --- profile_numeric (P1, P2, P7) -------------------------------------------

def _numeric_oracle():
    parts = []
    for t, cols in LAKE_TABLES.items():
        for c, ty in cols:
            if ty in NUMERIC_DUCK:
                parts.append(
                    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
                    f"count({c}) AS n_non_null, round(stddev_samp({c}::DOUBLE), 4) AS std, "
                    f"round(min({c})::DOUBLE, 6) AS min_num, round(max({c})::DOUBLE, 6) AS max_num FROM {t}")
    return union_sql(parts)


@query("profile_numeric", _numeric_oracle())
def q_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile(read_lake(spark, sf_dir))
    return p.filter(F.col("dtype") == "number").select(
        "table_name", "column_name", "n_rows", "n_non_null",
        F.round("std", 4).alias("std"), F.round("min_num", 6).alias("min_num"),
        F.round("max_num", 6).alias("max_num"))


# --- profile_numeric_json (P3): integer std truncated in the JSON ----------

def _numeric_json_oracle():
    parts = []
    for t, cols in LAKE_TABLES.items():
        for c, ty in cols:
            if ty in NUMERIC_DUCK:
                if ty in INTEGRAL_DUCK:
                    std = (f"CASE WHEN count({c}) = count(*) THEN trunc(stddev_samp({c}::DOUBLE)) "
                           f"ELSE round(stddev_samp({c}::DOUBLE), 4) END")
                    mn, mx = f"min({c})::BIGINT::DOUBLE", f"max({c})::BIGINT::DOUBLE"
                else:
                    std = f"round(stddev_samp({c}::DOUBLE), 4)"
                    mn, mx = f"round(min({c}), 6)", f"round(max({c}), 6)"
                parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {std} AS std_json, "
                             f"{mn} AS min_json, {mx} AS max_json FROM {t}")
    return union_sql(parts)


@query("profile_numeric_json", _numeric_json_oracle())
def q_profile_numeric_json(spark, sf_dir):
    from lakesonar.operators.summary import json_number_fields
    p = profile(read_lake(spark, sf_dir))
    j = json_number_fields(p.filter(F.col("dtype") == "number"))
    return j.select("table_name", "column_name",
                    F.round("std_json", 4).alias("std_json"),
                    F.round("min_json", 6).alias("min_json"), F.round("max_json", 6).alias("max_json"))


# --- profile_nan (P2, J5, Q5): NaN injected into events.value ---------------

def events_with_nan(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan")))
                    .when(F.col("event_id") % 10 == 1, F.lit(-0.0))
                    .otherwise(F.col("value")).alias("value"))


@query("profile_nan", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 0.0
           ELSE value END AS value FROM events)
SELECT 'events_nan' AS table_name, 'value' AS column_name, count(*) AS n_rows, count(value) AS n_non_null,
       count(DISTINCT value) AS num_unique_values, round(stddev_samp(value), 4) AS std,
       round(min(value), 6) AS min_num, round(max(value), 6) AS max_num FROM e""")
def q_profile_nan(spark, sf_dir):
    p = profile({"events_nan": events_with_nan(spark, sf_dir).select("value")})
    return p.select("table_name", "column_name", "n_rows", "n_non_null", "num_unique_values",
                    F.round("std", 4).alias("std"), F.round("min_num", 6).alias("min_num"),
                    F.round("max_num", 6).alias("max_num"))


# --- profile_distinct (P4, P5) ---------------------------------------------

def _distinct_oracle():
    parts = []
    for t, cols in LAKE_TABLES.items():
        for c, ty in cols:
            if ty == "FLOAT[]":
                continue
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
                         f"count(DISTINCT {c}) AS num_unique_values, "
                         f"round(count(DISTINCT {c}) / count(*), 6) AS ratio FROM {t}")
    return union_sql(parts)


@query("profile_distinct", _distinct_oracle())
def q_profile_distinct(spark, sf_dir):
    p = profile(read_lake(spark, sf_dir))
    return p.filter(~F.col("spark_type").startswith("array")).select(
        "table_name", "column_name", "n_rows", "num_unique_values",
        F.round(F.col("num_unique_values") / F.col("n_rows"), 6).alias("ratio"))


@query("profile_distinct_approx")
def q_profile_distinct_approx(spark, sf_dir):
    p = profile(read_lake(spark, sf_dir), exact=False)
    return p.select("table_name", "column_name", "n_rows", "num_unique_values")


# --- infer_dtype (T1, T2, P5) ------------------------------------------------

def _dtype_oracle():
    parts = []
    for t, cols in all_schemas().items():
        for c, ty in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"{duck_dtype(t, c, ty)} AS dtype FROM {duck_source(t)}")
    return union_sql(parts)


@query("infer_dtype", _dtype_oracle())
def q_infer_dtype(spark, sf_dir):
    p = profile(lake_with_dates(spark, sf_dir))
    return p.select("table_name", "column_name", "dtype")


@query("infer_dtype_auto", _dtype_oracle())
def q_infer_dtype_auto(spark, sf_dir):
    """Sketch distinct counts, exact ones only near the category threshold."""
    p = profile(lake_with_dates(spark, sf_dir), exact="auto")
    return p.select("table_name", "column_name", "dtype")


# --- profile_dates (P6, T3, T4) ---------------------------------------------

DATE_COLUMNS = [("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]


def _dates_oracle():
    parts = []
    for t, c in DATE_COLUMNS:
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'date' AS dtype, "
                     f"{duck_iso(f'min({c})')} AS min, {duck_iso(f'max({c})')} AS max FROM {t}")
    for c, ty in ORDERS_DATES_SCHEMA:
        if ty != "VARCHAR":
            continue
        fmt, lo, hi = duck_date_choice(c)
        parts.append(f"SELECT * FROM (SELECT 'orders_dates' AS table_name, '{c}' AS column_name, "
                     f"CASE WHEN ({fmt}) IS NOT NULL THEN 'date' ELSE 'other' END AS dtype, "
                     f"{duck_iso(lo)} AS min, {duck_iso(hi)} AS max FROM {DUCK_ORDERS_DATES})")
    return union_sql(parts)


@query("profile_dates", _dates_oracle())
def q_profile_dates(spark, sf_dir):
    t = read_lake(spark, sf_dir, ["events", "orders", "lineitem"])
    tabs = {n: t[n].select(c) for n, c in DATE_COLUMNS}
    tabs["orders_dates"] = orders_dates(spark, sf_dir).drop("o_orderkey")
    p = profile(tabs)
    return p.select("table_name", "column_name",
                    F.when(F.col("dtype") == "date", "date").otherwise("other").alias("dtype"),
                    "min", "max")


# --- sample_values (P8, P9) --------------------------------------------------

def _samples_oracle():
    parts = []
    for t, cols in LAKE_TABLES.items():
        for c, ty in cols:
            if ty in INTEGRAL_DUCK or ty == "VARCHAR":
                parts.append(
                    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                    f"string_agg(v, '|' ORDER BY md5(v), v) AS samples, count(*) AS n_samples FROM ("
                    f"SELECT v, row_number() OVER (ORDER BY md5(v), v) AS rk FROM "
                    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL)) "
                    f"WHERE rk <= 3")
    return union_sql(parts)


@query("sample_values", _samples_oracle())
def q_sample_values(spark, sf_dir):
    p = profile(read_lake(spark, sf_dir))
    keep = (F.col("integral") | (F.col("spark_type") == "string"))
    return p.filter(keep).select("table_name", "column_name",
                                 F.array_join("samples", "|").alias("samples"),
                                 F.size("samples").cast("long").alias("n_samples"))


# --- lake_profile (J3, J4) ---------------------------------------------------

def _lake_oracle():
    parts = []
    for t, cols in LAKE_TABLES.items():
        uniq = " + ".join(f"count(DISTINCT {c})" for c, _ in cols)
        for c, ty in cols:
            std = mn = mx = "NULL::DOUBLE"
            lo = hi = samples = "NULL::VARCHAR"
            text = f"CAST({c} AS VARCHAR)"
            if ty in NUMERIC_DUCK:
                std = f"round(stddev_samp({c}::DOUBLE), 4)"
                mn, mx = f"round(min({c})::DOUBLE, 6)", f"round(max({c})::DOUBLE, 6)"
            if ty in INTEGRAL_DUCK:
                lo, hi = f"min({c})::VARCHAR", f"max({c})::VARCHAR"
            elif ty == "TIMESTAMP":
                lo, hi, text = duck_iso(f"min({c})"), duck_iso(f"max({c})"), duck_iso(c)
            elif ty == "VARCHAR":
                lo, hi = (duck_iso(x) for x in duck_date_choice(c)[1:])
            if ty in INTEGRAL_DUCK or ty in ("VARCHAR", "TIMESTAMP"):
                samples = (f"(SELECT string_agg(v, '|' ORDER BY md5(v), v) FROM (SELECT v FROM (SELECT DISTINCT {text} AS v "
                           f"FROM {t} WHERE {c} IS NOT NULL) ORDER BY md5(v), v LIMIT 3))")
            parts.append(f"SELECT s.*, {samples} AS samples FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"{len(cols)} AS n_columns, count(*) AS n_rows, "
                         f"{uniq} AS unique_total, count(DISTINCT {c}) AS num_unique_values, {duck_dtype(t, c, ty)} AS dtype, "
                         f"{std} AS std, {mn} AS min_num, {mx} AS max_num, {lo} AS min, {hi} AS max, "
                         f"least(count(DISTINCT {c}), 3) AS n_samples FROM {t}) s")
    return union_sql(parts)


@query("lake_profile", _lake_oracle())
def q_lake_profile(spark, sf_dir):
    """All statistics of every column beside its table's totals. The texts of fractional
    numbers and arrays differ between engines: their min and max are given as numbers,
    their samples counted."""
    p = profile(read_lake(spark, sf_dir))
    table = Window.partitionBy("table_name")     # a table's columns
    exact = F.col("integral") | F.col("spark_type").isin("string", "timestamp", "timestamp_ntz")
    return p.select(
        "table_name", "column_name", F.count(F.lit(1)).over(table).cast("int").alias("n_columns"), "n_rows",
        F.sum("num_unique_values").over(table).cast("long").alias("unique_total"), "num_unique_values", "dtype",
        F.round("std", 4).alias("std"), F.round("min_num", 6).alias("min_num"), F.round("max_num", 6).alias("max_num"),
        F.when(exact, F.col("min")).alias("min"), F.when(exact, F.col("max")).alias("max"),
        F.when(exact & (F.size("samples") > 0), F.array_join("samples", "|")).alias("samples"),
        F.size("samples").cast("long").alias("n_samples"))


# --- approximate mode: no per-value shuffle; all but distinct counts exact ---

@query("profile_numeric_approx", _numeric_oracle())
def q_profile_numeric_approx(spark, sf_dir):
    p = profile(read_lake(spark, sf_dir), exact=False)
    return p.filter(F.col("dtype") == "number").select(
        "table_name", "column_name", "n_rows", "n_non_null",
        F.round("std", 4).alias("std"), F.round("min_num", 6).alias("min_num"),
        F.round("max_num", 6).alias("max_num"))


@query("sample_values_approx", _samples_oracle())
def q_sample_values_approx(spark, sf_dir):
    p = profile(read_lake(spark, sf_dir), exact=False)
    keep = (F.col("integral") | (F.col("spark_type") == "string"))
    return p.filter(keep).select("table_name", "column_name",
                                 F.array_join("samples", "|").alias("samples"),
                                 F.size("samples").cast("long").alias("n_samples"))


@query("profile_dates_approx", _dates_oracle())
def q_profile_dates_approx(spark, sf_dir):
    t = read_lake(spark, sf_dir, ["events", "orders", "lineitem"])
    tabs = {n: t[n].select(c) for n, c in DATE_COLUMNS}
    tabs["orders_dates"] = orders_dates(spark, sf_dir).drop("o_orderkey")
    p = profile(tabs, exact=False)
    return p.select("table_name", "column_name",
                    F.when(F.col("dtype") == "date", "date").otherwise("other").alias("dtype"),
                    "min", "max")


# --- clean_nan_nested (J5): NaN inside arrays becomes NULL, infinity stays ---

@query("clean_nan_nested", """
SELECT vec_id, count(*) FILTER (WHERE (vec_id + i - 1) % 17 = 0) AS n_null,
       round(sum(x::DOUBLE) FILTER (WHERE (vec_id + i - 1) % 17 <> 0), 4) AS total
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
GROUP BY vec_id""")
def q_clean_nan_nested(spark, sf_dir):
    from lakesonar.functions.render import clean_nan_frame
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    dirty = e.select("vec_id", F.expr(
        "transform(embedding, (x, i) -> CASE WHEN (vec_id + i) % 17 = 0 THEN CAST('NaN' AS FLOAT) ELSE x END)")
        .alias("embedding"))
    clean = clean_nan_frame(dirty)
    return clean.select(
        "vec_id",
        F.expr("CAST(size(filter(embedding, x -> x IS NULL)) AS BIGINT)").alias("n_null"),
        F.round(F.expr("aggregate(filter(embedding, x -> x IS NOT NULL), 0D, (a, x) -> a + CAST(x AS DOUBLE))"),
                4).alias("total"))


# --- profile_types (P2, P6): values that neither a zone nor a double may change ---

ZONES = ("UTC", "America/New_York")


def typed_orders(spark, sf_dir):
    """Local times around a clock change, decimals of 30 digits, doubles past 1e7 and under 1e-3, dates."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr(
        "timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, CAST(o_orderkey % 300 AS INT)) AS local_time",
        "CAST(o_orderdate AS DATE) AS day",
        "CAST(concat('1234567890', lpad(CAST(o_orderkey AS STRING), 10, '0'), '.1234567891') AS DECIMAL(38, 10)) AS wide",
        "CAST(concat('-98765432109876543210.', lpad(CAST(o_custkey AS STRING), 10, '0')) AS DECIMAL(38, 10)) AS negative",
        "o_orderkey * 1000000.0D + 0.5D AS large", "(1 + o_orderkey % 1000) / 8388608.0D AS small",
        "CAST(o_orderkey * 16777216.0D AS DOUBLE) AS whole")


def _types_oracle():
    o = """(SELECT TIMESTAMP '2024-03-10 00:00:00' + to_minutes((o_orderkey % 300)::INTEGER) AS local_time, o_orderdate::DATE AS day,
  ('1234567890' || lpad(o_orderkey::VARCHAR, 10, '0') || '.1234567891')::DECIMAL(38, 10) AS wide,
  ('-98765432109876543210.' || lpad(o_custkey::VARCHAR, 10, '0'))::DECIMAL(38, 10) AS negative,
  o_orderkey * 1000000.0::DOUBLE + 0.5::DOUBLE AS large, (1 + o_orderkey % 1000) / 8388608.0::DOUBLE AS small,
  o_orderkey * 16777216.0::DOUBLE AS whole FROM orders)"""
    parts = []
    for z in ZONES:
        for c in ("local_time", "day", "wide", "negative", "large", "small", "whole"):
            lo, hi = (duck_iso(f"{m}(local_time)") if c == "local_time" else f"{m}({c})::VARCHAR" for m in ("min", "max"))
            if c == "small":  # engines write these with different exponents
                lo = hi = "'-'"
            parts.append(f"SELECT '{z}' AS zone, '{c}' AS column_name, count(DISTINCT {c}) AS num_unique_values, {lo} AS min, {hi} AS max FROM {o}")
    return union_sql(parts)


@query("profile_types", _types_oracle())
def q_profile_types(spark, sf_dir):
    out, zone = None, spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ZONES:
            spark.conf.set("spark.sql.session.timeZone", z)  # plans keep the zone they are made in
            p = profile({"typed": typed_orders(spark, sf_dir)}, n_samples=0)
            small = F.col("column_name") == "small"
            one = p.select(F.lit(z).alias("zone"), "column_name", "num_unique_values",
                           *[F.when(small, "-").otherwise(F.col(m)).alias(m) for m in ("min", "max")])
            out = one if out is None else out.union(one)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return out

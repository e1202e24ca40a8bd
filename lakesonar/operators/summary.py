"""Table summaries.

A summary is assembled per table from the ``profile`` rows with an ordered
``collect_list`` bounded by the table's column count. JSON values keep their
types: ``min``/``max``/``std``/``samples`` are variants, so numbers render as
JSON numbers and dates as strings, and absent properties are omitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY_JSON_OPTIONS = {"ignoreNullFields": "true"}


def json_number_fields(p: DataFrame) -> DataFrame:
    """std/min/max as the JSON shows them (P3): for integral columns without
    nulls the std is truncated to an integer, min/max are integers."""
    integral_full = F.col("integral") & (F.col("n_non_null") == F.col("n_rows"))
    std = F.when(integral_full, F.floor(F.col("std")).cast("double")).otherwise(F.col("std"))
    mn = F.when(F.col("integral"), F.col("min_num").cast("long").cast("double")).otherwise(F.col("min_num"))
    mx = F.when(F.col("integral"), F.col("max_num").cast("long").cast("double")).otherwise(F.col("max_num"))
    return p.withColumn("std_json", std).withColumn("min_json", mn).withColumn("max_json", mx)


def _variant_number(c, integral):
    return F.when(integral, F.expr(f"CAST(CAST({c} AS BIGINT) AS VARIANT)")).otherwise(
        F.expr(f"CAST({c} AS VARIANT)"))


def properties(p: DataFrame) -> DataFrame:
    """Adds ``properties``: struct<dtype, std, min, max, samples, num_unique_values,
    semantic_type, description> as the summary JSON shows it."""
    p = json_number_fields(p)
    is_num = F.col("dtype") == "number"
    is_date = F.col("dtype") == "date"
    integral_full = F.col("integral") & (F.col("n_non_null") == F.col("n_rows"))
    std = F.when(is_num, _variant_number("std_json", integral_full))
    # integers from their exact text, other numbers from the double
    mn = (F.when(is_num & F.col("integral"), F.expr("CAST(CAST(min AS BIGINT) AS VARIANT)"))
          .when(is_num, F.expr("CAST(min_json AS VARIANT)"))
          .when(is_date, F.expr("CAST(min AS VARIANT)")))
    mx = (F.when(is_num & F.col("integral"), F.expr("CAST(CAST(max AS BIGINT) AS VARIANT)"))
          .when(is_num, F.expr("CAST(max_json AS VARIANT)"))
          .when(is_date, F.expr("CAST(max AS VARIANT)")))
    samples = F.when(is_num | (F.col("dtype") == "boolean"), F.expr("transform(samples, s -> try_parse_json(s))")).otherwise(
        F.expr("transform(samples, s -> CAST(s AS VARIANT))"))
    props = F.struct(F.col("dtype"), std.alias("std"), mn.alias("min"), mx.alias("max"),
                     samples.alias("samples"), F.col("num_unique_values"),
                     F.col("semantic_type"), F.col("description"))
    return p.withColumn("properties", props)


def summarize(p: DataFrame, dataset_description: DataFrame | None = None) -> DataFrame:
    """One summary per table (J1, J2, J3): (name, file_name, dataset_description,
    fields, field_names, json_summary).

    ``dataset_description`` optionally supplies (table_name, dataset_description);
    otherwise it is '' as in the base summary (P10).
    """
    pr = properties(p)
    field = F.struct(F.col("column_name").alias("column"), F.col("properties"))
    g = pr.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", field.alias("f"))),
                     lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1)
                     .when(a["ordinal"] > b["ordinal"], 1).otherwise(0)).alias("_fs"))
    g = g.select(
        F.col("table_name").alias("name"),
        F.col("table_name").alias("file_name"),
        F.transform("_fs", lambda x: x["f"]).alias("fields"),
        F.transform("_fs", lambda x: x["f"]["column"]).alias("field_names"))
    if dataset_description is not None:
        g = g.join(dataset_description.withColumnRenamed("table_name", "name"), "name", "left")
        g = g.withColumn("dataset_description", F.coalesce("dataset_description", F.lit("")))
    else:
        g = g.withColumn("dataset_description", F.lit(""))
    g = g.select("name", "file_name", "dataset_description", "fields", "field_names")
    return g.withColumn("json_summary", summary_json(g))


def summary_json(g: DataFrame, pretty: bool = False):
    """Compact (or indented) JSON of the summary struct, key order as the reference."""
    opts = dict(SUMMARY_JSON_OPTIONS)
    if pretty:
        opts["pretty"] = "true"
    return F.to_json(F.struct("name", "file_name", "dataset_description", "fields", "field_names"), opts)

"""Registered incremental queries (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesonar.operators.index import open_index
from lakesonar.plans.registry import LAKE_TABLES, NUMERIC_DUCK, query, union_sql
from lakesonar.session import new_table_path
from lakesonar.streaming.reindex import start_reindex
from lakesonar.streaming.stats import merge_stats, partial_stats


def _incremental_oracle():
    parts = []
    for c, ty in LAKE_TABLES["lineitem"]:
        if ty in NUMERIC_DUCK:
            parts.append(f"SELECT 'lineitem' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
                         f"round(stddev_samp({c}), 4) AS std, "
                         f"round(min({c})::DOUBLE, 6) AS min_num, round(max({c})::DOUBLE, 6) AS max_num FROM lineitem")
    return union_sql(parts)


@query("incremental_profile", _incremental_oracle())
def q_incremental_profile(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # one partial per line number, as if each arrived as its own file; all
    # partials come from one aggregation keyed by the part
    parts = partial_stats({"lineitem": li}, F.concat(F.lit("line"), F.col("l_linenumber").cast("string")))
    m = merge_stats(parts)
    names = spark.createDataFrame([(i, f.name) for i, f in enumerate(li.schema.fields)],
                                  "ordinal int, column_name string")
    numeric = [f.name for f in li.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    return (m.join(names, "ordinal").filter(F.col("column_name").isin(numeric))
            .select("table_name", "column_name", "n_rows",
                    F.round("std", 4).alias("std"), F.round("min_num", 6).alias("min_num"),
                    F.round("max_num", 6).alias("max_num")))


STREAM_TABLES = ["orders", "customer"]


def _stream_oracle():
    from lakesonar.operators.embed import MODEL_ID
    parts = []
    for i, t in enumerate(STREAM_TABLES):
        cols = [c for c, _ in LAKE_TABLES[t]]
        uniq = " + ".join(f"count(DISTINCT {c})" for c in cols)
        parts.append(f"SELECT '{t}' AS id, {i} AS batch, '{MODEL_ID}' AS model_id, "
                     f"{len(cols)} AS n_fields, '{','.join(cols)}' AS field_names, "
                     f"{uniq} AS unique_total FROM {t}")
    return union_sql(parts)


# The index records what each micro-batch stored: one table per run, in
# arrival order, with its summary (field names and exact distinct counts).
@query("stream_reindex", _stream_oracle())
def q_stream_reindex(spark, sf_dir):
    root = new_table_path(spark, "stream-lake")
    index_path = new_table_path(spark, "stream-index")
    ckpt = new_table_path(spark, "stream-ckpt")
    for name in STREAM_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{root}/{name}")
        q = start_reindex(spark, root, index_path, ckpt, incremental=False)  # exact distinct counts
        q.awaitTermination()
    j = F.from_json("json_summary", "struct<fields: array<struct<column: string, properties: "
                                    "struct<num_unique_values: bigint>>>, field_names: array<string>>")
    return open_index(spark, index_path).select(
        "id", "batch", "model_id", F.size(j["field_names"]).alias("n_fields"),
        F.array_join(j["field_names"], ",").alias("field_names"),
        F.aggregate(j["fields"], F.lit(0).cast("long"),
                    lambda a, f: a + f["properties"]["num_unique_values"]).alias("unique_total"))


# --- stored statistics of files: a table's profile without reading it again ---

def _file_stats_oracle():
    from lakesonar.plans.q_profile import _lake_oracle
    return (f"SELECT table_name, column_name, n_rows, dtype, std, min_num, max_num, min, max, samples, n_samples, "
            f"num_unique_values, true AS within_bound, false AS distinct_is_exact FROM ({_lake_oracle()})")


@query("file_stats_profile", _file_stats_oracle())
def q_file_stats_profile(spark, sf_dir):
    """Profiles of all tables from stored statistics of files that came in two batches, each table's third file
    gone again. Distinct counts from the united sketches are tested against exact ones."""
    from lakesonar.operators.profile import profile
    from lakesonar.plans.registry import read_lake
    from lakesonar.streaming.stats import current_file_stats, file_stats, forget_files, merged_profile, write_file_stats
    tabs = read_lake(spark, sf_dir)
    path = new_table_path(spark, "file-stats")
    # as if each row's hash named the file that holds it
    name = {t: F.when(F.pmod(F.xxhash64(df.columns[0]), F.lit(2)) == 0, "a").otherwise("b") for t, df in tabs.items()}
    write_file_stats(file_stats({t: df.filter(name[t] == "a") for t, df in tabs.items()}, F.lit("a")), path, 0)
    second = [file_stats({t: df.filter(name[t] == "b") for t, df in tabs.items()}, F.lit("b")),
              file_stats({t: df.filter(name[t] == "a") for t, df in tabs.items()}, F.lit("copy"))]
    write_file_stats(second[0].unionByName(second[1]), path, 1)
    lost = spark.createDataFrame([(t, "copy") for t in tabs], "source string, file string")
    forget_files(spark, path, lost, 2)
    p = merged_profile(current_file_stats(spark, path))
    exact = profile(tabs, n_samples=0).select("table_name", "column_name", F.col("num_unique_values").alias("truth"))
    plain = F.col("integral") | F.col("spark_type").isin("string", "timestamp", "timestamp_ntz")
    return p.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "n_rows", "dtype", F.round("std", 4).alias("std"),
        F.round("min_num", 6).alias("min_num"), F.round("max_num", 6).alias("max_num"),
        F.when(plain, F.col("min")).alias("min"), F.when(plain, F.col("max")).alias("max"),
        F.when(plain & (F.size("samples") > 0), F.array_join("samples", "|")).alias("samples"),
        F.size("samples").cast("long").alias("n_samples"), F.col("truth").alias("num_unique_values"),
        (F.abs(F.col("num_unique_values") - F.col("truth")) <= F.col("distinct_error") * F.col("truth")).alias("within_bound"),
        "distinct_is_exact")

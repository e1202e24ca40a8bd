"""Registered source, scan and schema-catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesonar.operators.profile import profile
from lakesonar.operators.schema import columns, observed_nullability, save_schema_map, schema_text
from lakesonar.operators.summary import summarize
from lakesonar.plans.registry import LAKE_TABLES, query, read_lake, union_sql
from lakesonar.session import new_table_path
from lakesonar.sources.inventory import inventory, parse_s3_path, pick_default_file
from lakesonar.sources.scan import read_file, sample_rows, to_records

ORACLE_DIR = "/root/testdata/sf0.01"

# DuckDB type names → Spark type names, for the oracle.
DUCK_TO_SPARK = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
                 "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}


@query("lake_inventory", f"""
SELECT regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '') AS table_name,
       regexp_extract(file, '([^/]*)$', 1) AS file_name,
       lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS format
FROM glob('{ORACLE_DIR}/*') WHERE regexp_matches(lower(file), '\\.(csv|parquet)$')""")
def q_lake_inventory(spark, sf_dir):
    return inventory(spark, sf_dir).select("table_name", "file_name", "format")


@query("path_parts", """
WITH p AS (
  SELECT 'doc' AS src, doc_id AS id, 's3://' || source || '/' || lang || '/' || doc_id || '.parquet' AS path FROM documents
  UNION ALL SELECT 'page', page_id, replace(url, 'http://', 's3://') FROM pages
  UNION ALL SELECT 'bucket', doc_id, 's3://' || source FROM documents
  UNION ALL SELECT 'slash', doc_id, 's3://' || source || '/' FROM documents
  UNION ALL SELECT 'bad', page_id, url FROM pages)
SELECT src, id, path,
  CASE WHEN starts_with(path, 's3://') THEN split_part(substr(path, 6), '/', 1) END AS bucket,
  CASE WHEN starts_with(path, 's3://') THEN
    CASE WHEN strpos(substr(path, 6), '/') > 0 THEN substr(substr(path, 6), strpos(substr(path, 6), '/') + 1) ELSE '' END
  END AS prefix
FROM p""")
def q_path_parts(spark, sf_dir):
    t = read_lake(spark, sf_dir, ["documents", "pages"])
    d, pg = t["documents"], t["pages"]
    p = (d.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                  F.concat(F.lit("s3://"), "source", F.lit("/"), "lang", F.lit("/"),
                           F.col("doc_id").cast("string"), F.lit(".parquet")).alias("path"))
         .union(pg.select(F.lit("page"), "page_id", F.replace("url", F.lit("http://"), F.lit("s3://"))))
         .union(d.select(F.lit("bucket"), "doc_id", F.concat(F.lit("s3://"), "source")))
         .union(d.select(F.lit("slash"), "doc_id", F.concat(F.lit("s3://"), "source", F.lit("/"))))
         .union(pg.select(F.lit("bad"), "page_id", "url")))
    parsed = parse_s3_path(F.col("path"))
    return p.select("src", "id", "path", parsed["bucket"].alias("bucket"), parsed["prefix"].alias("prefix"))


@query("pick_default_file", f"""
SELECT regexp_extract(min(file), '([^/]*)$', 1) AS file_name, 'first' AS how
FROM glob('{ORACLE_DIR}/*') WHERE regexp_matches(lower(file), '\\.(csv|parquet)$')
UNION ALL SELECT 'orders.parquet', 'given'""")
def q_pick_default_file(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    first = pick_default_file(inv).select("file_name", F.lit("first").alias("how"))
    given = pick_default_file(inv, "orders.parquet").select("file_name", F.lit("given").alias("how"))
    return first.union(given)


@query("sample_records", """
SELECT c_custkey, to_json(struct_pack(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) AS record
FROM customer""")
def q_sample_records(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return to_records(sample_rows(c, num_rows=None), key_cols=["c_custkey"])


@query("csv_roundtrip_scan", """
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment
FROM customer""")
def q_csv_roundtrip_scan(spark, sf_dir):
    path = new_table_path(spark, "customer-csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.option("header", "true").csv(path)
    back = read_file(spark, path, fmt="csv")
    return back.select(F.col("c_custkey").cast("long"), "c_name",
                       F.col("c_nationkey").cast("long"), F.round("c_acctbal", 2).alias("c_acctbal"),
                       "c_mktsegment")


@query("csv_columns", """
SELECT 'customer_csv' AS table_name, (ordinal_position - 1)::INTEGER AS ordinal, column_name,
       CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'double'
            ELSE 'string' END AS type_name, true AS nullable
FROM information_schema.columns WHERE table_name = 'customer'""")
def q_csv_columns(spark, sf_dir):
    """C2 on a CSV file: types from all rows of the customer table."""
    from lakesonar.operators.schema import file_columns
    path = new_table_path(spark, "customer-csv-cols")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.option("header", "true").csv(path)
    return file_columns(spark, "customer_csv", path, fmt="csv")


@query("csv_documents", """
SELECT doc_id::BIGINT AS doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, n_chars::BIGINT AS n_chars,
       (length(text) - length(replace(replace(text, '"', ''), chr(10), '')))::BIGINT AS n_marks, 0::BIGINT AS n_bad
FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN '"' || replace(text, ' ', ' "quoted", ') ELSE text END AS text) FROM documents)""")
def q_csv_documents(spark, sf_dir):
    """Whole texts, with line feeds, doubled quotes and commas, through CSV and back; no row is bad."""
    path = new_table_path(spark, "documents-csv")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit(" "), F.lit(' "quoted", ')))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, quoted).otherwise(F.col("text")))
    (docs.write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    back = read_file(spark, path, fmt="csv", bad_records="_bad")
    marks = F.length("text") - F.length(F.translate("text", '"\n', ""))
    return back.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang", "source",
                       F.col("n_chars").cast("long"), marks.cast("long").alias("n_marks"),
                       F.when(F.col("_bad").isNotNull(), 1).otherwise(0).cast("long").alias("n_bad"))


def nested_lake(spark, sf_dir: str, root: str) -> None:
    """All tables in nested folders: one partitioned, one beside a CSV copy, one folder below another table's."""
    for t, df in read_lake(spark, sf_dir).items():
        folder = f"{root}/{'even' if len(t) % 2 == 0 else 'odd'}/{t}"
        if t == "nation":
            df.write.mode("append").partitionBy("n_regionkey").parquet(folder)
        elif t == "region":
            df.write.mode("append").parquet(f"{root}/even/nation/old/region")
        else:
            df.write.parquet(folder)
        if t == "customer":
            df.write.mode("append").option("header", "true").csv(folder)


def _nested_oracle():
    def name(t):
        return "even/nation/old/region" if t == "region" else f"{'even' if len(t) % 2 == 0 else 'odd'}/{t}"
    parts = [f"SELECT '{name(t)}' AS table_name, 'parquet' AS format, count(*) AS n_rows, {len(cols)} AS n_columns FROM {t}"
             for t, cols in LAKE_TABLES.items()]
    return union_sql([*parts, f"SELECT '{name('customer')} (csv)', 'csv', count(*), {len(LAKE_TABLES['customer'])} FROM customer"])


@query("nested_lake", _nested_oracle())
def q_nested_lake(spark, sf_dir):
    """The tables that the inventory finds in a nested lake, each read whole."""
    from lakesonar.sources.scan import read_source
    root = new_table_path(spark, "nested-lake")
    nested_lake(spark, sf_dir, root)
    out = None
    # one row a table
    for r in inventory(spark, root).groupBy("table_name", "format", "source").agg(F.count(F.lit(1)).alias("n")).collect():
        df = read_source(spark, root, r["source"])
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(r["table_name"]).alias("table_name"), F.lit(r["format"]).alias("format"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.union(one)
    return out


def _columns_oracle():
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DUCK_TO_SPARK.items())
    return f"""
SELECT table_name, (ordinal_position - 1)::INTEGER AS ordinal, column_name,
       CASE data_type {case} ELSE lower(data_type) END AS type_name, is_nullable = 'YES' AS nullable
FROM information_schema.columns
WHERE table_name IN ({', '.join(f"'{t}'" for t in LAKE_TABLES)})"""


@query("list_columns", _columns_oracle())
def q_list_columns(spark, sf_dir):
    return columns(read_lake(spark, sf_dir))


def documents_with_nulls(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan")))
        .otherwise(F.col("n_chars").cast("double")).alias("n_chars"),
        "text")


@query("observed_nullability", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars::DOUBLE END AS n_chars, text FROM documents)
SELECT 'documents' AS table_name, 'doc_id' AS column_name, count(*) - count(doc_id) AS n_null FROM d
UNION ALL SELECT 'documents', 'lang', count(*) - count(lang) FROM d
UNION ALL SELECT 'documents', 'source', count(*) - count(source) FROM d
UNION ALL SELECT 'documents', 'n_chars', count(*) - count(n_chars) FROM d
UNION ALL SELECT 'documents', 'text', count(*) - count(text) FROM d""")
def q_observed_nullability(spark, sf_dir):
    tabs = {"documents": documents_with_nulls(spark, sf_dir)}
    cols = columns(tabs)
    obs = observed_nullability(tabs)
    return obs.join(cols, ["table_name", "ordinal"]).select(
        "table_name", "column_name", F.col("n_null").cast("long").alias("n_null"))


def _nullability_oracle():
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DUCK_TO_SPARK.items())
    return union_sql([f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE '{ty}' {case} END AS type_name, count(*) AS n_rows, "
                      f"count(*) - count({c}) AS n_null, count({c}) < count(*) AS observed_nullable FROM {t}"
                      for t, cols in LAKE_TABLES.items() for c, ty in cols])


@query("file_nullability", _nullability_oracle())
def q_file_nullability(spark, sf_dir):
    from lakesonar.operators.schema import file_nullability
    return file_nullability(spark, {t: f"{sf_dir}/{t}.parquet" for t in LAKE_TABLES}).drop("ordinal")


LIMITS = (7, 100, 1_000_000)


@query("sample_limits", union_sql([f"SELECT '{t}' AS table_name, {n} AS num_rows, least({n}, count(*))::BIGINT AS n_sampled FROM {t}"
                                   for t in LAKE_TABLES for n in LIMITS]))
def q_sample_limits(spark, sf_dir):
    """The row limit below and above the row count of every table."""
    out = None
    for t, df in read_lake(spark, sf_dir).items():
        for n in LIMITS:
            one = sample_rows(df, num_rows=n).agg(F.count(F.lit(1)).alias("n_sampled")).select(
                F.lit(t).alias("table_name"), F.lit(n).alias("num_rows"), "n_sampled")
            out = one if out is None else out.union(one)
    return out


@query("sampled_summaries", union_sql([
    f"SELECT '{t}' AS name, least(50, count(*))::BIGINT AS n_rows, {len(cols)} AS n_fields, true AS is_base, "
    f"'{','.join(c for c, _ in cols)}' AS field_names FROM {t}" for t, cols in LAKE_TABLES.items()]))
def q_sampled_summaries(spark, sf_dir):
    """Base summaries (no semantic type, no description) of at most 50 rows of every table."""
    from lakesonar.plans.lake_search import build_summaries
    tabs = read_lake(spark, sf_dir)
    p = profile(tabs, sample_rows=50, n_samples=0).groupBy(F.col("table_name").alias("name")).agg(F.max("n_rows").alias("n_rows"))
    s = build_summaries(tabs, sample_rows=50, enrich=False)
    blank = F.forall("fields", lambda f: (f["properties"]["semantic_type"] == "") & (f["properties"]["description"] == ""))
    return s.join(p, "name").select("name", "n_rows", F.size("fields").alias("n_fields"),
                                    (blank & (F.col("dataset_description") == "")).alias("is_base"),
                                    F.array_join("field_names", ",").alias("field_names"))


def _schema_text_oracle():
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DUCK_TO_SPARK.items())
    return f"""
SELECT table_name, string_agg('|-- ' || column_name || ': ' || (CASE data_type {case} ELSE lower(data_type) END)
  || ' (nullable = ' || CASE WHEN is_nullable = 'YES' THEN 'true' ELSE 'false' END || ')' || chr(10), ''
  ORDER BY ordinal_position) AS schema_text
FROM information_schema.columns
WHERE table_name IN ({', '.join(f"'{t}'" for t in LAKE_TABLES)}) GROUP BY table_name"""


@query("schema_text", _schema_text_oracle())
def q_schema_text(spark, sf_dir):
    return schema_text(columns(read_lake(spark, sf_dir)))


@query("schema_map", f"SELECT count(*) AS n_tables, sum(length(schema_text)) AS n_chars FROM ({_schema_text_oracle()})")
def q_schema_map(spark, sf_dir):
    path = new_table_path(spark, "schema-map")
    save_schema_map(schema_text(columns(read_lake(spark, sf_dir))), path)
    back = spark.read.json(path)
    return back.agg(F.count(F.lit(1)).alias("n_tables"),
                    F.sum(F.length("schema_text")).cast("long").alias("n_chars"))


SUMMARY_TABLES = ["customer", "orders", "lineitem"]


def _summary_oracle():
    parts = []
    for t in SUMMARY_TABLES:
        names = ",".join(c for c, _ in LAKE_TABLES[t])
        parts.append(f"SELECT '{t}' AS name, '{t}' AS file_name, '' AS dataset_description, "
                     f"'{names}' AS field_names, {len(LAKE_TABLES[t])} AS n_fields")
    return union_sql(parts)


@query("table_summary", _summary_oracle())
def q_table_summary(spark, sf_dir):
    s = summarize(profile(read_lake(spark, sf_dir, SUMMARY_TABLES)))
    return s.select("name", "file_name", "dataset_description",
                    F.array_join("field_names", ",").alias("field_names"),
                    F.size("fields").alias("n_fields"))

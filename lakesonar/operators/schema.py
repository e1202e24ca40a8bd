"""Schema catalog.

Column lists come from each DataFrame's schema (Parquet footers, catalog
metadata), never from data. Observed nullability (C3) is one wide aggregate a table, or read
off the footers of Parquet files.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.functions.render import FRACTIONAL, quote
from lakesonar.operators.profile import _as_items


def columns(tables) -> DataFrame:
    """(table_name, ordinal, column_name, type_name, nullable)."""
    rows = [(name, i, f.name, f.dataType.simpleString().lower(), bool(f.nullable))
            for name, df in _as_items(tables) for i, f in enumerate(df.schema.fields)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, type_name string, nullable boolean")


def file_columns(spark: SparkSession, name: str, path: str, fmt: str | None = None) -> DataFrame:
    """Columns of a lake file (C2): Parquet from its footer, CSV with types
    inferred from all rows, as ``read_file`` reads them."""
    from lakesonar.sources.scan import read_file
    return columns([(name, read_file(spark, path, fmt=fmt))])


def catalog_columns(spark: SparkSession, table: str) -> DataFrame:
    """Columns of a catalog table as declared by the catalog."""
    return columns([(table, spark.table(table))])


def _null_rows(name: str, df: DataFrame, keep=None) -> DataFrame:
    """(table_name, ordinal, n_rows, n_null) of a table by one aggregate with a counter for each column; NaN counts as null."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if keep is None or i in keep]

    def missing(f):
        c = F.col(quote(f.name))
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, FRACTIONAL) else c.isNull()

    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(f)).alias(f"c{i}") for i, f in fields])
    return one.select(F.lit(name).alias("table_name"), F.inline(F.array(*[F.struct(
        F.lit(i).alias("ordinal"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_null")) for i, _ in fields])))


def observed_nullability(tables) -> DataFrame:
    """(table_name, ordinal, n_rows, n_null, observed_nullable): any null in the
    rows read; NaN counts as null, as in pandas (C3). One row leaves each task of a table's scan."""
    out = None
    for name, df in _as_items(tables):
        if df.columns:
            one = _null_rows(name, df)
            out = one if out is None else out.union(one)
    return out.withColumn("observed_nullable", F.col("n_null") > 0)


FOOTER_CONF = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footer_reads(spark: SparkSession):
    """Inside, Parquet tables are read through the source that answers counts, minima and maxima from file footers."""
    before = {k: spark.conf.get(k, None) for k in FOOTER_CONF}
    try:
        for k, v in FOOTER_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def footer_counts(df: DataFrame) -> tuple[DataFrame, list[int]]:
    """(one row of counts, the ordinals counted) that the footers of ``df``, read inside :func:`footer_reads`, answer:
    row count and non-null counts of the columns that can hold neither NaN nor nested values."""
    flat = [i for i, f in enumerate(df.schema.fields) if not isinstance(
        f.dataType, (*FRACTIONAL, T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(quote(df.columns[i]))).alias(f"c{i}") for i in flat]), flat


def file_nullability(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, ordinal, column_name, type_name, n_rows, n_null, observed_nullable) of Parquet tables (C2, C3): row and
    null counts from the file footers, without reading rows; only columns that can hold NaN or nested
    values are scanned. The result is metadata, one row a column."""
    rows, scans = [], None
    with footer_reads(spark):
        for name, path in paths.items():
            df = spark.read.parquet(path)
            counts, flat = footer_counts(df)
            r = counts.first()
            rows += [(name, i, r["n"], r["n"] - r[f"c{i}"]) for i in flat]
    for name, path in paths.items():
        df = spark.read.parquet(path)
        rest = set(range(len(df.columns))) - {i for n, i, _, _ in rows if n == name}
        if rest:
            one = _null_rows(name, df, rest)
            scans = one if scans is None else scans.union(one)
    schema = "table_name string, ordinal int, n_rows long, n_null long"
    found = spark.createDataFrame(rows, schema)
    found = found if scans is None else found.union(scans.select("table_name", "ordinal", "n_rows", "n_null"))
    cols = columns({n: spark.read.parquet(p) for n, p in paths.items()})
    return cols.join(found, ["table_name", "ordinal"]).select(
        "table_name", "ordinal", "column_name", "type_name", "n_rows", "n_null", (F.col("n_null") > 0).alias("observed_nullable"))


def schema_line(name: str = "column_name", type_name: str = "type_name",
                nullable: str = "nullable"):
    """``|-- {name}: {type} (nullable = true|false)\\n`` (C4)."""
    return F.concat(F.lit("|-- "), F.col(name), F.lit(": "), F.lower(F.col(type_name)),
                    F.lit(" (nullable = "),
                    F.when(F.col(nullable), F.lit("true")).otherwise(F.lit("false")),
                    F.lit(")\n"))


def schema_text(cols: DataFrame) -> DataFrame:
    """(table_name, schema_text): lines in column order, '' for no columns.

    The ordered aggregation per table is bounded by its column count.
    """
    lines = cols.select("table_name", "ordinal", schema_line().alias("line"))
    return lines.groupBy("table_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))),
                                 lambda x: x["line"]), "").alias("schema_text"))


def save_schema_map(schema_df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write the table → schema text map (C6, re-aimed from Python source to data)."""
    # one row per table (catalog metadata, not data): a single output file
    schema_df.coalesce(1).write.mode("overwrite").format(fmt).save(path)
    return path

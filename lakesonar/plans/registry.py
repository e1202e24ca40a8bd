"""Registry of named queries with their DuckDB oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesonar.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The driver's tables (FIXTURES.md §2) with DuckDB types.
LAKE_TABLES = {
    "region": [("r_regionkey", "INTEGER"), ("r_name", "VARCHAR")],
    "nation": [("n_nationkey", "INTEGER"), ("n_name", "VARCHAR"), ("n_regionkey", "INTEGER")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "DOUBLE"), ("c_mktsegment", "VARCHAR")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "VARCHAR"), ("s_nationkey", "INTEGER"),
                 ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "VARCHAR"), ("p_brand", "VARCHAR"),
             ("p_type", "VARCHAR"), ("p_size", "INTEGER"), ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"),
               ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP"),
               ("o_orderpriority", "VARCHAR")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"),
                 ("l_linenumber", "INTEGER"), ("l_quantity", "DOUBLE"),
                 ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"),
                 ("l_returnflag", "VARCHAR"), ("l_linestatus", "VARCHAR"),
                 ("l_shipdate", "TIMESTAMP")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"),
               ("event_type", "VARCHAR"), ("value", "DOUBLE"), ("props", "VARCHAR")],
    "documents": [("doc_id", "BIGINT"), ("text", "VARCHAR"), ("lang", "VARCHAR"),
                  ("source", "VARCHAR"), ("n_chars", "BIGINT")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "FLOAT[]"), ("label", "INTEGER")],
    "pages": [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")],
    "benchmark": [("item_id", "BIGINT"), ("text", "VARCHAR")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INTEGER"), ("toxic", "INTEGER")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"),
                      ("text", "VARCHAR")],
}
NUMERIC_DUCK = ("INTEGER", "BIGINT", "DOUBLE")
INTEGRAL_DUCK = ("INTEGER", "BIGINT")


def query(name: str, oracle: str | None = None):
    """Register a Spark query (and its oracle SQL, when SQL can express it)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


_READS: dict[tuple, DataFrame] = {}
# A lake table of this many bytes in all may come as one file that Spark cannot
# split; it is dealt round-robin, which moves at most the upper bound. Larger
# tables are never moved: their splits follow the file settings.
SMALL_TABLE_BYTES = (1 << 20, 128 << 20)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Resolved handles (schema, file listing) are
    reused within one application; data is read when a query runs."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _READS:
        path = f"{sf_dir}/{name}.parquet"
        df = spark.read.parquet(path)
        sc = spark.sparkContext
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        size = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(hpath).getLength()
        low, high = SMALL_TABLE_BYTES
        _READS[key] = df.repartition(sc.defaultParallelism) if low <= size < high else df
    return _READS[key]


def read_lake(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """The driver's tables as DataFrames."""
    return {n: read_table(spark, sf_dir, n) for n in names or list(LAKE_TABLES)}


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)

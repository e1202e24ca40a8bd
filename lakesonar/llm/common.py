"""Helpers the operators share: written tables in the shared folder, global
ranks without a single-task sort, hashes of keys, column names that cannot clash."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesonar.session import new_table_path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    lineage, and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakesonar_path = path  # for drop_table
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`write_table` that nothing
    lazy reads any more."""
    sc = df.sparkSession.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(df._lakesonar_path)
    hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Actions inside send Python tasks at most ``rows`` rows a batch: whole texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_HELD: dict = {}


def held(owner: str, make=None):
    """What the operator ``owner`` keeps in a Python worker from task to task, made when it is first asked for.
    Workers outlive stages, so whatever other operators kept there is dropped first; without
    ``make`` nothing is kept."""
    if owner not in _HELD:
        if _HELD:
            _HELD.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)  # where the C library has it: freed memory goes back to the system
            except (AttributeError, OSError):
                pass
        if make is None:
            return None
        _HELD[owner] = make()
    return _HELD[owner]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def id_text(key: str = "doc_id") -> Column:
    """A key as text; null counts as the empty string."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def unit_hash(text: Column) -> Column:
    """A text hashed to the open interval (0, 1): the first 52 bits of its md5."""
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2 ** 52))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, order: list[str], group: list[str], out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of a row within its ``group`` by ``order``.

    No group is collected or sorted in one task: the (narrow) rows are range
    partitioned by ``order`` and, so that a value many rows share can be cut
    too, by a running number; ranks inside a (group, range) are added to the
    prefix sum of the counts of earlier ranges. Rows that tie in ``order`` get
    neighbouring ranks in any order. The ranged rows are a written table, so
    counts and ranks see the same ranges even if tasks are run again.
    """
    spark = df.sparkSession
    num, part, before = fresh(df, "_num", "_part", "_before")
    rows = write_table(df.withColumn(num, F.monotonically_increasing_id()), "rank-rows")
    ranged = write_table(
        rows.repartitionByRange(partitions(spark), *order, num)
        .withColumn(part, F.spark_partition_id()), "rank-ranges")
    drop_table(rows)
    keys = [*group, part]
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.select(*keys, F.coalesce(
        F.sum("_n").over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys).orderBy(*order, num)
    return (ranged.join(offsets, keys)
            .withColumn(out, F.col(before) + F.row_number().over(inside) - 1)
            .select(*df.columns, out))

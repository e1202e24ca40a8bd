"""Lake inventory.

The file listing is a Spark scan of the ``binaryFile`` source with only
metadata columns selected, so ``content`` is pruned from the read schema and
listing is distributed by Spark's parallel partition discovery.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The file formats a lake table may have.
VALID_EXTENSIONS = ("csv", "parquet")
VALID_FILE_PATTERN = r"(?i)\.(csv|parquet)$"
# The URI scheme the path parser accepts.
S3_SCHEME = "s3://"


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every file under ``root`` with size and modification time."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(root)
            .select(F.col("path"),
                    F.col("length").alias("size_bytes"),
                    F.col("modificationTime").alias("modified_at")))


def file_name(path: Column) -> Column:
    """Last path segment."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_format(path: Column) -> Column:
    """Lower-cased extension, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def below_root(path: Column, root: str) -> Column:
    """The part of a path below the lake's root folder."""
    bare = re.sub(r"^[a-z0-9+.-]+:/*", "/", root).rstrip("/") + "/"
    return F.substring(path, F.instr(path, bare) + F.lit(len(bare)), F.length(path))


# A *source* is what one table is read from. A file right below the root is a source of its own, named by its path; any other
# file belongs to the deepest folder above it that is no partition folder (``k=v``), together with that folder's
# other files of its format: ``sales/eu/orders|parquet``. The root's own partition folders make ``|parquet``.

def lake_source(path: Column, root: str) -> Column:
    """The source that a file of the lake belongs to."""
    below = below_root(path, root)
    folders = F.regexp_replace(F.regexp_extract(below, r"^(.*/)?[^/]*$", 1), r"/$", "")
    folder = F.regexp_replace(folders, r"(^|/)[^/=]*=[^/]*(/[^/=]*=[^/]*)*$", "")
    return F.when(folders == "", below).otherwise(F.concat(folder, F.lit("|"), file_format(path)))


def source_parts(source: str, root: str) -> tuple[str, str, str, bool]:
    """(table name if no other source wants it, path below the root, format, is a file) of a source."""
    folder, bar, fmt = source.rpartition("|")
    if not bar:
        stem, _, ext = source.rpartition(".")
        return stem, source, ext.lower(), True
    bare = re.sub(r"(?i)\.(csv|parquet)$", "", folder) or root.rstrip("/").rsplit("/", 1)[-1]
    return bare, folder, fmt, False


def source_names(sources, root: str) -> dict[str, str]:
    """The table name of each source: its path below the root without a format's ending. Of sources that want the same name a Parquet
    folder, then a CSV folder, then a file gets it; a second folder is named with its format, a second
    file with its ending."""
    names: dict[str, str] = {}
    order = {"parquet": 0, "csv": 1}
    for source in sorted(sources, key=lambda s: (source_parts(s, root)[3], order.get(source_parts(s, root)[2], 2), s)):
        bare, path, fmt, is_file = source_parts(source, root)
        name = bare if bare not in names.values() else path if is_file else f"{bare} ({fmt})"
        while name in names.values():
            name += "'"
        names[source] = name
    return names


def name_sources(df: DataFrame, root: str) -> DataFrame:
    """``df`` with the ``table_name`` of its ``source``, by the rule of :func:`source_names`; sources are told apart by one
    aggregation, not on the driver."""
    src = df.select("source").distinct()
    is_file = ~F.col("source").contains("|")
    path = F.regexp_replace("source", r"\|[^|]*$", "")
    plain = F.regexp_replace(path, r"(?i)\.(csv|parquet)$", "")
    bare = F.when(plain == "", F.lit(root.rstrip("/").rsplit("/", 1)[-1])).otherwise(plain)
    fmt = F.when(is_file, F.lower(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1))).otherwise(F.regexp_extract("source", r"\|([^|]*)$", 1))
    order = F.when(fmt == "parquet", 0).when(fmt == "csv", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("_bare").orderBy("_file", "_order", "source")) == 1  # a few sources share a name
    named = (src.withColumns({"_bare": bare, "_file": is_file, "_order": order, "_fmt": fmt, "_path": path})
             .withColumn("table_name", F.when(first, F.col("_bare")).when(F.col("_file"), F.col("_path"))
                         .otherwise(F.concat("_bare", F.lit(" ("), "_fmt", F.lit(")")))))
    return df.join(named.select("source", "table_name"), "source")


def is_valid_file(path: Column) -> Column:
    """Keep only .csv / .parquet, case-insensitive."""
    return path.rlike(VALID_FILE_PATTERN)


def inventory(spark: SparkSession, root: str, only_valid: bool = True) -> DataFrame:
    """inventory(table_name, path, file_name, format, size_bytes, modified_at, source)."""
    files = list_files(spark, root)
    if only_valid:
        files = files.filter(is_valid_file(F.col("path")))
    return name_sources(files.withColumn("source", lake_source(F.col("path"), root)), root).select(
        "table_name",
        F.col("path"),
        file_name(F.col("path")).alias("file_name"),
        file_format(F.col("path")).alias("format"),
        F.col("size_bytes"),
        F.col("modified_at"),
        "source",
    )


def parse_s3_path(path: Column, strict: bool = False) -> Column:
    """Split ``s3://bucket/prefix`` into struct(bucket, prefix) (S3).

    Missing prefix gives ''. A path with another scheme gives null, or an
    error when ``strict``.
    """
    ok = path.startswith(S3_SCHEME)
    rest = F.substring(path, len(S3_SCHEME) + 1, 1 << 30)
    bucket = F.substring_index(rest, "/", 1)
    # prefix = everything after the first '/', '' when there is none
    prefix = F.when(F.instr(rest, "/") > 0,
                    F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)).otherwise(F.lit(""))
    parsed = F.struct(bucket.alias("bucket"), prefix.alias("prefix"))
    if strict:
        return F.when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit("path must start with 's3://': "), path)))
    return F.when(ok, parsed)


def pick_default_file(inv: DataFrame, key: str | None = None) -> DataFrame:
    """The given key when present, else the first valid file by path.

    Returns one row, or raises ``ValueError`` when there is none.
    """
    valid = inv.filter(is_valid_file(F.col("path")))
    if key is not None:
        chosen = valid.filter((F.col("path") == key) | (F.col("file_name") == key))
    else:
        chosen = valid.orderBy("path").limit(1)
    if chosen.isEmpty():
        raise ValueError(f"no CSV or Parquet file{f' {key}' if key else ''} in the lake")
    return chosen


def ensure_supported(fmt: str) -> str:
    """Reject other formats."""
    f = (fmt or "").lower()
    if f not in VALID_EXTENSIONS:
        raise ValueError(f"cannot read {fmt!r} files: a lake holds {' and '.join(sorted(VALID_EXTENSIONS))}")
    return f


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Table names of a catalog schema, all of them (S1, no page cap). Without a
    schema the session's temporary views are listed too; they belong to none."""
    quoted = ".".join("`" + p.replace("`", "``") + "`" for p in database.split(".")) if database else ""
    found = spark.sql(f"SHOW TABLES IN {quoted}" if database else "SHOW TABLES")
    if database:
        found = found.filter(~F.col("isTemporary"))
    return found.select(
        F.col("namespace").alias("database"),
        F.col("tableName").alias("table_name"),
        F.col("isTemporary").alias("is_temporary"))

"""Table scans, row samples and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.sources.inventory import below_root, ensure_supported, lake_source, list_files, source_parts


# The quoting that CSV files have elsewhere (a quote inside a quoted value is doubled).
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"'}


def read_csv(reader, paths, infer_ratio: float | None = None, multi_line: bool = True,
             bad_records: str | None = None) -> DataFrame:
    """CSV with quoted line feeds and doubled quotes. Types are inferred from all rows, or with ``infer_ratio``
    from a fraction of them. ``multi_line=False`` is for files without quoted line feeds, which then can
    be split. ``bad_records`` names a column for the text of rows that do not fit the types; it is null for the others."""
    for k, v in {**CSV_DIALECT, "multiLine": str(multi_line).lower()}.items():
        reader = reader.option(k, v)
    inferring = reader.option("inferSchema", "true").option("samplingRatio", str(infer_ratio or 1.0))
    df = inferring.csv(paths)
    if bad_records is None:
        return df
    schema = T.StructType([*df.schema.fields, T.StructField(bad_records, T.StringType())])
    return reader.option("inferSchema", "false").option("columnNameOfCorruptRecord", bad_records).schema(schema).csv(paths)


def read_file(spark: SparkSession, path: str, fmt: str | None = None,
              infer_ratio: float | None = None, **csv) -> DataFrame:
    """Read one lake file (or folder of one format) as a DataFrame (S7, S8, S9); ``csv``: see :func:`read_csv`."""
    f = ensure_supported(fmt or path.rsplit(".", 1)[-1])
    if f == "parquet":
        return spark.read.parquet(path)
    return read_csv(spark.read, path, infer_ratio, **csv)


def read_files(spark: SparkSession, root: str, source: str, paths: list[str], **csv) -> DataFrame:
    """Some files of a lake's source, with the columns of its partition folders."""
    _, folder, fmt, is_file = source_parts(source, root)
    ensure_supported(fmt)
    reader = spark.read
    if not is_file:
        reader = reader.option("basePath", f"{root.rstrip('/')}/{folder}".rstrip("/"))
    return reader.parquet(*paths) if fmt == "parquet" else read_csv(reader, paths, **csv)


def read_source(spark: SparkSession, root: str, source: str, **csv) -> DataFrame:
    """A whole source of a lake: a file, or a folder's files of one format with its partition folders, but not the tables in
    folders below it."""
    root = root.rstrip("/")
    _, folder, fmt, is_file = source_parts(source, root)
    if is_file:
        return read_file(spark, f"{root}/{folder}", fmt, **csv)
    top = f"{root}/{folder}".rstrip("/")
    ending = "".join(f"[{c}{c.upper()}]" for c in fmt)
    files = list_files(spark, top).filter(lake_source(F.col("path"), root) == source)
    depth = F.size(F.split(below_root(F.col("path"), top), "/"))
    depths = sorted(r[0] for r in files.select(depth).distinct().collect())  # how many partition folders deep
    return read_files(spark, root, source, [f"{top}{'/*=*' * (d - 1)}/*.{ending}" for d in depths], **csv)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by (possibly three-part) name."""
    return spark.table(name)


def sample_rows(df: DataFrame, num_rows: int | None = 5, fraction: float | None = None,
                seed: int = 42) -> DataFrame:
    """First ``num_rows`` rows (``TABLESAMPLE (n ROWS)`` / ``head``) or a seeded sample.

    ``num_rows=None`` keeps the whole table.
    """
    if fraction is not None:
        df = df.sample(withReplacement=False, fraction=fraction, seed=seed)
    if num_rows is not None:
        df = df.limit(num_rows)
    return df


def to_records(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Rows as JSON records with null fields kept."""
    rec = F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                    {"ignoreNullFields": "false"}).alias("record")
    keys = [F.col(c) for c in (key_cols or [])]
    return df.select(*keys, rec)

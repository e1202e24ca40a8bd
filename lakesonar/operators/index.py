"""Idempotent vector index on Parquet.

Layout::

    <path>/_log/<n>            a commit: the folder of each bucket and the deltas, as one line of JSON
    <path>/delta-<n>-<x>/      rows that came with commit n, by bucket
    <path>/base-<n>-<x>/       buckets rewritten by commit n

Rows belong to one of the index's buckets by a hash of their id. A write adds a delta of its own
rows only and then its commit; readers take the newest commit, so a failed write leaves
the index as it was, and two writers cannot both make commit n. Reading puts the newest delta row of an
id in place of the row in its bucket. After ``MAX_DELTAS`` deltas the buckets that they touch are rewritten
(:func:`compact`), all others keep their files. Ids are deterministic (X2), so a retried task writes the same records.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.session import table_exists

INDEX_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("norm", T.DoubleType()),
    T.StructField("enriched_text", T.StringType()),
    T.StructField("json_summary", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("source_modified_at", T.TimestampType()),
    T.StructField("indexed_at", T.TimestampType()),
    T.StructField("batch", T.LongType()),
])
STORED = T.StructType([*INDEX_SCHEMA.fields, T.StructField("b", T.IntegerType())])
# Buckets of a new index unless :func:`create_index` gives them, deltas that readers put up with,
# and the status of a removed id.
BUCKETS = 16
MAX_DELTAS = 8
REMOVED = "removed"


def record_id(name_col: str = "name", json_col: str = "json_summary") -> F.Column:
    """The summary name, else a hash of the summary (not a random UUID, so
    task retries and re-runs give the same id)."""
    return F.coalesce(F.nullif(F.col(name_col), F.lit("")), F.sha2(F.col(json_col), 256))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits."""
    if not table_exists(spark, f"{path}/_log"):
        return []
    fs, p = _fs(spark, f"{path}/_log")
    return sorted(int(st.getPath().getName()) for st in fs.listStatus(p) if st.getPath().getName().isdigit())


def commit_of(spark: SparkSession, path: str) -> dict:
    """The newest commit: {version, buckets, base: {bucket: folder}, deltas: [folder]}."""
    vs = versions(spark, path)
    if not vs:
        return {"version": 0, "buckets": BUCKETS, "base": {}, "deltas": []}
    fs, p = _fs(spark, f"{path}/_log/{vs[-1]}")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, state: dict) -> dict:
    """Write the next commit; a commit of that number by another writer makes this one fail."""
    state = state | {"version": state["version"] + 1}
    fs, staged = _fs(spark, f"{path}/_log/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_log/{state['version']}")
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise RuntimeError(f"another writer made commit {state['version']} of {path}")
    return state


def create_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """An empty index of so many buckets (a large one takes more: a compaction rewrites whole buckets)."""
    _begin(spark, path)
    _commit(spark, path, {"version": 0, "buckets": buckets, "base": {}, "deltas": []})


def _begin(spark: SparkSession, path: str) -> None:
    if not table_exists(spark, f"{path}/_log"):
        fs, log = _fs(spark, f"{path}/_log")
        fs.mkdirs(log)


def _base(spark: SparkSession, path: str, state: dict, only: list[int] | None = None) -> DataFrame:
    folders: dict[str, list[int]] = {}
    for bucket, folder in state["base"].items():
        if only is None or int(bucket) in only:
            folders.setdefault(folder, []).append(int(bucket))
    out = spark.createDataFrame([], STORED)
    for folder, buckets in sorted(folders.items()):  # a bucket's old files stay in the folder until vacuum: pruned by partition
        out = out.unionByName(spark.read.schema(STORED).parquet(f"{path}/{folder}").filter(F.col("b").isin(sorted(buckets))))
    return out


def _newest_delta(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    """The newest row of each id in the deltas, removed ones too."""
    out = None
    for n, folder in enumerate(state["deltas"]):
        one = spark.read.schema(STORED).parquet(f"{path}/{folder}").withColumn("_n", F.lit(n))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    if len(state["deltas"]) == 1:  # a delta holds an id once
        return out.drop("_n")
    rest = [f.name for f in STORED.fields if f.name != "id"]
    return out.groupBy("id").agg(F.max_by(F.struct(*rest), "_n").alias("r")).select("id", "r.*")


def _merged(base: DataFrame, delta: DataFrame | None) -> DataFrame:
    if delta is None:
        return base
    kept = base.join(delta.select("b", "id"), ["b", "id"], "left_anti").select(*base.columns)
    return kept.unionByName(delta.filter(F.coalesce("status", F.lit("ok")) != REMOVED).select(*base.columns))


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest commit, or an empty index."""
    state = commit_of(spark, path)
    return _merged(_base(spark, path, state), _newest_delta(spark, path, state)).drop("b")


def index_exists(spark: SparkSession, path: str) -> bool:
    """Does the index exist and hold anything?"""
    return bool(versions(spark, path)) and not open_index(spark, path).isEmpty()


def _conform(records: DataFrame, batch: int) -> DataFrame:
    cols = []
    for f in INDEX_SCHEMA.fields:
        if f.name in records.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "indexed_at":
            cols.append(F.current_timestamp().alias(f.name))
        elif f.name == "batch":
            cols.append(F.lit(batch).cast("long").alias(f.name))
        elif f.name == "status":
            cols.append(F.lit("ok").alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return records.select(*cols)


def dedupe_batch(records: DataFrame, order_col: str | None = None, keep: str = "first") -> DataFrame:
    """One record per id inside a batch. ``max_by``/``min_by`` aggregate with map-side
    partial aggregation, so a hot id never gathers its rows in one task."""
    # a struct is never null, so neither is a record whose order value is
    order = F.struct(F.col(order_col) if order_col else F.md5(F.coalesce("json_summary", F.lit(""))))
    pick = F.min_by if keep == "first" else F.max_by
    rec = F.struct(*[F.col(c) for c in records.columns if c != "id"])
    return (records.groupBy("id").agg(pick(rec, order).alias("r"))
            .select("id", "r.*"))


def _write(df: DataFrame, path: str, kind: str, state: dict) -> str:
    """Write rows by bucket into a new folder of their own; a folder without a commit is never read."""
    folder = f"{kind}-{state['version'] + 1}-{uuid.uuid4().hex[:8]}"
    bucket = F.pmod(F.xxhash64("id"), F.lit(state["buckets"])).cast("int")
    df.withColumn("b", bucket).repartition("b").write.partitionBy("b").parquet(f"{path}/{folder}")
    return folder


def _append(spark: SparkSession, path: str, rec: DataFrame, state: dict, max_deltas: int) -> DataFrame:
    """Commit ``rec`` as a delta; returns its rows as written."""
    folder = _write(rec, path, "delta", state)
    _begin(spark, path)
    state = _commit(spark, path, state | {"deltas": [*state["deltas"], folder]})
    if len(state["deltas"]) > max_deltas:
        compact(spark, path)
    return spark.read.schema(STORED).parquet(f"{path}/{folder}").drop("b")


def insert_if_absent(spark: SparkSession, path: str, records: DataFrame, batch: int = 0,
                     order_col: str | None = None, max_deltas: int = MAX_DELTAS) -> DataFrame:
    """X3/X4 as the reference's store behaves: a repeated id is ignored.

    ``records`` needs ``id`` plus any index columns. Returns the rows added.
    """
    rec = dedupe_batch(_conform(records, batch), order_col)
    state = commit_of(spark, path)
    if state["version"]:
        rec = rec.join(open_index(spark, path).select("id"), "id", "left_anti")
    return _append(spark, path, rec, state, max_deltas)


def upsert(spark: SparkSession, path: str, records: DataFrame, batch: int = 0,
           order_col: str | None = None, max_deltas: int = MAX_DELTAS) -> DataFrame:
    """X4 upsert: new rows replace old ones with the same id. Only the new rows are written, until
    ``max_deltas`` deltas are put into the buckets that they touch."""
    rec = dedupe_batch(_conform(records, batch), order_col, keep="last")
    _append(spark, path, rec, commit_of(spark, path), max_deltas)
    return open_index(spark, path)


def remove(spark: SparkSession, path: str, ids: DataFrame, batch: int = 0, max_deltas: int = MAX_DELTAS) -> DataFrame:
    """Remove the rows with these ids (a column ``id``)."""
    gone = _conform(ids.select("id").distinct().withColumn("status", F.lit(REMOVED)), batch)
    _append(spark, path, gone, commit_of(spark, path), max_deltas)
    return open_index(spark, path)


def compact(spark: SparkSession, path: str) -> list[int]:
    """Rewrite the buckets that the deltas touch; returns them. All other buckets keep their files."""
    state = commit_of(spark, path)
    delta = _newest_delta(spark, path, state)
    if delta is None:
        return []
    touched = sorted(r["b"] for r in delta.select("b").distinct().collect())  # at most one for each bucket
    folder = _write(_merged(_base(spark, path, state, touched), delta).drop("b"), path, "base", state)
    base = {b: f for b, f in state["base"].items() if int(b) not in touched}
    fs, p = _fs(spark, f"{path}/{folder}")
    written = {st.getPath().getName()[2:] for st in fs.listStatus(p) if st.getPath().getName().startswith("b=")}
    _commit(spark, path, state | {"base": base | {b: folder for b in written}, "deltas": []})
    return touched


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete folders and buckets that the newest commit does not name (no reader may still use an older one)."""
    state = commit_of(spark, path)
    used = {f"{f}/b={b}" for b, f in state["base"].items()}
    fs, p = _fs(spark, path)
    gone = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("delta-") and name not in state["deltas"]:
            gone.append(name)
        elif name.startswith("base-"):
            inside = [x.getPath().getName() for x in fs.listStatus(st.getPath()) if x.getPath().getName().startswith("b=")]
            stale = [b for b in inside if f"{name}/{b}" not in used]
            gone += [name] if len(stale) == len(inside) else [f"{name}/{b}" for b in stale]
    for name in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone


def reindex_delta(inventory: DataFrame, index: DataFrame) -> DataFrame:
    """Inventory rows (files) of tables that the index does not hold, or that are newer than the table's
    ``source_modified_at`` there."""
    seen = index.select(F.col("id").alias("table_name"), F.col("source_modified_at").alias("_seen"))
    return (inventory.join(seen, "table_name", "left")
            .filter(F.col("_seen").isNull() | (F.col("modified_at") > F.col("_seen"))).drop("_seen"))

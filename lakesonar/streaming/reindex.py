"""Periodic re-index as a Structured Streaming job (2.12, X7).

``readStream.format("binaryFile")`` over the lake folder lists new files only (the source keeps its own log in
the checkpoint). Each micro-batch reads *those files*, stores their mergeable statistics (``streaming/stats.py``),
and makes the summaries of the tables they belong to from the stored statistics of all their files: no
table is read again because a file was added. Distinct counts then come from sketches;
``incremental=False`` reads whole tables and counts exactly. ``availableNow`` processes what is there and
stops, which is the periodic form; a processing-time trigger keeps it running.
:func:`drop_missing` does the same for files that are gone, which a file stream does not report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.sources.inventory import (VALID_FILE_PATTERN, below_root, lake_source, list_files, source_names,
                                         source_parts)
from lakesonar.sources.scan import read_files, read_source
from lakesonar.streaming.stats import (current_file_stats, file_stats, forget_files, merged_profile, next_batch,
                                       write_file_stats)

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def own_path(root: str):
    """The path below the root of the file that a row was read from."""
    plain = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))  # a URI: only %xx are escapes
    return below_root(F.try_url_decode(plain), root)


def _records(spark: SparkSession, stats_path: str, root: str, touched: set[str], exact_names: dict[str, str]):
    """Index records of the tables that share a name with ``touched`` sources, from stored statistics."""
    from lakesonar.operators.enrich import offline_dataset_description, offline_enrich
    from lakesonar.operators.summary import summarize
    from lakesonar.plans.lake_search import index_records, index_text, materialize
    stats = current_file_stats(spark, stats_path).filter(F.col("source").isin(sorted(touched)))
    profiled = materialize(offline_enrich(merged_profile(stats, by=exact_names)))
    summaries = materialize(summarize(profiled, offline_dataset_description(profiled)).withColumn("enriched_text", index_text()))
    seen = stats.groupBy("source").agg(F.max("modified_at").alias("source_modified_at"))
    names = spark.createDataFrame(list(exact_names.items()), "source string, id string")
    return index_records(summaries).join(seen.join(names, "source").drop("source"), "id", "left")


def _refresh(spark: SparkSession, root: str, index_path: str, stats_path: str, changed: set[str], batch: int) -> None:
    """Bring the index records of the ``changed`` sources, and of those that share their names, up to date."""
    from lakesonar.operators.index import open_index, remove, upsert
    # sources with a stored file: metadata, one row a table
    known = {r["source"] for r in current_file_stats(spark, stats_path).select("source").distinct().collect()}
    names = source_names(known, root)
    bare = {source_parts(s, root)[0] for s in changed}
    touched = {s for s in known if source_parts(s, root)[0] in bare}
    if touched:
        upsert(spark, index_path, _records(spark, stats_path, root, touched, {s: names[s] for s in touched}), batch=batch)
    # names that the sources had, or could have had, before one of them went
    before = source_names(known | changed, root)
    stale = {n for s, n in before.items() if source_parts(s, root)[0] in bare} - set(names.values())
    if stale:
        gone = open_index(spark, index_path).filter(F.col("id").isin(sorted(stale))).select("id")
        if not gone.isEmpty():
            remove(spark, index_path, gone, batch=batch)


def start_reindex(spark: SparkSession, lake_root: str, index_path: str, checkpoint: str,
                  available_now: bool = True, processing_time: str | None = None, incremental: bool = True,
                  stats_path: str | None = None, max_files: int = 10_000):
    """Start the stream; returns the ``StreamingQuery``. ``max_files`` bounds the new files of a micro-batch,
    ``stats_path`` (default: beside the index) keeps the statistics of files."""
    from lakesonar.plans.lake_search import build_summaries, index_records
    from lakesonar.operators.index import upsert

    stats_path = stats_path or f"{index_path.rstrip('/')}-file-stats"
    root = lake_root.rstrip("/")
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(max_files))
             .load(lake_root)
             .select("path", F.col("modificationTime").alias("modified_at"))
             .filter(F.col("path").rlike(VALID_FILE_PATTERN)))

    def process(batch: DataFrame, epoch_id: int):
        # at most max_files rows of metadata
        new = [(r["source"], r["file"], r["path"], r["modified_at"]) for r in batch.select(
            lake_source(F.col("path"), root).alias("source"), below_root(F.col("path"), root).alias("file"), "path", "modified_at").collect()]
        if not new:
            return
        by_source: dict[str, list[str]] = {}
        for source, _, path, _ in new:
            by_source.setdefault(source, []).append(path)
        if incremental:
            tabs = [(s, read_files(spark, root, s, paths)) for s, paths in sorted(by_source.items())]
            times = spark.createDataFrame([(s, f, t) for s, f, _, t in new], "source string, file string, modified_at timestamp")
            write_file_stats(file_stats(tabs, own_path(root)).join(times, ["source", "file"]), stats_path, 2 * int(epoch_id))
            _refresh(spark, root, index_path, stats_path, set(by_source), int(epoch_id))
            return
        listed = {r["source"] for r in list_files(spark, root).filter(F.col("path").rlike(VALID_FILE_PATTERN))
                  .select(lake_source(F.col("path"), root).alias("source")).distinct().collect()}  # one row a table
        names = source_names(listed | set(by_source), root)
        bare = {source_parts(s, root)[0] for s in by_source}
        touched = [s for s in names if source_parts(s, root)[0] in bare]
        tabs = {names[s]: read_source(spark, root, s) for s in touched}
        last: dict[str, object] = {}
        for s, _, _, t in new:
            last[names[s]] = max(t, last.get(names[s], t))
        seen = spark.createDataFrame(list(last.items()), "id string, source_modified_at timestamp")
        upsert(spark, index_path, index_records(build_summaries(tabs)).join(seen, "id", "left"), batch=int(epoch_id))

    w = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def drop_missing(spark: SparkSession, lake_root: str, index_path: str, stats_path: str | None = None) -> int:
    """Forget stored files that the lake no longer has and bring their tables' records up to date (a table
    without files leaves the index). Returns the number of tables touched."""
    stats_path = stats_path or f"{index_path.rstrip('/')}-file-stats"
    root = lake_root.rstrip("/")
    there = list_files(spark, root).select(below_root(F.col("path"), root).alias("file"))
    lost = current_file_stats(spark, stats_path).select("source", "file").distinct().join(there, "file", "left_anti")
    lost = lost.checkpoint(eager=True)
    changed = {r["source"] for r in lost.select("source").distinct().collect()}  # one row a table
    if changed:
        batch = next_batch(spark, stats_path)
        forget_files(spark, stats_path, lost, batch + 1 - batch % 2)  # odd: between the stream's batches
        _refresh(spark, root, index_path, stats_path, changed, batch // 2)
    return len(changed)

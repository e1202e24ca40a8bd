"""Operator 4: SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the 64-bit XXH64 hashes (seed 42) of a text's word
shingles. Fingerprints within ``radius`` bits are linked, documents of equal
or linked fingerprints form components.

Covering masks: every bit place i gets a vector m(i) of radius + 1 bits, none of them zero; mask v
(one of the 2**(radius + 1) - 1 nonzero vectors) keeps the places with an odd product of m(i)
and v. For two fingerprints that differ in at most ``radius`` places there is a nonzero
v with an even product for each of them, so the pair agrees on all places v keeps: no link
is ever missed. With radius 4 there are 31 tables with keys of 32 to 34 bits.

Copies collapse first: tables hold distinct fingerprints. Only buckets with two or more go to
tasks; a bucket of over ``block`` fingerprints is cut into chunks by hash and each pair of chunks
is searched by itself, so no group is unbounded and none is skipped. A search walks the links from
a seed through what is left of the bucket and returns one edge per fingerprint reached,
never all pairs. Edges become components by alternating large-star and small-star steps
(joins and aggregations on written tables).

Defined results: no words (null, empty, white space) give fingerprint 0, linked like any other; fewer words
than a shingle are one shingle; a component's id is its smallest ``doc_id``, null if all are null;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import drop_table, fresh, held, partitions, write_table

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    ws = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, ws), np.int64, len(ws))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins[:len(ws) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i:i + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        held("simhash")
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return made(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(radius: int) -> list[int]:
    """Masks over 64 places (signed 64-bit integers)."""
    n = 2 ** (radius + 1) - 1
    vectors = [i % n + 1 for i in range(64)]
    random.Random(SEED).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - 2 ** 64 if m >= 2 ** 63 else m for m in masks]


def bucket_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star for each component of a bucket: (seed, reached)."""
    left, edges = np.unique(fps), []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        reached = [seed]
        while reached and len(left):
            near = np.bitwise_count(left ^ reached.pop()) <= radius
            if near.any():
                found = left[near]
                edges += [(int(seed), y) for y in found.tolist()]
                reached += list(found)
                left = left[~near]
    return edges


def edges_of(fps: DataFrame, radius: int, block: int) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints ``fp``."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                       for t, m in enumerate(masks)])
    # the written table is a few files; each row becomes one for every mask
    spread = fps.repartition(partitions(fps.sparkSession), "fp")
    rows = spread.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.k")
    buckets = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.col("chunks") == 1) | (j != F.col("mine")))
    # a merge join: Spark sizes the rows as if each were still one fingerprint and would broadcast all of them
    grouped = (rows.join(buckets.hint("merge"), ["t", "k"]).withColumn("chunks", chunks).withColumn("mine", mine)
               .withColumn("other", F.explode(others))
               .select("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"))
    keys = ["t", "k", "i", "j"]

    def search(batches):
        held = None  # the last group may go on in the next batch

        def found(cols):
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            out = []
            for a, b in zip([0, *change], [*change, len(cols[4])]):
                out += bucket_edges(cols[4][a:b], radius)
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[4]):
                continue
            last = np.all([c == c[-1] for c in cols[:4]], axis=0)
            cut = int(np.argmax(last))  # the group of the last row starts here
            held = [c[cut:] for c in cols]
            if cut:
                yield found([c[:cut] for c in cols])
        if held is not None:
            yield found(held)

    return (grouped.repartition(partitions(fps.sparkSession), *keys).sortWithinPartitions(*keys)
            .mapInArrow(search, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches."""
    def oriented(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def state(df):
        return df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()

    now = write_table(oriented(edges), "component-edges")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_table(oriented(large), "component-edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = write_table(oriented(small.union(low.select("a", F.col("m").alias("b")))), "component-edges")
        drop_table(large)
        drop_table(now)
        now, before, seen = after, seen, state(after)
        if seen == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = 8192) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of each row of ``docs`` (doc_id, text): ``th``
    hashes the text, ``root`` tells components apart even if ids are null or repeated."""
    rows = write_table(docs.select("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("th"),
                                   fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash-rows")
    fps = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fingerprints")
    edges = write_table(edges_of(fps.select("fp"), radius, block), "simhash-edges")
    roots = components(edges)
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = write_table(named.join(ids, "root").select("fp", "root", "component_id"), "simhash-classes")
    drop_table(edges)
    drop_table(fps)
    return rows.join(classes, "fp").select("doc_id", "th", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest
    ``doc_id`` (nulls last; rows of one id: the smallest text hash; rows alike in
    both: one of them). Whole rows pass through, joined once by id and text hash."""
    found = near_duplicates(docs.select("doc_id", "text"), **params)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select("k.*")
    key, th = fresh(docs, "_key", "_th")
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("th").alias(th)).distinct()
    mine = {key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), th: F.xxhash64("text", F.col("text").isNull())}
    return docs.withColumns(mine).join(kept, [key, th], "left_semi").dropDuplicates([key, th]).select(*docs.columns)

"""Operator 8: removal of repeated word windows behind a count-min prefilter.

A window is ``WINDOW`` consecutive words. Words covered by a window that also starts in
a document with a smaller id are removed; windows are judged on the input.

Pass 1, the sketch. A window's anchor is the smallest hash of the ``GRAM``-word grams inside
it, so equal windows have equal anchors and neighbours mostly share theirs. Every task counts, once
for each document, its anchors in a count-min sketch of two rows of counters that stop at 2 (two bit
planes); the tasks' sketches are merged cell by cell in a shuffle by segments. A window that
occurs in two documents puts its anchor into both counters twice, so the merged estimate never
falls below a window's number of documents: no repeat is lost. The width follows
the bytes of the texts up to ``max_width`` cells, which bounds the broadcast plane to ``max_width / 4``
bytes; a full sketch lets more windows through, never fewer.

Pass 2, exact. Only windows estimated in two documents or more leave the tasks, as runs of
neighbours with one anchor. Equal runs (128-bit digest) are grouped first, so a passage in very many
documents shrinks before the shuffle: in all but the run's smallest document the run is removed whole. What is
left are anchors with several different runs (ends of passages); their windows are grouped
one by one by anchor and window hash (128 bits together) for the smallest document.

Defined results: null and empty texts have no words; texts under ``WINDOW`` words lose nothing; a null
``doc_id`` counts as larger than all others; rows that share an id are never removed for each other; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import partitions, write_table

WINDOW, GRAM = 50, 10
SEGMENT = 1 << 20  # cells of a row that travel together
LAST = 2 ** 63 - 1
RUN = 64  # windows in a run at most


# hashes --------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse powers, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2 ** 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes."""
    up, down = powers(len(h))
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return mixed((s[k:] - s[:-k]) * down[:len(h) - k + 1])


def windows(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(window hashes, anchors) of a text, None if it has no window."""
    ws = text.encode().split() if text else []
    if len(ws) < WINDOW:
        return None
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    grams = sequences(h, GRAM)
    anchors = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).min(axis=1)
    return sequences(h, WINDOW), anchors


def cells(anchors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's cell in each row of the sketch."""
    x = mixed(anchors ^ np.uint64(0x5851F42D4C957F2D))
    return ((x & np.uint64(width - 1)).astype(np.int64),
            ((x >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64))


# sketch --------------------------------------------------------------------

class Counters:
    """One row of counters that stop at 2: planes `once` and `twice` as packed bits."""

    def __init__(self, width: int):
        self.once = np.zeros(width // 8, np.uint8)
        self.twice = np.zeros(width // 8, np.uint8)

    @staticmethod
    def _set(plane, at):
        if len(at):
            byte, first = np.unique(at >> 3, return_index=True)
            plane[byte] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)

    def add(self, at: np.ndarray) -> None:
        at, n = np.unique(at, return_counts=True)
        again = at[(n > 1) | (self.once[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        self._set(self.once, at)
        self._set(self.twice, again)


def sketch_width(total_bytes: int, max_width: int) -> int:
    """Four cells or more for each anchor expected (one in about 128 bytes of text)."""
    width = SEGMENT
    while width < min(max_width, total_bytes // 32):
        width *= 2
    return width


def sketch(texts: DataFrame, width: int) -> np.ndarray:
    """The merged sketch of ``texts`` (text): for each row the plane of counters of 2 or more."""
    step = SEGMENT // 8

    def counted(batches):
        rows, waiting, n = [Counters(width), Counters(width)], [[], []], 0

        def flush():
            for row, w in zip(rows, waiting):
                if w:
                    row.add(np.concatenate(w))
                    w.clear()

        for batch in batches:
            for text in batch.column(0):
                found = windows(text.as_py())
                if found:
                    for w, at in zip(waiting, cells(np.unique(found[1]), width)):
                        w.append(at)
                    n += len(waiting[0][-1])
                    if n > 1_000_000:
                        flush()
                        n = 0
        flush()
        z = zstandard.ZstdCompressor(level=1)
        for r, row in enumerate(rows):
            for i in range(0, width // 8, step):
                if row.once[i:i + step].any():
                    planes = [z.compress(p[i:i + step].tobytes()) for p in (row.once, row.twice)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r * (width // SEGMENT) + i // step], pa.int32()),
                        *[pa.array([p], pa.binary()) for p in planes]], ["segment", "once", "twice"])

    def merged(batches):
        d = zstandard.ZstdDecompressor()
        at, once, twice = None, None, None

        def done():
            packed = zstandard.ZstdCompressor(level=1).compress(twice.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for seg, o, t in zip(*[c.to_pylist() for c in batch.columns]):
                o, t = (np.frombuffer(d.decompress(x), np.uint8) for x in (o, t))
                if seg != at:
                    if at is not None:
                        yield done()
                    at, once, twice = seg, o, t
                else:
                    twice = twice | t | (once & o)
                    once = once | o
        if at is not None:
            yield done()

    parts = (texts.mapInArrow(counted, "segment int, once binary, twice binary")
             .repartition(min(partitions(texts.sparkSession), 2 * width // SEGMENT), "segment")
             .sortWithinPartitions("segment").mapInArrow(merged, "segment int, twice binary"))
    plane = np.zeros(2 * width // 8, np.uint8)
    d = zstandard.ZstdDecompressor()
    for r in parts.toLocalIterator():  # width / 4 bytes in all
        plane[r.segment * step:(r.segment + 1) * step] = np.frombuffer(d.decompress(r.twice), np.uint8)
    return plane.reshape(2, -1)


# exact pass ----------------------------------------------------------------

def candidate_runs(keyed: DataFrame, plane: np.ndarray) -> DataFrame:
    """Runs of windows estimated in two documents or more, from (k1, k2, id, text):
    (d1, d2, anchor, id, k1, k2, start, hashes)."""
    shared = keyed.sparkSession.sparkContext.broadcast(plane)
    width = plane.shape[1] * 8
    schema = "d1 long, d2 long, anchor long, id long, k1 long, k2 long, start int, hashes array<long>"
    types = [pa.int64()] * 6 + [pa.int32(), pa.list_(pa.int64())]
    names = ["d1", "d2", "anchor", "id", "k1", "k2", "start", "hashes"]

    def runs(batches):
        rows = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for k1, k2, id_, text in zip(*batch.columns):
                found = windows(text.as_py())
                if not found:
                    continue
                hashes, anchors = found
                often = np.ones(len(anchors), bool)
                for row, at in zip(shared.value, cells(anchors, width)):
                    often &= (row[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                key = k1.as_py(), k2.as_py(), id_.as_py()
                signed, anchors = hashes.view(np.int64), anchors.view(np.int64)
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchors)]):
                    for i in range(a, b, RUN) if often[a] else ():
                        part = signed[i:min(i + RUN, b)]
                        d = xxhash.xxh3_128_intdigest(part.tobytes(), int(anchors[a]) & (2 ** 63 - 1))
                        d1, d2 = ((x ^ 2 ** 63) - 2 ** 63 for x in (d >> 64, d & (2 ** 64 - 1)))
                        rows.append((d1, d2, int(anchors[a]), key[2], key[0], key[1], i, part))
                if len(rows) >= 4096:
                    yield made()
                    rows.clear()
        if rows:
            yield made()

    return keyed.mapInArrow(runs, schema)


def removed_windows(docs: DataFrame, max_width: int = 1 << 28) -> DataFrame:
    """(k1, k2, spans): for rows of ``docs`` (k1, k2, id, text) the starts of removed windows
    as spans [begin, end), each once however many rows share the key."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plane = sketch(docs.select("text"), sketch_width(int(total), max_width))
    runs = write_table(candidate_runs(docs, plane), "window-runs")
    whole = runs.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.first("anchor").alias("anchor"),
                                         F.first("hashes").alias("hashes"))
    whole = write_table(whole, "window-distinct-runs")
    several = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    single = whole.join(several, "anchor").select("d1", "d2", "anchor", "least", F.posexplode("hashes").alias("off", "h"))
    first = single.groupBy("anchor", "h").agg(F.min("least").alias("first"))
    earlier = (single.join(first, ["anchor", "h"]).filter("first < least")
               .groupBy("d1", "d2").agg(F.collect_set("off").alias("offs")))
    least = whole.select("d1", "d2", "least").join(earlier, ["d1", "d2"], "left")
    start = F.col("start")
    span = F.when(F.col("id") > F.col("least"), F.array(F.array(start, start + F.col("n")))).otherwise(
        F.transform("offs", lambda o: F.array(start + o, start + o + 1)))
    return (runs.select("d1", "d2", "id", "k1", "k2", "start", F.size("hashes").alias("n")).join(least, ["d1", "d2"])
            .withColumn("span", span).filter(F.size("span") > 0)
            .groupBy("k1", "k2").agg(F.flatten(F.collect_set("span")).alias("spans")))  # copies of a row share a key


def kept_words(text: str | None, spans) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by one space)."""
    ws = text.encode().split() if text else []
    if spans is None or not len(spans):
        return len(ws), 0, b" ".join(ws)
    cover = np.zeros(len(ws) + 1, np.int32)
    for a, b in spans:
        cover[a] += 1
        cover[b - 1 + WINDOW] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return len(ws), int(gone.sum()), b" ".join([w for w, g in zip(ws, gone.tolist()) if not g])


def remove_repeats(docs: DataFrame, max_width: int = 1 << 28, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of each row of ``docs`` (doc_id, text)."""
    nulls = [F.col("doc_id").isNull(), F.col("text").isNull()]
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", *nulls).alias("k1"),
                        F.xxhash64("text", "doc_id", *nulls, F.lit(1)).alias("k2"))
    spans = removed_windows(keyed.select("k1", "k2", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text"),
                            max_width)

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    def kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans):
            n, gone, left = kept_words(t, s)
            rows.append((n, gone, hashlib.sha256(left).hexdigest(), *[left.decode()] * with_text))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", kept("text", "spans").alias("r")).select("doc_id", "r.*")

"""Operator 11: MinHash near-duplicates through one-permutation hashing, optimal densification and stars.

A text's set is its distinct word shingles as XXH64 hashes. One pass hashes every shingle
once: the hash range is cut into ``bands * rows`` bins and a bin's value is the least hash in it. An empty bin
takes the value of the first bin that is not empty in its own fixed random order of bins (optimal densification: equal
sets agree, and a bin of two sets agrees about as often as the sets are similar). A band's ``rows`` values make a
bucket key. With 56 bands of 6 rows a pair of similarity 0.8 misses every bucket with probability
(1 - 0.8^6)^56, about 4e-8.

Texts of equal sets collapse first. A bucket gives a star of candidate edges, from its least set to the others, so
there is at most one edge a row. Edges whose sizes cannot reach the similarity go at once, the others are
confirmed on the full sets, made anew from the texts of sets in buckets only; confirmed edges make components.

A star can miss a link between two sets that its center is not linked with. So buckets in which, without the
center, more than one component is left are searched in tasks: each pair of sets of fitting sizes that is not
in one component yet is confirmed on its full sets, and only edges that join components come out. A
bucket of over ``block`` hashes is cut into chunks by set and each pair of chunks searched by itself, so no
group is unbounded, none is skipped, and no link in a bucket is lost.

Defined results: no words (null, empty, white space) give no shingles, linked with nothing; fewer words than a shingle are one
shingle; a component's id is its smallest ``doc_id``, null if all are null; an empty table gives no rows; other
columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import drop_table, id_text, partitions, write_table
from lakesonar.llm.simhash import components

SEED = 42


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    ws = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not ws:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:len(ws) - shingle + 1].tolist()
    hashes = {digest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1:].tolist())}
    out = np.fromiter(hashes, np.uint64, len(hashes))
    out.sort()
    return out


@lru_cache(4)
def orders(bins: int) -> np.ndarray:
    """Each bin's order of bins to take a value from: itself, then all others at random."""
    rng = np.random.default_rng(SEED)
    out = np.argsort(rng.random((bins, bins)), axis=1)
    own = out == np.arange(bins)[:, None]
    return np.concatenate([np.arange(bins)[:, None], out[~own].reshape(bins, bins - 1)], axis=1).astype(np.int16)


@lru_cache(4)
def bin_edges(bins: int) -> np.ndarray:
    return np.array([(i << 64) // bins for i in range(bins)], np.uint64)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Densified least hashes of the bins; ``hashes`` is sorted and not empty."""
    at = np.searchsorted(hashes, bin_edges(bins))
    filled = np.append(at[1:], len(hashes)) > at  # bins ascend with the hashes, so a bin's first hash is its least
    values = hashes[np.minimum(at, len(hashes) - 1)]
    if filled.all():
        return values
    order = orders(bins)
    return values[order[np.arange(bins), filled[order].argmax(axis=1)]]


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = signature(hashes, bands * rows).reshape(bands, rows)
    key = np.zeros(bands, np.uint64)
    for j in range(rows):
        key = (key ^ values[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def slices(batches, rows: int = 512):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def signed_rows(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Written (doc_id, th, n, id, keys): ``n`` shingles, ``id`` a 128-bit hash of the set (null: empty), ``keys``
    the buckets, ``th`` a hash of the text."""
    def signed(batches):
        for b in slices(batches):
            n, ids, keys = [], [], []
            for text in b.column(2).to_pylist():
                hashes = shingle_set(text, shingle)
                n.append(len(hashes))
                ids.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                keys.append(band_keys(hashes, bands, rows) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "n", "id", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return write_table(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        signed, f"doc_id {kind}, th long, n long, id binary, keys array<long>"), "minhash-rows")


def full_sets(docs: DataFrame, rows: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Written (id, hashes) of the sets ``ids``, from one text of each."""
    one = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct(id_text().alias("key"), "th")).alias("of"))
    one = one.select("id", F.col("of.key").alias("key"), F.col("of.th").alias("th"))
    texts = docs.select(id_text().alias("key"), F.xxhash64("text").alias("th"), "text").join(one, ["key", "th"])

    def made(batches):
        for b in slices(batches):
            hashes = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.list_(pa.int64()))], ["id", "hashes"])

    return write_table(texts.select("id", "text").mapInArrow(made, "id binary, hashes array<long>")
                       .dropDuplicates(["id"]), "minhash-sets")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of at least ``percent`` similarity on their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (pairs.join(a, "a").join(b, "b")
            .filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def chunk_edges(mine: list, others: list, percent: int) -> list[tuple[bytes, bytes]]:
    """Edges that join components over the pairs of ``mine`` and ``others``, lists of (id, root, hashes);
    of ``mine`` itself if ``others`` is the same list."""
    same = mine is others
    others = sorted(others, key=lambda s: len(s[2]))
    mine = others if same else sorted(mine, key=lambda s: len(s[2]))
    root = {r: r for _, r, _ in [*mine, *others]}

    def find(r):
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    sizes = np.array([len(s[2]) for s in others])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, places = np.unique(np.concatenate([s[2] for s in others] + ([] if same else [s[2] for s in mine])), return_inverse=True)
    flat, own = places[:starts[-1]], None if same else np.split(places[starts[-1]:], np.cumsum([len(s[2]) for s in mine])[:-1])
    present, edges = np.zeros(int(places.max()) + 1, bool), []
    for i, (a, ra, hashes) in enumerate(mine):
        n = len(hashes)
        low = i + 1 if same else int(np.searchsorted(sizes, -(-percent * n // 100)))
        high = int(np.searchsorted(sizes, 100 * n // percent, side="right"))
        if low >= high or all(find(s[1]) == find(ra) for s in others[low:high]):
            continue
        here = flat[starts[i]:starts[i + 1]] if same else own[i]
        present[here] = True
        shared = np.add.reduceat(present[flat[starts[low]:starts[high]]].astype(np.int64), starts[low:high] - starts[low])
        present[here] = False
        for j in np.flatnonzero(100 * shared >= percent * (n + sizes[low:high] - shared)):
            b, rb, _ = others[low + j]
            if find(ra) != find(rb):
                root[find(rb)] = find(ra)
                edges.append((a, b))
    return edges


def searched(rest: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that join components in buckets; rows of ``rest``: (band, key, id, n, root)."""
    total = rest.groupBy("band", "key").agg(F.ceil(F.sum("n") / block).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    rows = (rest.join(total, ["band", "key"]).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
            .join(sets, "id").select("band", "key", "i", "j", "mine", "id", "root", "hashes"))
    keys = ["band", "key", "i", "j"]

    def search(batches):
        now, held = None, ([], [])

        def found():
            first, second = held
            out = chunk_edges(first, first if now[2] == now[3] else second, percent) if first and (second or now[2] == now[3]) else []
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            names = [c.to_pylist() for c in batch.columns[:7]]
            hashes = batch.column(7)
            for r, (band, key, i, j, mine, id_, root) in enumerate(zip(*names)):
                if now != (band, key, i, j):
                    if now is not None:
                        yield found()
                    now, held = (band, key, i, j), ([], [])
                held[mine != i].append((id_, root, hashes[r].values.to_numpy(zero_copy_only=False).copy()))
        if now is not None:
            yield found()

    return (rows.repartition(partitions(rest.sparkSession), *keys).sortWithinPartitions(*keys)
            .mapInArrow(search, "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 56, rows: int = 6,
                    block: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = signed_rows(docs, shingle, bands, rows)
    distinct = signed.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    placed = distinct.select("id", "n", F.posexplode("keys").alias("band", "key"))
    star = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("center")).filter("sets > 1")
    buckets = write_table(placed.join(star, ["band", "key"]), "minhash-buckets")
    sets = full_sets(docs, signed, buckets.select("id").distinct(), shingle)

    sizes = buckets.select(F.col("id").alias("center"), F.col("n").alias("m")).distinct()
    spokes = buckets.filter("id <> center").select("center", "id", "n").distinct().join(sizes, "center")
    pairs = spokes.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(
        F.col("center").alias("a"), F.col("id").alias("b"))
    found = write_table(links(pairs, sets, percent), "minhash-links")
    roots = write_table(components(found), "minhash-roots")

    rest = (buckets.filter("sets > 2 AND id <> center").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
            .select("band", "key", "id", "n", F.coalesce("root", "id").alias("root")))
    rest = write_table(rest, "minhash-rest")
    mixed = rest.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    more = searched(rest.join(mixed.select("band", "key"), ["band", "key"]), sets, percent, block)
    edges = write_table(more.union(roots.filter("node <> root").select("node", "root")), "minhash-edges")
    final = components(edges)

    named = distinct.select("id", "least").join(final.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "least", F.coalesce("root", "id").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = write_table(named.join(smallest, "root").select("id", "component_id"), "minhash-classes")
    for table in (buckets, sets, found, roots, rest, edges):
        drop_table(table)
    return signed.join(classes, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

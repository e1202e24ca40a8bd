"""Operator 4 against brute force: all pairs of fingerprints, union-find."""
import itertools
import random
import re

import numpy as np
import xxhash

from lakesonar.llm import simhash
from lakesonar.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op4_covering_simhash"](spark, SF).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(4)
    rng = random.Random(3)
    assert len(masks) == 31 and min((m % 2 ** 64).bit_count() for m in masks) >= 32
    for k in (1, 2, 3, 4):
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), k))
            assert any(not diff & m for m in masks)


def test_edges_of_dense_cluster_cut_into_chunks(spark):
    rng = random.Random(5)
    center = rng.getrandbits(62)
    near = {center ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)} | {rng.getrandbits(62) for _ in range(50)}
    # a chain of single steps joins two far points
    chain = [center ^ ((1 << 45) - (1 << (45 - i))) for i in range(15)]
    fps = sorted(near | set(chain))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.edges_of(df, 4, 64)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    arr = np.array(fps)
    want, left = {}, list(fps)
    while left:
        todo, comp = [left[0]], {left[0]}
        while todo:
            x = todo.pop()
            for y in arr[np.bitwise_count(arr ^ x) <= 4].tolist():
                if y not in comp:
                    comp.add(y)
                    todo.append(y)
        left = [f for f in left if f not in comp]
        if len(comp) > 1:
            want |= {f: min(comp) for f in comp}
    assert got == want


def test_rows_for_every_mask_are_not_broadcast(spark):
    """31 rows a fingerprint, which Spark sizes as one, must not pass through the driver."""
    fps = spark.range(5000).selectExpr("xxhash64(id) AS fp")
    plan = simhash.edges_of(fps, 4, 64)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nulls_empty_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c d e"), (3, "A B\tc d e"), (9, None), (8, ""), (None, "x y"), (None, "p q r s t u"), (7, long), (2, long),
            (3, "A B\tc d e"), (4, "a b")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, fp string, _key int")
    got = [tuple(r) for r in simhash.near_duplicates(df).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id, r.text[:3] if r.text else r.text) for r in kept.collect() if r.doc_id is not None)
    assert ids == [(2, "w0 "), (3, "A B"), (4, "a b"), (8, "")]
    assert kept.filter("doc_id is null").count() == 2
    assert simhash.near_duplicates(df.filter("doc_id > 99")).count() == 0

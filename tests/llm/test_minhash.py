"""Operator 11 against all pairs of full sets."""
import itertools
import random
import re

import numpy as np
import pytest

from lakesonar.llm import minhash
from lakesonar.llm.minhash import near_duplicates


def brute_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, percent=80):
    sets = [brute_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def cluster(rng, base, n, edits):
    """Near copies of a text with ``edits`` words replaced: their links do not all go through one center."""
    out = []
    for _ in range(n):
        ws = list(base)
        for at in rng.sample(range(len(ws)), edits):
            ws[at] = f"z{rng.random()}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("block", [2_000_000, 700])
def test_dense_cluster_passages_and_chunks(spark, block):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    texts = [t for e in (2, 3, 4, 5) for t in cluster(rng, base, 25, e)]
    passage = " ".join(rng.choices(words, k=60))
    texts += [f"{passage} {' '.join(rng.choices(words, k=40))}" for _ in range(40)]
    texts += [" ".join(rng.choices(words, k=n)) for n in (1, 2, 3, 4, 5, 6)] * 2
    # a chain: each step close to the last one only
    chain = rng.choices(words, k=200)
    for i in range(0, 100, 4):
        texts.append(" ".join(chain[i:i + 100]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, shingle=3, block=block).collect()
    want = brute(rows, 3)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert 1 < len({w[2] for w in want}) < len(rows)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c d e"), (3, "A B\tc d e"), (9, None), (8, ""), (None, "x y"), (None, "p q r s t u"), (7, long), (2, long + " end"),
            (3, "A B\tc d e"), (4, "a b"), (6, "X  Y"), (1, " \n")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, id string, key int")
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute(rows, 5)
    assert near_duplicates(df.filter("doc_id > 99")).count() == 0
    assert near_duplicates(df.filter("doc_id in (8, 9)")).collect()[0].n_shingles == 0


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(3)
    for n in (4, 20, 300, 3000):
        shared = []
        for _ in range(60):
            x = rng.integers(0, 2 ** 63, int(n * 1.125) + 1, dtype=np.int64).view(np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(x[len(x) - n:])
            shared.append(np.mean(minhash.signature(a, 336) == minhash.signature(b, 336)))
        both = 2 * n - (int(n * 1.125) + 1)
        assert abs(np.mean(shared) - both / (2 * n - both)) < 0.06


def test_chunk_edges_join_components_only():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 40, 100)
    sets = [(bytes([i]), bytes([i]), np.unique(np.concatenate([base[:95], rng.integers(0, 2 ** 40, 5)]))) for i in range(10)]
    assert len(minhash.chunk_edges(sets, sets, 80)) == 9
    assert len(minhash.chunk_edges(sets[:5], sets[5:], 80)) == 9
    joined = [(i, b"r", h) for i, _, h in sets]
    assert minhash.chunk_edges(joined, joined, 80) == []

"""Operator 12 against a plain tree, at several block sizes."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakesonar.llm.manifest import FIELDS, folded, leaf, manifest, proof

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The last node, and each leaf's sibling segments (left, right)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(paths, where):
            run = at - at % 8
            p.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        where = [w // 8 for w in where]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in langs:
        mine = sorted((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in rows if r[2] == g)
        trees.append((mine, *plain_tree([m[2] for m in mine])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (mine, sub, paths), top in zip(trees, tops):
        for m, path in zip(mine, paths):
            out.append((m[3][0], m[2], sub, root, "".join(a + b for a, b in path + top)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", proof(F.col("path"))).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_every_block_size_gives_the_plain_tree(spark, levels):
    rng = random.Random(1)
    rows = [(i, rng.choice(["s", None]), g, i, f"Text {rng.random()}") for g, n in
            [("en", 130), ("fr", 64), ("de", 9), ("es", 1), ("Éa", 8), (None, 65)] + [(f"l{k}", 2) for k in range(70)]
            for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = manifest(df, levels=levels)
    assert result(got) == brute(rows)
    back = got.select((folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).groupBy("ok").count().collect()
    assert [tuple(r) for r in back] == [(True, len(rows))]


def test_nulls_ties_repeats_long_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (3, "s", "en", 1, ""), (3, "s", "en", 1, ""), (3, "s", "en", 1, "B"), (None, "s", "en", 2, "c"),
            (5, "s", "en", 9, "Ä" * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", g string, path int")
    assert result(manifest(df)) == brute(rows)
    assert manifest(df.filter("n_chars > 99")).count() == 0


def test_a_lone_row_is_its_own_root(spark):
    (r,) = manifest(spark.createDataFrame([(1, "s", "en", 1, "a")], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root and r.path == []


def test_tampering_is_found(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, "A" if i % 2 else "a") for i in range(20)], SCHEMA)
    low = leaf([F.lower("text") if f == "text" else F.col(f) for f in FIELDS])
    got = manifest(df, extra={"low": low}).select("doc_id", (folded(F.col("low"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id: r.ok for r in got} == {i: i % 2 == 0 for i in range(20)}

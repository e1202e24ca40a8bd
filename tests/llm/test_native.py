"""Operators 3, 7, 9 and 10: edge cases against plain Python."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesonar.llm import merkle, mixing, reputation, sharding
from lakesonar.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "wort\n" + "lang und länger " * 20_000
ROWS = [(5, "a b c", "s1"), (5, "a b c", "s1"), (7, None, "s2"), (None, "x y", None), (None, "x y", None), (9, "", "s1"),
        (2, LONG, "é"), (3, "a b c", "s2"), (5, "other words here", "s1"), (-4, " \t\n", "s2"), (1, "p\n\nq r\n\n", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    return spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in ROWS], "doc_id long, text string, source string, key string, "
                                 "shard int, size int, _num int, words int")


def md5_unit(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52


# 3 ---

def test_sharding_odd_rows(odd):
    got = sharding.manifest(odd, [1.0, 2.0, 1.0]).collect()

    def shard(d, weights):
        k = "" if d is None else str(d)
        return min(range(len(weights)), key=lambda s: -math.log(md5_unit(f"{k}:{s}")) / weights[s])
    want = Counter()
    for d, t, _ in ROWS:
        b = (t or "").encode()
        want[d, len(b) + 8, zlib.crc32(b), "key", shard(d, [1, 2, 1]), shard(d, [1, 2, 1, 1])] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.manifest(odd.limit(0), [1.0]).count() == 0
    out = sharding.assign_shards(odd, [1.0, 1.0])
    assert "_num" in out.columns and out.count() == len(ROWS)


def test_sharding_law_and_weights(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = sharding.assign_shards(keys, [1.0, 3.0], grown_weight=4.0).collect()
    assert all(r.grown_shard in (r.shard, 2) for r in got)
    assert 0.73 < sum(r.shard == 1 for r in got) / 20_000 < 0.77
    assert 0.48 < sum(r.grown_shard == 2 for r in got) / 20_000 < 0.52


# 10 ---

def test_mix_odd_rows(odd):
    got = mixing.taken_words(mixing.mix(odd, shards=4, block_words=5)).collect()
    size = Counter()
    n_words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ROWS]
    for (_, _, s), n in zip(ROWS, n_words):
        size[s] += n
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n) for r, n in zip(ROWS, n_words))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert abs(sum(r.target for r in {(r.source_size, r.target): r for r in got}.values()) - sum(size.values())) < 1e-6
    for s, total in size.items():  # all but the long source are capped
        if s != "é":
            assert sum(r.taken for r in got if r.source_size == total) % (3 * total) == 0
    assert mixing.mix(odd.limit(0)).count() == 0
    out = mixing.materialize_mix(odd, shards=4, block_words=5)
    assert out.columns == odd.columns
    pieces = [r for r in mixing.mix(odd, shards=4, block_words=5).collect() if r.words and 2 * r.words >= r.size]
    whole = Counter(r.size for r in pieces)  # documents come whole
    assert Counter(n for n in (len((r.text or "").split()) for r in out.collect())) == whole


def test_tree_gives_exact_quotas(spark):
    q = {0: 700, 1: 33, 2: 1, 3: 0}
    df = spark.createDataFrame(list(q.items()), "i long, q long")
    leaves = mixing.splitting_tree(df, 5, "t").collect()
    assert {i: sum(r.q for r in leaves if r.i == i) for i in q} == q
    slots = [sum(r.q for r in leaves if r.shard == s) for s in range(5)]
    assert sum(slots) == 734 and max(slots) - min(slots) <= 1
    shares = [r.q for r in leaves if r.i == 0]
    assert len(set(shares)) > 1 and all(120 < x < 160 for x in shares)  # drawn, not dealt evenly


def test_mix_places_blocks_in_disjoint_shards(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), shards=8, block_words=500).collect()
    taken = [r for r in rows if r.words]
    assert {r.shard for r in taken} == set(range(8)) and all(r.shard is None for r in rows if not r.words)
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7), shards=8, block_words=500).collect()
    assert Counter(rows) == Counter(again)
    per = Counter()
    for r in taken:
        per[r.source] += r.words
    assert all(per[r.source] == math.floor(r.target + 0.5) for r in rows)
    cut = Counter(r.source for r in taken if r.words < r.size)
    assert not cut or max(cut.values()) == 1                      # a target cuts one document of a source
    assert len({r.shard for r in rows if r.source == max(per, key=per.get) and r.words}) > 4


def test_mix_draws_from_the_whole_line(spark):
    """Blocks are drawn all over the repeated line, not from its front; shards and positions order the corpus."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w ', repeat('x ', CAST(id % 7 AS INT))) AS text", "'a' AS source").unionByName(
        spark.range(400).selectExpr("id + 9000", "'w w w'", "'b'").toDF("doc_id", "text", "source"))
    rows = [r for r in mixing.mix(docs, shards=3, block_words=40, seed="s").collect() if r.source == "a"]
    assert {r["pass"] for r in rows if r.words} == {0, 1, 2}
    twice = Counter(r.doc_id for r in rows if r.words)
    assert {0, 1, 2} <= set(twice.values()) | {0} and len(twice) < 4000
    where = {(r.doc_id, r["pass"]): (r.shard, r.position) for r in mixing.mix(docs, shards=3, block_words=40, seed="s").collect()
             if r.words and 2 * r.words >= r.size}
    out = mixing.materialize_mix(docs, shards=3, block_words=40, seed="s").collect()
    best = [min(p for (d, _), p in where.items() if d == r.doc_id) for r in out[:1]]
    assert len(out) == len(where) and best[0][0] == 0


def test_mix_with_one_id_on_many_documents(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE 7 END AS doc_id", "concat('t ', CAST(id AS string)) AS text", "'a' AS source")
    line = mixing.documents_on_line(docs.withColumns(dict(zip(("k1", "k2"), mixing.record_key()))).withColumn("size", mixing.word_count()), "s")
    assert sorted(r.before for r in line.collect()) == [2 * i for i in range(3000)]
    got = mixing.taken_words(mixing.mix(docs)).collect()
    assert len(got) == 3000 and sum(r.taken for r in got) == 6000


# 9 ---

def test_merkle_odd_rows(odd):
    got = merkle.fingerprint_edits(odd.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for r in got:
        if r.n_chars == 0:
            assert r.edited_sha256 == hashlib.sha256(b"").hexdigest() and r.near_edited == 1.0
    for r in got:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert by_text[5, 5] == by_text[3, 5] and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    row2 = next(r for r in got if r.doc_id == 2)  # the next one in descending order is 1
    k = len(LONG) // 3
    assert row2.edited_sha256 == hashlib.sha256((LONG[:len(LONG) - k] + "p\n\nq r\n\n").encode()).hexdigest()
    first = next(r for r in got if r.doc_id == 9)
    assert first.near_next >= 0
    lone = merkle.fingerprint_edits(odd.filter("doc_id = 3").select("doc_id", "text")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert merkle.fingerprint_edits(odd.limit(0)).count() == 0


def plain_fingerprint(text):
    """The tree word by word, without the operator's pattern."""
    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()

    def leaves(paragraph):
        out, leaf = [], []
        words = paragraph.split(" ")
        for i, w in enumerate(words):
            last = i == len(words) - 1
            leaf.append(w if last else w + " ")
            if not last and (w[-1:] in ("d", "r", ".") or len(leaf) == merkle.LEAF_WORDS):
                out.append("".join(leaf))
                leaf = []
        return out + ["".join(leaf)] if "".join(leaf) or not out else out
    sections, hashes = [], []
    for s in text.split("\n\n"):
        ps = [[md5(x) for x in leaves(p)] for p in s.split("\n")]
        hs = [md5("".join(p)) for p in ps]
        hashes.append(md5("".join(hs)))
        sections.append(hashes[-1][:8] + "=" + "|".join(h[:8] + "~" + ",".join(x[:8] for x in p) for h, p in zip(hs, ps)))
    return md5("".join(hashes)) + ":" + ";".join(sections)


def test_merkle_fingerprint_brute(spark, odd):
    texts = [r[1] or "" for r in ROWS] + ["", " ", "a  ", "word " * 40, "x " * 16, "x " * 17, "end. of der\nd\n\n\n", "é\rd f", "und . ",
                                          "y" * 100_000, " " * 50_000] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", merkle.fingerprint(F.col("t")).alias("f"))
    assert [r.f for r in df.collect()] == [plain_fingerprint(t) for t in texts]


def test_merkle_word_put_in(spark):
    text = " ".join(f"w{i * 7919 % 541}{'edrxn'[i % 5]}" for i in range(600))
    df = spark.createDataFrame([(1, text, "new " + text), (2, text, text.replace(" w", " in w", 301).replace(" in w", " w", 300)),
                                (3, "x " * 600, "new " + "x " * 600)], "id int, a string, b string")
    df = df.select("id", *[merkle.fingerprint(F.col(c)).alias(c) for c in "ab"])
    got = {r.id: r for r in df.select("id", merkle.likeness(F.col("a"), F.col("b")).alias("l"),
                                      merkle.first_edit(F.col("a"), F.col("b")).alias("e")).collect()}
    assert 0.9 < got[1].l < 1 and got[1].e == "0/0/0" and 0.9 < got[2].l < 1 and got[2].e.startswith("0/0/")
    sides = [tuple(r) for r in merkle.edits(df.filter("id < 3"), "id", "a", "b").collect()]
    assert len([x for x in sides if x[0] == 1]) == 2 and (1, "a", 0, 0, 0) in sides and (1, "b", 0, 0, 0) in sides
    place = int(got[2].e.rsplit("/", 1)[1])
    assert sorted(x for x in sides if x[0] == 2) == [(2, "a", 0, 0, place), (2, "b", 0, 0, place)]


def test_merkle_edits_locate(spark):
    rows = [(0, "a b\nc d\n\ne f r h i j k l", "a b\nc X\n\ne f r h i j k Y"), (1, "s", "s"), (2, "a b", "a  b"),
            (3, "p\nq\n\nz", "q\np\n\nz"), (4, "p\n\nq", "p\n\nq\n\nnew"), (5, "p\n\np", "p"), (6, "", "\n")]
    df = spark.createDataFrame(rows, "id int, a string, b string").select("id", *[merkle.fingerprint(F.col(c)).alias(c) for c in "ab"])
    got = {i: [] for i in range(7)}
    for r in merkle.edits(df, "id", "a", "b").collect():
        got[r.id].append(tuple(r)[1:])
    assert sorted(got[0]) == [("a", 0, 1, 0), ("a", 1, 0, 1), ("b", 0, 1, 0), ("b", 1, 0, 1)]
    assert got[1] == [] and sorted(got[2]) == [("a", 0, 0, 0), ("b", 0, 0, 0)]
    assert sorted(got[3]) == [("a", 0, None, None), ("b", 0, None, None)]   # the same paragraphs, moved
    assert got[4] == [("b", 2, 0, 0)] and got[5] == []                      # a repeated section has no hash of its own
    assert sorted(got[6]) == [("a", 0, None, None), ("b", 0, None, None)]
    first = {r.id: r.e for r in df.select("id", merkle.first_edit(F.col("a"), F.col("b")).alias("e")).collect()}
    assert first == {0: "0/1/0", 1: None, 2: "0/0/0", 3: "0/0/0", 4: "2", 5: "1", 6: "0/1"}
    assert merkle.edits(df.limit(0), "id", "a", "b").count() == 0


# 7 ---

def test_urls(spark):
    urls = [None, "", "no-scheme.org/x", "http://ORG/", "http://org", "https://a.B.example.org/es/1?x#y", "x://example.org/en/12",
            "http://example.org/en/2", "http://my.com/fr/", "http://my.com/de/q", "http://my.com?x=/fr/", "http://notorg/", "a://b://c/d",
            "http://my.com/fr/", "http://u@h.net:80/p#f"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in reputation.judge(df).collect()}
    want = {0: ("", "", None), 2: ("", "", None), 3: ("org", "/", "org/"), 4: ("org", "", None), 5: ("a.b.example.org", "/es/1", "example.org/es/"),
            6: ("example.org", "/en/12", "example.org/en/1"), 7: ("example.org", "/en/2", "org/"), 8: ("my.com", "/fr/", "com/fr/"),
            9: ("my.com", "/de/q", "com/de/"), 10: ("my.com", "", None), 11: ("notorg", "/", None), 12: ("b:", "//c/d", None),
            14: ("u@h.net:80", "/p", None)}
    assert len(got) == len(urls)
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule) == w
    assert got[6].verdict == "block" and got[7].verdict == "allow" and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert reputation.judge(df.limit(0)).count() == 0
    assert reputation.judge(df.filter("page_id < 3")).count() == 3


def test_reputation_shrinks(spark):
    rows = [("good.a.net", 1)] * 60 + [("bad.b.net", 0)] * 60 + [("one.a.net", None)] + [("one.b.net", None)] + [("few.a.net", 0)]
    df = spark.createDataFrame([(i, f"http://{h}/x", g) for i, (h, g) in enumerate(rows)], "page_id long, url string, good int")
    v = {r.host: r for r in reputation.judge(df, rules=(), outcome="good").collect()}
    assert v["good.a.net"].verdict == "allow" and v["bad.b.net"].verdict == "block"
    assert v["one.a.net"].mean > v["one.b.net"].mean and v["few.a.net"].mean < v["one.a.net"].mean


def test_hosts_under_a_shared_suffix_are_judged_apart(spark):
    rows = [(f"bad{i}.co.uk", 0) for i in range(5) for _ in range(20)] + [("good.co.uk", None)] + [(f"fine{i}.uk", 1) for i in range(8) for _ in range(20)]
    rows += [("www.bad1.co.uk", None), ("x.other.co.uk", 1), ("co.uk", None)] + [("y.other.co.uk", 1)] * 30 + [("z.other.co.uk", None)]
    df = spark.createDataFrame([(i, f"http://{h}/", g) for i, (h, g) in enumerate(rows)], "page_id long, url string, good int")
    v = {r.host: r for r in reputation.judge(df, rules=(), outcome="good").collect()}
    assert v["www.bad1.co.uk"].mean < 0.1 < v["good.co.uk"].mean          # its own domain's outcomes, not all of co.uk as one
    assert v["z.other.co.uk"].mean > 0.8
    one = {r.host: r for r in reputation.judge(df, rules=(), outcome="good", suffixes=()).collect()}
    assert one["www.bad1.co.uk"].mean == one["good.co.uk"].mean           # without the list co.uk is one domain
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("uk",), ("a.b.c",), ("",)], "host string")
    got = [tuple(r) for r in hosts.select("host", *reputation.registered(F.col("host"))).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("uk", "uk", "uk"),
                   ("a.b.c", "b.c", "c"), ("", "", "")]


def test_query_smoke(spark):
    for name in ("op3_rendezvous_sharding", "op7_bayes_url_filter"):
        assert QUERIES[name](spark, SF).count() > 0

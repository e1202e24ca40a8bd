"""Operators 1, 2, 5 and 8: held-out accuracy, brute force, edge cases."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesonar.llm import decontaminate, langid, substrings, toxicity
from lakesonar.llm.queries import QUERIES

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, "123 ½ \n"), (None, "the of and"), (5, "!"), (6, "zzz " * 50_000), (7, "日本語"), (7, "日本語")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "q", 9) for r in EDGE], "doc_id long, text string, lang string, score int")


# 1 ---

def test_langid_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    got = QUERIES["op1_backoff_langid"](spark, SF1).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_backoff_and_edges(spark, edge):
    train = spark.createDataFrame([("the cat sat on the mat the end", "en")] * 3 + [("le chat est sur la table le fin", "fr")] * 3
                                  + [(None, "en"), ("x", None), ("", "fr")], "text string, lang string")
    m = langid.learn(train, least_count=1)
    assert m.predict("the")[0] == "en" and m.predict("catz")[0] == "en" and m.predict("chatz")[0] == "fr"
    got = [r.p for r in edge.orderBy("doc_id").select(langid.predict_column(spark, m, F.col("text")).alias("p")).collect()]
    assert [p["lang"] for p in got][1:4] == ["und", "und", "und"]  # null, empty, digits and a half
    none = langid.learn(train.filter("lang = 'xx'"))
    assert none.predict("the") == ("und", 0.0)
    small = langid.learn(train, model_cells=4, least_count=1)  # the bound holds, letters still decide or the prior
    assert len(small.logp) * 2 <= 4 and small.predict("the")[0] in ("en", "fr")


# 2 ---

def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    got = QUERIES["op2_factorization_toxicity"](spark, SF1).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.9
    clean = [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) / len(clean) < 0.05


def test_machine_learns_a_pair():
    """Neither term is toxic alone; additive weights cannot tell."""
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["fill"] + ["dumb"] * a + ["folk"] * b + [f"w{rng.randrange(500)}" for _ in range(5)]))
        labels.append(int(a and b) if rng.random() < 0.98 else int(rng.random() < 0.5))
    m = toxicity.fit(labels, [toxicity.places(t) for t in texts])
    s = [m.score(t) for t in ("fill dumb folk", "fill dumb", "fill folk", "fill")]
    assert s[0] > 0.8 and max(s[1:]) < 0.3
    dumb, folk = (int(np.flatnonzero(m.kept == toxicity.places(t)[0])[0]) for t in ("dumb", "folk"))
    assert m.v[dumb] @ m.v[folk] > 0.5  # the pair's weight


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(2, 1), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.learn(edge, labels)
    got = edge.select(toxicity.score_column(spark, m, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got)
    assert toxicity.learn(edge, labels.limit(0)).score(None) == 0.5
    assert toxicity.learn(edge.limit(0), labels).score("x") == 0.5


# 5 ---

def brute_hits(text, items, window=10):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, iw in items:
        k = min(window, len(iw))
        grams = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(ws) - k + 1) if grams else ():
            if tuple(ws[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(ws), hit, found


@pytest.mark.parametrize("automaton_words", [10 ** 6, 60])
def test_matches_equal_brute_force(spark, automaton_words):
    rng = random.Random(2)

    def seq(n):
        return " ".join(rng.choice("ab c d".split()) for _ in range(n))
    bench = [(i, seq(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(3, 12)] + [(3, seq(12)), (1, None), (2, " "), (None, "é x Y")]
    bench = [(i, t) for i, t in bench if t is None or len(t.split()) != 1]
    docs = [(i, seq(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, "é X y"), (102, "é x.Y " * 20_000)]
    b = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, doc_id int")
    d = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, spans string, items int")
    got = sorted(((r.doc_id, r.n_words, [list(s) for s in r.spans], list(r.items))
                  for r in decontaminate.match(d, b, automaton_words=automaton_words).collect()), key=str)
    items = [("" if i is None else str(i), brute_hits(t, [])[0] and re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) or []) for i, t in bench]
    want = []
    for i, t in docs:
        n, hit, found = brute_hits(t, items)
        mask = np.array([j in hit for j in range(n)], bool)
        assert i != 102 or (n, mask.all(), found) == (60_000, True, {""})
        want.append((i, n, decontaminate.spans(mask) if n else [], sorted(found)))
    assert got == sorted(want, key=str)
    empty = decontaminate.match(d, b.limit(0))
    assert empty.filter("size(spans) > 0").count() == 0 and empty.count() == len(docs)
    assert decontaminate.match(d.limit(0), b).count() == 0


def test_decontaminate_cuts_and_drops(spark):
    passage = " ".join(f"item{i}" for i in range(12))
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = [(1, "Clean words, here.  Kept as is\n"), (2, "before " * 20 + passage + ". after " * 20), (3, passage), (4, None)]
    d = spark.createDataFrame([(*r, 7, "c") for r in docs], "doc_id long, text string, n_chars int, _clean string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    assert set(got) == {1, 2, 4} and got[1] == d.filter("doc_id = 1").first() and got[4].text is None
    assert "item" not in got[2].text and got[2].text.count("before") == 20 and got[2].n_chars == len(got[2].text)


def test_decontaminate_same_with_many_automata(spark):
    def seq(name, n):
        return [f"{name}{i}" for i in range(n)]
    items = [seq(f"q{j}x", 15) for j in range(10)]
    items += [items[j][7:] + seq(f"o{j}x", 7) for j in range(5)]  # begin with the last 8 words of another
    clean, docs = seq("clean", 60), []
    for j in range(10):
        k = (j + 3) % 10
        docs.append(clean[:10] + items[j] + clean[10:20] + items[k])  # 30 of 50 words: dropped
        docs.append(clean[:40] + items[j][:7] + items[k] + items[j][7:] + clean[40:])  # joined by a cut
    docs += [clean[:40] + items[j] + items[10 + j][8:] + clean[40:] for j in range(5)]  # overlap
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert len(decontaminate.automata(b, 10, 60)) > 3
    one, many = ({r.doc_id: r.text for r in decontaminate.decontaminate(d, b, automaton_words=n).collect()} for n in (10 ** 6, 60))
    assert many == one and set(one) == {*range(1, 20, 2), *range(20, 25)}
    assert all(t.split() == clean for t in one.values())


def test_many_automata_odd_rows(spark):
    rows = [(1, f"p{i} " * 3 + " ".join(f"q{i}w{k}" for k in range(14))) for i in range(12)]
    b = spark.createDataFrame(rows + [(None, None), (2, " ")], "item_id long, text string")
    odd = [(1, None), (1, None), (None, ""), (2, "clean " * 30), (2, "clean " * 30), (3, "Clean, kept.\n" + rows[4][1] + "\n" + "more text here " * 9),
           (4, rows[5][1]), (None, rows[6][1] + " tail " * 40)]
    d = spark.createDataFrame([(i, t, 5, "r", "c", "f") for i, t in odd], "doc_id long, text string, n_chars int, _row string, _clean string, _found string")
    one, many = (sorted(map(str, decontaminate.decontaminate(d, b, automaton_words=n).collect())) for n in (10 ** 6, 40))
    assert many == one and len(one) == 7
    assert len(decontaminate.automata(b, 10, 40)) > decontaminate.BATCH
    assert decontaminate.decontaminate(d.limit(0), b, automaton_words=40).count() == 0


def test_repeated_items_make_no_more_automata(spark):
    items = [(1, " ".join(f"a{i}" for i in range(20))), (2, " ".join(f"b{i}" for i in range(20)))]
    b = spark.createDataFrame(items + items[:1] * 50, "item_id long, text string")
    d = spark.createDataFrame([(1, "x " + items[0][1]), (2, items[1][1] + " y")], "doc_id long, text string")
    assert len(decontaminate.automata(b, 10, 40)) == 1
    got = sorted((r.doc_id, list(r.spans[0]), r["items"]) for r in decontaminate.match(d, b, automaton_words=40).collect())
    assert got == [(1, [1, 21], ["1"]), (2, [0, 20], ["2"])]


# 8 ---

def brute_repeats(rows):
    words = [(d if d is not None else 2 ** 63, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - 49):
            k = tuple(w[i:i + 50])
            least[k] = min(least.get(k, d), d)
    out = []
    for (d, w), (doc_id, _) in zip(words, rows):
        gone = set()
        for i in range(len(w) - 49):
            if least[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("full", [False, True])
def test_repeats_equal_brute_force(spark, full, monkeypatch):
    rng = random.Random(4)

    def seq(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, other = seq(70), seq(130)
    rows = []
    for i in range(40):
        w = seq(rng.choice([3, 49, 50, 90, 300]))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            a = rng.randrange(15)
            w[at:at] = passage[a:a + rng.randrange(45, 60)]
        if i % 4 == 0:
            w += other[:rng.randrange(50, 131)]
        rows.append((100 - i, " ".join(w)))
    rows += [(50, None), (51, ""), (200, rows[3][1]), (200, rows[3][1]), (None, rows[3][1]), (None, rows[3][1]), (4, "a " * 3000),
             (300, "a\t" * 70), (1, "é\n" * 55), (2, "é\v" * 55)]
    if full:  # a sketch so small that it lets everything through
        monkeypatch.setattr(substrings, "sketch_width", lambda *a: substrings.SEGMENT)
        monkeypatch.setattr(substrings, "cells", lambda a, w: (np.zeros(len(a), np.int64),) * 2)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k1 int, hashes string")
    got = sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=str)
    assert got == brute_repeats(rows)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_spans_do_not_grow_with_copies(spark):
    text = " ".join(f"w{i}" for i in range(200))

    def sizes(copies):
        rows = [(1, 0, 1, text)] + [(2, 0, 2, text)] * copies
        df = spark.createDataFrame(rows, "k1 long, k2 long, id long, text string")
        return [(r.k1, sorted(map(tuple, r.spans))) for r in substrings.removed_windows(df).collect()]
    assert sizes(40) == sizes(1) and len(sizes(1)) == 1


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2 ** 63, 5000).astype(np.uint64) for _ in range(3)]
    parts[1][:500] = parts[0][:500]
    merged = []
    for p in parts:
        c = substrings.Counters(1 << 16)
        for half in (p[:2500], p[2500:]):
            c.add(substrings.cells(half, 1 << 16)[0])
        merged.append(c)
    once, twice = merged[0].once, merged[0].twice
    for c in merged[1:]:
        twice = twice | c.twice | (once & c.once)
        once = once | c.once
    true = np.bincount(np.concatenate([substrings.cells(p, 1 << 16)[0] for p in parts]), minlength=1 << 16)
    assert (np.unpackbits(once, bitorder="little") == (true >= 1)).all()
    assert (np.unpackbits(twice, bitorder="little") == (true >= 2)).all()

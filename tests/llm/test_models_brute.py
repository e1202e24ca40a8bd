"""Operators 1 and 2 against plain Python versions, every row of the small tables."""
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from lakesonar.llm import toxicity
from lakesonar.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# 1 ---

def split(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def parts(word, n):
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] or [marked]


def test_langid_equals_plain_backoff(spark):
    """Counts, smoothing, back-off and softmax by hand; the small table stays within all bounds but the least count."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [(t, g) for d, t, g in docs if crc(d) % 4 != 2 and t is not None and g is not None]
    langs = sorted({g for _, g in train})
    counts = [defaultdict(Counter) for _ in range(5)]  # by length, 0: whole words
    sums = [Counter() for _ in range(5)]
    for t, g in train:
        for w in split(t):
            for n in range(5):
                for x in [w] if n == 0 else parts(w, n):
                    counts[n][x][g] += 1
                    sums[n][g] += 1
    kept = [{x: c for x, c in counts[n].items() if sum(c.values()) >= 2} for n in range(5)]
    assert sum(map(len, kept)) * len(langs) <= 2_000_000
    logp = [{x: [math.log((c[g] + 0.5) / (sums[n][g] + 0.5 * len(kept[n]))) for g in langs] for x, c in kept[n].items()} for n in range(5)]
    per = Counter(g for _, g in train)
    prior = [math.log(per[g] / len(train)) for g in langs]

    def evidence(w):
        if w in logp[0]:
            return logp[0][w]
        for n in (4, 3, 2, 1):
            known = [logp[n][x] for x in parts(w, n) if x in logp[n]]
            if known:
                return [sum(k) / len(known) for k in zip(*known)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in QUERIES["op1_backoff_langid"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t, _ in docs:
        ws = split(t or "")
        if not any(c.isalpha() for w in ws for c in w):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        z = [p + s for p, s in zip(prior, map(sum, zip(*map(evidence, ws))))]
        best = max(z)
        first, second = sorted(z, reverse=True)[:2]
        score = 1 / sum(math.exp((x - best) / math.sqrt(len(ws))) for x in z)
        assert got[d].held_out == (crc(d) % 4 == 2) and abs(got[d].score - score) < 1e-3
        if first - second > 1e-2 * max(1, len(ws) ** 0.5):  # single precision in the operator
            assert got[d].lang_pred == langs[z.index(best)]


# 2 ---

def plain_score(m, terms):
    """w0 + sum of weights + sum over pairs of dot products."""
    row = {int(k): i for i, k in enumerate(m.kept)}
    on = sorted({row[p] for p in {zlib.crc32(t.encode()) % 2 ** 22 for t in terms} if p in row})
    z = m.w0 + sum(m.w[i] for i in on)
    z += sum(float(np.dot(m.v[a], m.v[b])) for x, a in enumerate(on) for b in on[x + 1:])
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def test_toxicity_equals_pairwise_sum(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    machine = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert len(machine.kept)
    got = {r.doc_id: r for r in QUERIES["op2_factorization_toxicity"](spark, SF).collect()}
    for d, t in docs:
        want = plain_score(machine, set(re.findall(r"[^\W_]+", (t or "").lower())))
        assert abs(got[d].score - want) < 1e-9 and got[d].predicted == int(want >= 0.5) and got[d].held_out == (crc(d) % 5 == 0)


def test_fit_follows_the_gradient(monkeypatch):
    """One step of the fit against the loss's numeric derivative, whole and in pieces of a few nonzeros."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype(np.int32) for _ in range(60)]
    y = [int(rng.random() < 0.4) for _ in rows]
    fits = []
    for chunk in (1 << 18, 7):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        fits.append(toxicity.fit(y, rows, epochs=30, least_ratio=0.0, least_rows=1))
    a, b = fits
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()

    weight = np.array([min(4.0, max(1.0, (len(y) - sum(y)) / sum(y))) if t else 1.0 for t in y])
    weight /= weight.sum()

    def loss(m):
        s = [math.log(p / (1 - p)) for p in (plain_on(m, r) for r in rows)]
        data = sum(w * (math.log1p(math.exp(-abs(z))) + max(z, 0) - t * z) for w, z, t in zip(weight, s, y))
        return data + 1e-3 / 2 * (m.w ** 2).sum() / len(m.kept) + 1e-2 / 2 * (m.v ** 2).sum() / len(m.kept)

    def plain_on(m, r):
        on = [i for i, k in enumerate(m.kept) if k in set(r.tolist())]
        z = m.w0 + sum(m.w[i] for i in on) + sum(float(np.dot(m.v[p], m.v[q])) for x, p in enumerate(on) for q in on[x + 1:])
        return 1 / (1 + math.exp(-z))

    losses = [loss(toxicity.fit(y, rows, epochs=n, rate=0.02, least_ratio=0.0, least_rows=1)) for n in (1, 10, 60, 200)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.6 * losses[0]

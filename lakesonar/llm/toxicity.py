"""Operator 2: toxicity with a factorization machine over hashed terms.

A text's features are its distinct terms (lower-cased runs of letters and digits)
hashed to ``2**BITS`` places. The machine scores

    w0 + sum w_j + 1/2 (|sum v_j|^2 - sum |v_j|^2),

so besides a weight per term it learns a factor per term, whose products weigh pairs of terms:
two terms that are harmless alone can be toxic together and the other way round.

Learning: a sample of at most ``max_docs`` (expected) labelled rows, drawn by a hash of
the id, is hashed in the tasks; one task fits the machine on it (full-batch Adam on the
logistic loss with L2 penalties, from a fixed seed). Only places whose presence goes with the
label (likelihood ratio of at least ``least_ratio``) get weights, at most ``max_features``;
that and ``max_docs`` bound the model, the fitting task and what is broadcast.

Defined results: empty and null texts score as no terms; without labelled rows or with one class
the score is the smoothed share of toxic rows; a repeated label counts as toxic if any is; rows
with a null label or id are not learned from. Scoring is map-only.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import held

BITS = 22
CHUNK = 1 << 18  # nonzeros whose factors the fit holds at a time
_TERM = re.compile(r"[^\W_]+")


def places(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text."""
    terms = set(_TERM.findall(text.lower())) if text else set()
    memo = held("toxicity", dict)
    if len(memo) > 300_000:
        memo.clear()
    for t in terms:
        if t not in memo:
            memo[t] = zlib.crc32(t.encode()) & (2 ** BITS - 1)
    return np.unique(np.fromiter(map(memo.__getitem__, terms), np.int32, len(terms)))


class Machine:
    """A fitted factorization machine; ``slot`` maps a hashed place to its row, -1: none."""

    def __init__(self, w0: float, kept: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.w0, self.kept, self.w, self.v = w0, kept, w, v
        self.slot = None

    def score(self, text: str | None) -> float:
        if self.slot is None:
            self.slot = np.full(2 ** BITS, -1, np.int32)
            self.slot[self.kept] = np.arange(len(self.kept))
        j = self.slot[places(text)]
        j = j[j >= 0]
        v = self.v[j]
        s = self.w0 + self.w[j].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(s, -50, 50))))


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G-squared of presence against label, for each place."""
    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    n, df = n_pos + n_neg, pos + neg
    g = sum(part(o, row * col / n) for o, row, col in (
        (pos, df, n_pos), (neg, df, n_neg), (n_pos - pos, n - df, n_pos), (n_neg - neg, n - df, n_neg)))
    return 2 * g


def fit(labels: list[int], rows: list[np.ndarray], factors: int = 8, epochs: int = 100, rate: float = 0.1,
        l2: float = 1e-3, l2_pairs: float = 1e-2, least_ratio: float = 9.0, least_rows: int = 2, max_features: int = 8192) -> Machine:
    y = np.array(labels, float)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    prior = np.log((n_pos + 0.5) / (n_neg + 0.5))
    empty = Machine(float(prior), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
    if not n_pos or not n_neg:
        return empty
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lengths.sum() else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(y)), lengths)
    seen, at = np.unique(flat, return_inverse=True)
    pos = np.bincount(at[y[row] == 1], minlength=len(seen)).astype(float)
    neg = np.bincount(at[y[row] == 0], minlength=len(seen)).astype(float)
    del at
    ratio = likelihood_ratio(pos, neg, n_pos, n_neg)
    good = np.flatnonzero((ratio >= least_ratio) & (pos + neg >= least_rows))
    kept = np.sort(seen[good[np.lexsort((good, -ratio[good]))][:max_features]]).astype(np.int32)
    if not len(kept):
        return empty
    slot = np.full(2 ** BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    j, on = slot[flat], slot[flat] >= 0
    j, row = j[on], row[on].astype(np.int32)
    del flat, on
    order = np.argsort(j, kind="stable")  # nonzeros by feature, for the gradients
    starts = np.searchsorted(j[order], np.arange(len(kept)))
    rng = np.random.default_rng(7)
    p = {"w0": np.array([prior]), "w": np.zeros(len(kept)), "v": rng.normal(0, 0.01, (len(kept), factors))}
    m = {k: np.zeros_like(x) for k, x in p.items()}
    u = {k: np.zeros_like(x) for k, x in p.items()}
    weight = np.where(y == 1, min(4.0, max(1.0, n_neg / n_pos)), 1.0)
    weight /= weight.sum()

    filled, first = np.unique(row, return_index=True)  # nonzeros stand by row

    def pieces(bounds):  # runs of whole segments, each of about CHUNK nonzeros, so that no array of all of them by factor is made
        ends = np.append(bounds[1:], len(j))
        at = 0
        while at < len(bounds):
            to = max(at + 1, int(np.searchsorted(ends, bounds[at] + CHUNK, side="right")))
            yield slice(at, to), slice(int(bounds[at]), int(ends[to - 1])), bounds[at:to] - bounds[at]
            at = to

    by_row, by_feature = list(pieces(first)), list(pieces(starts))
    row_of, j_of = row[order], j[order]
    s, sq = np.zeros((len(y), factors)), np.zeros(len(y))
    z = np.zeros(len(y))
    for t in range(1, epochs + 1):
        for seg, of, cuts in by_row:
            v = p["v"][j[of]]
            s[filled[seg]] = np.add.reduceat(v, cuts)
            sq[filled[seg]] = np.add.reduceat((v ** 2).sum(axis=1), cuts)
            z[filled[seg]] = np.add.reduceat(p["w"][j[of]], cuts)
        score = p["w0"][0] + z + 0.5 * ((s ** 2).sum(axis=1) - sq)
        g = weight * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y)
        grad = {"w0": np.array([g.sum()]), "w": l2 * p["w"] / len(kept), "v": l2_pairs * p["v"] / len(kept)}
        for seg, of, cuts in by_feature:
            each = g[row_of[of]]
            grad["w"][seg] += np.add.reduceat(each, cuts)
            grad["v"][seg] += np.add.reduceat(each[:, None] * (s[row_of[of]] - p["v"][j_of[of]]), cuts)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            u[k] = 0.999 * u[k] + 0.001 * grad[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(u[k] / (1 - 0.999 ** t)) + 1e-8)
    return Machine(float(p["w0"][0]), kept, p["w"], p["v"])


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, **params) -> Machine:
    """Fit on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    share = min(1.0, max_docs / max(1, marked.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003.0 < share
    sample = marked.filter(drawn).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    # at most max_docs rows (expected) of 12 bytes
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    @F.pandas_udf("array<int>")
    def hashed(col: pd.Series) -> pd.Series:
        return col.map(places)

    def fitted(batches):
        ids, y, rows = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
            x = b.column(2)
            rows += [np.asarray(x[i].values) for i in range(len(x))]
        order = sorted(range(len(y)), key=lambda i: (ids[i], rows[i].tobytes()))  # as tasks deliver in any order
        model = fit([y[i] for i in order], [rows[i] for i in order], **params)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    row = (texts.select("doc_id", "y", hashed(F.col("text")).alias("x")).repartition(1)
           .mapInArrow(fitted, "model binary").first())
    return pickle.loads(row[0]) if row else fit([], [], **params)


def score_column(spark, machine: Machine, text: Column) -> Column:
    """The probability of label 1 for each text."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype=float)
    return scored(text)

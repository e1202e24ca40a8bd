"""Operator 1: language identification, word first with n-gram backoff.

A known word scores its log frequency in every language. An unseen word falls back
to its character n-grams (with word boundaries) of length ``MAX_GRAM``; if none of
them is known, to the next shorter ones, down to single letters. A document's
evidence is the sum over its words; its score is the softmax of that sum over
the root of the number of words, so that long texts do not all score 1.

Learning counts words and n-grams per language in the tasks and sums them up in a
shuffle. The labelled rows are a sample bounded by ``max_docs_per_lang`` (rows
are drawn by a hash of their text, so a language expects at most that many). Entries are
kept from the most frequent down as long as their number times the number of
languages stays within ``model_cells``, which bounds what is broadcast.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if
nothing could be learned; letters that no entry knows leave the prior (the most
frequent language, ties: the first by code point). Rows with a null text or language teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import drop_table, write_table

UND = "und"
MAX_GRAM = 4
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] or [marked]


def has_letter(ws: list[str]) -> bool:
    return any(c.isalpha() for w in ws for c in w)


def _count(batches):
    """(lang, n, gram, c) from batches of (lang, text); n = 0 marks whole words.
    Counts are handed on whenever they reach 200,000 words."""
    names = ["lang", "n", "gram", "c"]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def rows(counts):
        out = Counter()
        for lang, ws in counts.items():
            for w, c in ws.items():
                out[lang, 0, w] += c
                for n in range(1, MAX_GRAM + 1):
                    for g in grams(w, n):
                        out[lang, n, g] += c
        keys = list(out)
        for i in range(0, len(keys), 50_000):
            part = keys[i:i + 50_000]
            cols = [*zip(*part), [out[k] for k in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > 200_000:
                yield from rows(counts)
                counts = {}
    yield from rows(counts)


class Model:
    """Log probabilities of words and n-grams, one row each, one column a language."""

    def __init__(self, langs: list[str], prior: np.ndarray, index: list[dict[str, int]], logp: np.ndarray):
        self.langs, self.prior, self.index, self.logp = langs, prior, index, logp
        self._memo: dict[str, int] = {}
        self._extra: np.ndarray | None = None

    def __getstate__(self):
        return {"langs": self.langs, "prior": self.prior, "index": self.index, "logp": self.logp,
                "_memo": {}, "_extra": None}

    def backoff(self, word: str) -> np.ndarray:
        for n in range(MAX_GRAM, 0, -1):
            known = [r for r in map(self.index[n].get, grams(word, n)) if r is not None]
            if known:
                return self.logp[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def rows(self, ws: list[str]) -> np.ndarray:
        """Evidence of each word; unseen words are remembered, at most 100,000."""
        if self._extra is None or len(self._memo) + len(ws) > len(self._extra):
            self._memo = {}
            self._extra = np.zeros((max(100_000, len(ws)), len(self.langs)), np.float32)
        get, memo, base = self.index[0].get, self._memo, len(self.logp)
        ids = [get(w, -1) for w in ws]
        for i, r in enumerate(ids):
            if r < 0:
                w = ws[i]
                at = memo.get(w)
                if at is None:
                    at = memo[w] = len(memo)
                    self._extra[at] = self.backoff(w)
                ids[i] = base + at
        ids = np.array(ids, np.int64)
        old = ids < base
        out = np.empty((len(ids), len(self.langs)), np.float32)
        out[old] = self.logp[ids[old]]
        out[~old] = self._extra[ids[~old] - base]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        ws = words(text) if text else []
        if not self.langs or not has_letter(ws):
            return UND, 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(ws), 50_000):  # bounded memory on very long texts
            total += self.rows(ws[i:i + 50_000]).sum(axis=0, dtype=np.float64)
        z = self.prior + total
        best = int(z.argmax())
        z = (z - z[best]) / np.sqrt(len(ws))
        return self.langs[best], float(1 / np.exp(z).sum())


def learn(labelled: DataFrame, lang: str = "lang", max_docs_per_lang: int = 10_000,
          model_cells: int = 2_000_000, least_count: int = 2) -> Model:
    """Fit on rows with text and ``lang``; the model is bounded by ``model_cells``."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col(lang).isNotNull())
    docs = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row per language
    langs = sorted(docs)
    if not langs:
        return Model([], np.zeros(0), [{} for _ in range(MAX_GRAM + 1)], np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs_per_lang / docs[k]))])
    drawn = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0 < share[F.col(lang)]
    counts = write_table(
        rows.filter(drawn).select(F.col(lang).alias("lang"), "text")
        .mapInArrow(_count, "lang string, n int, gram string, c long")
        .groupBy("n", "gram", "lang").agg(F.sum("c").alias("c")), "langid-counts")
    # one entry per gram, in the order of the languages
    per_lang = [F.sum(F.when(F.col("lang") == k, F.col("c")).otherwise(0)) for k in langs]
    entries = counts.groupBy("n", "gram").agg(F.sum("c").alias("total"), F.array(*per_lang).alias("cs"))
    level = F.floor(F.log2("total") * 8).cast("int")
    sizes = {r["level"]: r["count"] for r in entries.filter(F.col("total") >= least_count)
             .groupBy(level.alias("level")).count().collect()}  # at most 8 * 64 rows
    room, floor = max(1, model_cells // len(langs)), None
    for lv in sorted(sizes, reverse=True):
        room -= sizes[lv]
        if room < 0:
            break
        floor = lv
    sums = {r[0]: np.array(r[1], float) for r in entries.groupBy("n").agg(F.array(*[F.sum(F.col("cs")[i]) for i in range(len(langs))])).collect()}
    kept = entries.filter((F.col("total") >= least_count) & (level >= (floor if floor is not None else 10 ** 6)))
    t = kept.select("n", "gram", "cs").toArrow()
    drop_table(counts)
    index: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
    ns = t.column("n").to_numpy() if t.num_rows else np.zeros(0, int)
    cs = (np.array(t.column("cs").to_pylist(), np.float64).reshape(-1, len(langs)) if t.num_rows
          else np.zeros((0, len(langs))))
    logp = np.zeros((len(ns), len(langs)), np.float32)
    for n in range(MAX_GRAM + 1):
        of = ns == n
        if of.any():
            logp[of] = np.log((cs[of] + 0.5) / (sums[n] + 0.5 * of.sum()))
    for i, (n, g) in enumerate(zip(ns.tolist(), t.column("gram").to_pylist())):
        index[n][g] = i
    prior = np.log(np.array([docs[k] for k in langs], float) / sum(docs.values()))
    return Model(langs, prior, index, logp)


def predict_column(spark, model: Model, text: Column) -> Column:
    """struct(lang, score) of each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang", "score"])
    return predicted(text)

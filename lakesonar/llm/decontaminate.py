"""Operator 5: benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words (A-Z lower-cased; letters, digits and every
character from U+0080 on) and all items go into one suffix automaton over word
ids. Documents are streamed through it: the state after each word stands for
the longest suffix of the text read so far that occurs in an item, and its
length is tracked. Where it reaches ``window`` words, the last ``window`` words
are a passage of an item; an item with fewer words is matched whole, through
the marked states on the suffix links. States know the items they occur in.

The items are a stated query set. They are dealt by hash into automata of about
``automaton_words`` words each, which tasks build and write as one binary row each to the shared
folder. A pass over the documents takes ``BATCH`` automata, the most that a driver, a broadcast or a worker
holds; a larger benchmark takes more passes, whose spans are written and merged by row. Documents
are read whole in every pass and never shuffled with one pass.
Cleaning judges coverage and cuts on the union of all automata's hits, round after round
until nothing is hit; with several passes only texts that were cut enter the next round.

Defined results: null and empty texts have no words and no hits; items without
words match nothing; rows of one item id count as one item, a null id as the
empty string; an empty benchmark leaves all documents clean. Other columns pass through.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import fresh, held, write_table

BATCH = 2  # automata in one pass

# Bytes that are not part of a word; A-Z are lower-cased.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
               else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPARK_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids, cut at ``window`` words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        coded = []
        for item_id, ws in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            if seq:
                coded.append((item_id, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self.items: list[set | None] = [None] * len(self.next)  # of the window that ends in the state
        self.short: list[list | None] = [None] * len(self.next)  # (words, item) of short items
        for item_id, seq in coded:
            s = length = 0
            for c in seq:
                s, length = self.step(s, length, c)
                if length >= window:
                    self.items[s] = (self.items[s] or set()) | {item_id}
            if len(seq) < window:
                self.short[s] = (self.short[s] or []) + [(len(seq), item_id)]
        self.up = [-1] * len(self.next)  # the nearest state up the links with short items
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            p = self.link[s]
            self.up[s] = p if self.short[p] else self.up[p]
        self.least = min([min(len(q), window) for _, q in coded], default=0)

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:  # the items before have this string
            return q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        new = self._state(self.len[p] + 1, {}, 0)
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def step(self, s: int, length: int, c: int) -> tuple[int, int]:
        """State and matching length after one more word; the state is the one
        that holds the last ``window`` words once the length reaches them."""
        while s and c not in self.next[s]:
            s = self.link[s]
            length = self.len[s]
        if c in self.next[s]:
            s = self.next[s][c]
            length += 1
        while s and self.len[self.link[s]] >= self.window:
            s = self.link[s]
            length = self.len[s]
        return s, length

    def match(self, ws: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words are hit (None: none), and the items with a window here."""
        if len(ws) < self.least or not self.least:
            return None, set()
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in ws], np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        runs = ends - begins >= self.least  # only unbroken runs of known words can match
        hit, found = None, set()
        for a, b in zip(begins[runs].tolist(), ends[runs].tolist()):
            s = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                s, length = self.step(s, length, c)
                if length >= self.window:
                    hit = np.zeros(len(ws), bool) if hit is None else hit
                    hit[i - self.window:i] = True
                    found |= self.items[s]
                t = s if self.short[s] else self.up[s]
                while t > 0:
                    for m, item in self.short[t]:
                        if m <= length:
                            hit = np.zeros(len(ws), bool) if hit is None else hit
                            hit[i - m:i] = True
                            found.add(item)
                    t = self.up[t]
        return hit, found


def spans(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
    return edges.reshape(-1, 2).tolist()


class Automata:
    """Automata as binary rows (part, automaton) of a written table."""

    def __init__(self, rows: DataFrame, parts: int):
        self.rows, self.parts = rows, parts

    def __len__(self) -> int:
        return self.parts

    def batches(self) -> Iterator:
        """A broadcast of ``BATCH`` automata at most for each pass."""
        for first in range(0, self.parts, BATCH):
            rows = self.rows.filter(F.col("part").between(first, first + BATCH - 1)).orderBy("part").collect()
            yield self.rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r.automaton for r in rows]))


def automata(bench: DataFrame, window: int, automaton_words: int) -> Automata:
    """Automata over about ``automaton_words`` words of items each, built in tasks; a repeated row counts once."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(SPARK_WORD)))).first()[0] or 0
    parts = max(1, -(-int(total) // automaton_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        built = Automaton(sorted((i, words(t)) for i, t in zip(rows["item_id"], rows["text"])), window)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "automaton": [pickle.dumps(built)]})
    rows = items.select(part.alias("part"), "item_id", "text").groupBy("part").applyInPandas(build, "part int, automaton binary")
    return Automata(write_table(rows, "automata"), parts)


def loaded(shared) -> list[Automaton]:
    """A broadcast batch in a worker, unpacked once; another batch takes its place."""
    name, packed = shared.value
    return held(f"automata {name}", lambda: [pickle.loads(p) for p in packed])


def match_all(models: list[Automaton], ws: list[bytes]) -> tuple[np.ndarray | None, set]:
    """:meth:`Automaton.match` by several automata together."""
    hit, found = None, set()
    for model in models:
        one, items = model.match(ws)
        hit = one if hit is None else hit if one is None else hit | one
        found |= items
    return hit, found


def match_column(text: Column, shared) -> Column:
    """struct(n_words, spans, items): word spans [begin, end) that are hit, and the items found."""
    @F.pandas_udf("n_words long, spans array<array<int>>, items array<string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ws = words(t)
            hit, items = match_all(loaded(shared), ws)
            rows.append((len(ws), [] if hit is None else spans(hit), sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])
    return found(text)


def merged(all_spans: Column) -> Column:
    """An array of span arrays as one sorted array of spans that do not touch."""
    start = F.array().cast("array<array<int>>")
    return F.aggregate(F.array_sort(F.flatten(all_spans)), start, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= s[0]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                 F.array(F.array(F.element_at(acc, -1)[0],
                                 F.greatest(F.element_at(acc, -1)[1], s[1]))))).otherwise(F.array_append(acc, s)))


def match(docs: DataFrame, bench: DataFrame, window: int = 10, automaton_words: int = 200_000,
          key: str = "doc_id") -> DataFrame:
    """(key, n_words, spans, items) for each row of ``docs``: merged spans of hit
    words and the sorted ids of the items they come from."""
    models = automata(bench, window, automaton_words)
    if len(models) <= BATCH:
        return docs.select(key, match_column(F.col("text"), next(models.batches())).alias("m")).select(key, "m.*")
    row, tie = fresh(docs.select(key), "_row", "_tie")
    same = F.xxhash64("text", F.col("text").isNull())  # rows alike in key and text have like spans
    passes = None
    for shared in models.batches():
        one = docs.select(key, same.alias(tie), match_column(F.col("text"), shared).alias("m")).select(key, tie, "m.*")
        one = write_table(one.withColumn(row, F.lit(1 if passes is None else 0)), "automaton-spans")
        shared.destroy()
        passes = one if passes is None else passes.union(one)
    return (passes.groupBy(key, tie).agg(
        F.sum(row).alias(row), F.first("n_words").alias("n_words"),
        merged(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(row))))
        .select(key, "n_words", "spans", "items"))


def cut_text(text: str, cut: list, n_words: int, min_span: int, max_coverage: float) -> tuple[str | None, bool]:
    """The text without the spans of ``min_span`` words or more (None: there is none), and
    whether they cover more than ``max_coverage`` of its words."""
    cut = [s for s in cut if s[1] - s[0] >= min_span]
    if not cut or sum(b - a for a, b in cut) > max_coverage * n_words:
        return None, bool(cut)
    at = [m.span() for m in _WORD.finditer(text)]
    kept, pos = [], 0
    for a, b in cut:
        kept.append(text[pos:at[a][0]].rstrip())
        pos = at[b - 1][1]
    return "\n".join([*kept, text[pos:].lstrip()]).strip(), False


def clean_text(text: str, models: list[Automaton], min_span: int, max_coverage: float) -> tuple[str | None, bool]:
    """:func:`cut_text` with the hits of all ``models`` together. What a removal joins is
    matched again until nothing is hit."""
    out = None
    while True:
        ws = words(text)
        hit, _ = match_all(models, ws)
        left, dropped = (None, False) if hit is None else cut_text(text, spans(hit), len(ws), min_span, max_coverage)
        if left is None:
            return (None, True) if dropped else (out, False)
        out = text = left


def clean_column(text: Column, shared, min_span: int, max_coverage: float) -> Column:
    """struct(text, dropped) as :func:`clean_text` says, over a broadcast batch."""
    @F.pandas_udf("text string, dropped boolean")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean_text(t, loaded(shared), min_span, max_coverage) if t else (None, False)
                             for t in texts], columns=["text", "dropped"])
    return cleaned(text)


def cut_column(text: Column, found: Column, min_span: int, max_coverage: float) -> Column:
    """struct(text, dropped) as :func:`cut_text` says, over merged spans (null: none)."""
    @F.pandas_udf("text string, dropped boolean")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, False) if s is None else cut_text(t, [x.tolist() for x in s], len(words(t)), min_span, max_coverage)
                             for t, s in zip(texts, found)], columns=["text", "dropped"])
    return cut(text, found)


def with_text(docs: DataFrame, new: Column) -> DataFrame:
    """``docs`` with the text ``new`` where it is not null; ``n_chars``, if there, follows."""
    out = {"text": F.coalesce(new, F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(new.isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(out)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, min_span: int = 1,
                  max_coverage: float = 0.5, automaton_words: int = 200_000) -> DataFrame:
    """``docs`` without benchmark passages: spans of at least ``min_span`` hit words are
    removed from texts (a line feed stands for each), documents with more than
    ``max_coverage`` of their words hit are dropped, all others come back as they
    are. ``n_chars``, if there, follows the text. Map-only with up to ``BATCH`` automata; their
    number does not change the result."""
    models = automata(bench, window, automaton_words)
    m, row, found = fresh(docs, "_clean", "_row", "_found")
    if len(models) <= BATCH:
        out = docs.withColumn(m, clean_column(F.col("text"), next(models.batches()), min_span, max_coverage))
        return with_text(out.filter(~F.col(f"{m}.dropped")), F.col(f"{m}.text")).select(*docs.columns)
    live = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "clean-rows")
    done = None
    while True:
        passes = None
        for shared in models.batches():
            one = live.select(row, match_column(F.col("text"), shared)["spans"].alias(found)).filter(F.size(found) > 0)
            one = write_table(one, "clean-spans")
            shared.destroy()
            passes = one if passes is None else passes.union(one)
        hits = passes.groupBy(row).agg(merged(F.collect_list(found)).alias(found))
        judged = live.join(hits, row, "left").withColumn(m, cut_column(F.col("text"), F.col(found), min_span, max_coverage))
        judged = write_table(judged.filter(~F.col(f"{m}.dropped")).drop(found), "clean-round")
        clean = judged.filter(F.col(f"{m}.text").isNull()).select(*docs.columns)
        done = clean if done is None else done.union(clean)
        live = with_text(judged.filter(F.col(f"{m}.text").isNotNull()), F.col(f"{m}.text")).select(*docs.columns, row)
        if live.isEmpty():
            return done

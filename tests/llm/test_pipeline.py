"""The pipeline: stage by stage against brute force on what the stage before kept."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lakesonar.llm import decontaminate, simhash, toxicity
from lakesonar.llm.mixing import WEIGHTS
from lakesonar.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in cp.STAGES:
        docs = cp.write_table(f(spark, docs, SF), name)
        out[name] = docs
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxicity_stage(spark, stages):
    machine = toxicity.learn(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet").filter(cp.remainder(5) != 0))
    want = [r for r in rows(stages["documents"]) if machine.score(r[1]) < 0.5]
    assert sorted(rows(stages["toxicity"])) == sorted(want) and 0 < len(want) < stages["documents"].count()


def test_near_duplicate_stage(stages):
    left = {r[0]: simhash.fingerprint(r[1]) for r in rows(stages["toxicity"])}
    kept = {r[0] for r in rows(stages["near_duplicates"])}
    todo, want = sorted(left), set()
    while todo:
        want.add(todo[0])
        group, front = {todo[0]}, [todo[0]]
        while front:
            x = front.pop()
            for y in todo:
                if y not in group and ((left[x] ^ left[y]) & (2 ** 64 - 1)).bit_count() <= 4:
                    group.add(y)
                    front.append(y)
        todo = [d for d in todo if d not in group]
    assert kept == want


def test_decontamination_stage(spark, stages):
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + min(10, len(w))]) for w in items if w for i in range(max(1, len(w) - 9))}
    lengths = {len(g) for g in grams}

    def hits(text):
        ws = decontaminate.words(text)
        return {j for k in lengths for i in range(len(ws) - k + 1) if tuple(ws[i:i + k]) in grams for j in range(i, i + k)}
    before = {r[0]: r for r in rows(stages["near_duplicates"])}
    after = {r[0]: r for r in rows(stages["decontamination"])}
    for d, r in before.items():
        h, n = hits(r[1]), len(decontaminate.words(r[1]))
        if not h:
            assert after[d] == r
        elif len(h) > 0.5 * n:
            assert d not in after
        else:
            assert not hits(after[d][1]) and after[d][4] == len(after[d][1])
            gone = Counter(decontaminate.words(r[1])) - Counter(decontaminate.words(after[d][1]))
            assert sum(gone.values()) >= len(h)
    assert set(after) <= set(before)


def test_mixing_stage(stages):
    docs = [(r[3], r[0], r[1], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows(stages["decontamination"])]
    size = Counter()
    for s, _, _, n in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(size.values())
    while free:  # reshare the excess until none is above
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level >= 3 * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 3 * size[s]
            rest -= 3 * size[s]
            free.discard(s)
    got, copies = Counter(), Counter()
    for r in rows(stages["mixing"]):
        got[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        copies[r[0]] += 1
        assert r[4] == len(r[1])
    longest = Counter()
    for s, _, _, n in docs:
        longest[s] = max(longest[s], n)
    for s in order:  # documents come whole: one of a source comes or not by the half of it
        assert abs(got[s] - target[s]) <= longest[s] / 2 + 0.51
    texts = {r[1] for r in rows(stages["decontamination"])}
    assert all(r[1] in texts for r in rows(stages["mixing"]))
    assert max(copies.values()) <= 3


def test_token_stage(stages):
    from tokenizers import Tokenizer
    tok, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    mixed = stages["mixing"].select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    for doc_id, text, _ in sorted(mixed, key=lambda r: (r[0], r[2])):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows(stages["tokens"])) == sorted(want)


def test_run_equals_stages(spark, stages):
    assert sorted(rows(cp.run(spark, SF))) == sorted(rows(stages["tokens"]))


def test_nulls_and_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score int"
    df = spark.createDataFrame([(1, None, None, None, None, 1), (None, "a b c", "x", None, 5, 2), (2, "", "x", "s", 0, 3),
                                (3, "d e f g", None, "s", 7, 4), (3, "d e f g", None, "s", 7, 4)], schema)
    for docs in (df, df.limit(0)):
        n = docs.count()
        for name, f in cp.STAGES:
            docs = cp.write_table(f(spark, docs, SF), name)
            if name != "tokens":
                assert docs.columns == df.columns
        assert docs.count() >= (2 if n else 0)
        assert n or docs.count() == 0


def test_token_stage_takes_the_small_memo(monkeypatch):
    """The stage's workers hold the memory of earlier stages too: its memo is smaller than operator 6's own."""
    import corpus_pipeline
    from lakesonar.llm import tokens
    got = {}
    monkeypatch.setattr(corpus_pipeline, "ship_package", lambda spark: None)
    monkeypatch.setattr(corpus_pipeline, "encode_to_files", lambda docs, path, **k: got.update(k))
    corpus_pipeline.tokens(None, None, "")
    assert got["memo"] <= tokens.MEMO // 4

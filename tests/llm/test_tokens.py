"""Operator 6: exact round trips against whole-text encoding by the library."""
import zlib

import numpy as np
import pytest

from lakesonar.llm import tokens
from lakesonar.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def brute(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op6_bitplane_tokens"](spark, SF).collect())
    assert got == sorted(brute(docs))


def test_encoder_equals_library_on_odd_texts():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\tb c", "it's we'll x", " a b",
             "a b  c", "a <|endoftext|> b", "<|endoftext|>\nx", "\x1c a", "日本 語\nテスト", "1 2 3!\n?", "a\x85b c", " a\tb",
             "a. b.. c?! .d ... e'. f'll. ½. ². é, 日本. x;:\ny!", "<|endoftext|>. a.<|endoftext|>"]
    e = tokens.Encoder(tokenizer_path(), memo=3)  # the memo turns over
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 2 ** 32, 1000, dtype=np.uint32)
    block = tokens.pack_block(ids, planes, 3)
    assert (tokens.unpack_block(memoryview(block), 0) == ids).all()


def test_nulls_repeats_long_and_empty(spark):
    rows = [(3, "b c"), (None, "x"), (1, None), (1, None), (2, ""), (7, "long word " * 40000), (3, "b c")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, start string, n_tokens int")
    got = sorted((tuple(r) for r in tokens.encode_to_files(df, tokenizer_path(), block_ids=1000, planes="bit").collect()),
                 key=lambda r: r[1])
    assert got == brute(rows)
    none = tokens.encode_to_files(df.filter("doc_id > 99"), tokenizer_path())
    assert none.collect() == [] and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

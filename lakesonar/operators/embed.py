"""Embedding (V1-V4).

V4, the offline default, is the hashing trick over character 3-grams of each
word ``#word#`` (Weinberger et al. 2009), L2-normalised. Every quantity is
per text and a text row lives in one task, so the whole step is map-only:
no exchange, and no document text is ever shuffled. The term counts come
from one Arrow batch UDF (SQL has no in-row scatter-add); the norm, the unit
vector and the sparse (bucket, tf, weight) form are built-in expressions.

V1/V2 (a user's model) run through ``embed_with`` on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hashed embedding dimension, token split and gram length.
# The token split is applied to the lower-cased text; the byte table of
# ``_tables`` implements it (every byte outside [a-z0-9] separates tokens).
HASH_DIM = 256
TOKEN_SPLIT = "[^a-z0-9]+"
GRAM = 3
MODEL_ID = f"hash3gram-{HASH_DIM}"
# The characters a gram can hold (the pad, then token characters).
GRAM_ALPHABET = "#0123456789abcdefghijklmnopqrstuvwxyz"
# Text bytes counted in one vectorised step inside a task (it takes about 40 times as many).
CHUNK_BYTES = 1 << 20

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(byte -> symbol code, gram code -> bucket), built from the rule once per
    Python worker. Symbol codes follow ``GRAM_ALPHABET``; every byte that is
    not a token character (``#`` included) is a separator, code 0 like the
    pad. The bucket of a gram is the first 32 bits of its md5 modulo the
    dimension; 37^3 = 50,653 grams."""
    if not _TABLES:
        sym = np.zeros(256, dtype=np.uint8)
        for i, ch in enumerate(GRAM_ALPHABET[1:], start=1):
            sym[ord(ch)] = i
        a = GRAM_ALPHABET
        buckets = np.fromiter(
            (int(hashlib.md5((x + y + z).encode()).hexdigest()[:8], 16) % HASH_DIM
             for x in a for y in a for z in a), dtype=np.int64, count=len(a) ** GRAM)
        _TABLES["sym"], _TABLES["bucket"] = sym, buckets
    return _TABLES["sym"], _TABLES["bucket"]


def _count_chunk(texts: list, sym: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """(len(texts), HASH_DIM) gram counts. Each text becomes ``#text#`` with
    separators coded 0; the grams of ``#word#`` are exactly the windows whose
    middle byte is a token character, and such a window never crosses two
    texts because each text is padded on both sides."""
    n = len(GRAM_ALPHABET)
    parts = [b"#" + t + b"#" for t in texts]
    ends = np.cumsum(np.fromiter((len(x) for x in parts), dtype=np.int64, count=len(parts)))
    codes = sym[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    mid = np.flatnonzero(codes[1:-1]) + 1
    grams = (codes[mid - 1].astype(np.int32) * (n * n) + codes[mid].astype(np.int32) * n
             + codes[mid + 1])
    rows = np.searchsorted(ends, mid, side="right")
    return np.bincount(rows * HASH_DIM + bucket[grams],
                       minlength=len(parts) * HASH_DIM).reshape(len(parts), HASH_DIM)


def term_counts(texts: pd.Series) -> pd.DataFrame:
    """(tf, norm) per text: dense gram-bucket counts and their L2 norm; both
    NULL for a text without any token (it gets no vector)."""
    sym, bucket = _tables()
    tf: list = [None] * len(texts)
    norm: list = [None] * len(texts)
    chunk, idx, size = [], [], 0

    def count():
        counts = _count_chunk(chunk, sym, bucket)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts).astype(np.float64))
        for r, c, nv in zip(idx, counts, norms):
            if nv > 0:
                tf[r], norm[r] = c, float(nv)

    for r, t in enumerate(texts):      # a chunk's encoded texts are held at a time, not the batch's
        if t is None:
            continue
        e = t.lower().encode("utf-8")
        if chunk and size + len(e) > CHUNK_BYTES:
            count()
            chunk, idx, size = [], [], 0
        chunk.append(e)
        idx.append(r)
        size += len(e)
    if chunk:
        count()
    return pd.DataFrame({"tf": tf, "norm": norm})


@F.pandas_udf(T.StructType([T.StructField("tf", T.ArrayType(T.LongType())),
                            T.StructField("norm", T.DoubleType())]))
def _term_counts_udf(texts: pd.Series) -> pd.DataFrame:
    return term_counts(texts)


def _term_vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, v struct<tf, norm>) per text with at least one token; map-only."""
    from lakesonar.session import ship_package
    ship_package(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return (texts.select("id", _term_counts_udf(F.col("t")).alias("v"))
            .filter(F.col("v.norm").isNotNull()))


def hashed_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, tf, weight): sparse V4 vector per row, L2-normalised weights."""
    tv = _term_vectors(df, id_col, text_col)
    return (tv.select("id", F.posexplode("v.tf").alias("bucket", "tf"), F.col("v.norm").alias("norm"))
            .filter(F.col("tf") > 0)
            .select("id", "bucket", "tf", (F.col("tf") / F.col("norm")).alias("weight")))


def hashed_embedding(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, embedding array<double>) with ``HASH_DIM`` entries, unit length.

    Rows whose text has no token get no vector.
    """
    tv = _term_vectors(df, id_col, text_col)
    return tv.select("id", F.transform("v.tf", lambda x: x / F.col("v.norm")).alias("embedding"))


# Texts sent to an embedding model in one call.
EMBED_BATCH = 64


def embed_with(df: DataFrame, text_col: str, embed_fn: Callable[[list[str]], list],
               out_col: str = "embedding", factory: bool = False) -> DataFrame:
    """V1/V2: ``embed_fn(list[str]) -> list[vector]`` on at most ``EMBED_BATCH`` texts a call; with
    ``factory=True`` the model is built once per task. Errors propagate (V2)."""
    from lakesonar.session import ship_package
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        fn = embed_fn() if factory else embed_fn
        for pdf in batches:
            texts = pdf[text_col].tolist()
            vecs = [v for i in range(0, len(texts), EMBED_BATCH) for v in fn(texts[i:i + EMBED_BATCH])]
            pdf = pdf.copy()
            pdf[out_col] = pd.Series([np.asarray(v, dtype=np.float32) for v in vecs], dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)

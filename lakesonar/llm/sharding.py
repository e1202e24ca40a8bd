"""Operator 3: weighted rendezvous hashing of record keys into shards.

Every shard s draws a number u(key, s) in (0, 1) from an md5 of key and shard
and scores ``-ln(u) / weight``; the smallest score takes the record. A record's
scores for the old shards do not change when a shard is added, so the new shard
takes records only into itself, about ``w_new / sum(w)`` of all. Placement is a
column expression: no shuffle, no state, no Python.

Defined results: a null key is placed as the empty string; records with the same
key share a shard; a null text has size 8 and CRC 0; an empty table gives no
rows; an input column with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import id_text, text_or_empty, unit_hash, with_rank

RECORD_OVERHEAD = 8  # bytes a record takes besides its text


def scores(key: Column, weights: Sequence[float]) -> Column:
    """The array of a key's scores, one for each shard."""
    return F.array(*[-F.log(unit_hash(F.concat(key, F.lit(f":{s}")))) / F.lit(float(w))
                     for s, w in enumerate(weights)])


def winner(score: Column, shards: int) -> Column:
    """The shard with the smallest of the first ``shards`` scores (ties: the first)."""
    first = F.slice(score, 1, shards)
    return (F.array_position(first, F.array_min(first)) - 1).cast("int")


def assign_shards(records: DataFrame, weights: Sequence[float], key: str = "doc_id",
                  grown_weight: float = 1.0, shard: str = "shard",
                  grown: str = "grown_shard") -> DataFrame:
    """Records with ``shard`` under ``weights`` and ``grown_shard`` under
    ``weights`` and one more shard of ``grown_weight``. Whole rows pass through."""
    kept = records.select(*[c for c in records.columns if c not in (shard, grown)])
    from lakesonar.llm.common import fresh
    (s,) = fresh(kept, "_scores")
    return (kept.withColumn(s, scores(id_text(key), [*weights, grown_weight]))
            .withColumns({shard: winner(F.col(s), len(weights)),
                          grown: winner(F.col(s), len(weights) + 1)})
            .drop(s))


def manifest(docs: DataFrame, weights: Sequence[float], key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The shard manifest: key, size, CRC-32 of the text, law, shard, slot (the
    record's place in its shard, by key) and the shard under one more shard.
    Texts are read once and never shuffled; slots are ranked on narrow rows."""
    narrow = assign_shards(docs.select(key, text), weights, key).select(
        key, (F.octet_length(text_or_empty(text)).cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "grown_shard")
    ranked = with_rank(narrow, [key, "text_crc32", "size"], ["shard"], "slot")
    return ranked.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

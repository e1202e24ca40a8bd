"""Operator 10: mixing sources to target weights with a multivariate
hypergeometric splitting tree.

1. Targets. Sources in code-point order (null last) carry cyclic weights and
   share the total size; none may take more than ``max_repeat`` times its size.
   The excess is reshared by weight until none is above: that fixed point is
   ``min(cap, weight * level)`` with the level at which the targets sum to the
   total, found in closed form from running sums over the sources sorted by
   cap/weight.
2. Line. Each source's documents are put in a hashed order on a line of words
   that is passed ``max_repeat`` times. Positions come from prefix sums over ranges
   of the hash: no source, however hot, is sorted or summed in one task.
3. Blocks. The line is cut into blocks of whole documents: a block holds the documents that
   start in its words. A hash permutes a source's blocks; blocks are drawn in that order until their words
   reach the target, so a source's quota of blocks is exact and its words are the target; the last block is
   taken as far as the target goes.
4. Tree. A binary tree over the output shards splits the vector of per-source
   quotas: at a node each block of the urn goes left with probability
   (left slots open) / (blocks left), which
   draws the left child's counts from the multivariate hypergeometric
   distribution exactly, in integers. Leaves hold every shard's exact quota.
5. Draw. A source's drawn blocks in permuted order are dealt to the shards by their leaf
   quotas (disjoint), and rows get a hashed position in their shard. A document is in the mix if, and as
   often as, a block that holds it was dealt.

Only the tree sees one row per node (counts of at most ``max_blocks`` blocks); rows are
narrow and joined on (source, block).

Defined results: a null text has 0 words and is never taken; a source without
words has target 0; an empty table gives no rows; repeated rows are pieces of
their own; ``doc_id`` may be null. The draws depend on the seed, ids, sources
and sizes only, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesonar.llm.common import fresh, id_text, partitions, text_or_empty, unit_hash, write_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row per source."""
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    one = Window.partitionBy(F.lit(0))  # one row per source, not per document
    ranked = per.withColumn("_r", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("_r") % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_repeat
    capped = ranked.withColumns({"_w": w, "_cap": cap}).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = one.orderBy("_ratio", "_r")
    level = ((F.sum("source_size").over(one).cast("double")
              - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    return (capped.withColumn("_level", level).withColumn("_top", F.max("_level").over(one))
            .select("source", "source_size",
                    F.least(F.col("_cap"), F.col("_w") * F.col("_top")).alias("target")))


def record_key() -> tuple[Column, Column]:
    """128 bits that tell rows apart by id, source and text (nulls too)."""
    cols = ["doc_id", "source", "text"]
    return (F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols]),
            F.xxhash64(F.lit("mix"), *[F.col(c) for c in reversed(cols)], *[F.col(c).isNull() for c in cols]))


def documents_on_line(docs: DataFrame, seed: str) -> DataFrame:
    """Rows (source, doc_id, size, k1, k2, copies, before): ``before`` is the number
    of words in front of the document on its source's line; repeated rows are
    one row with ``copies``, counted before the shuffle. The line follows the id's hash; documents that share an
    id (or have none) are told apart by their other columns, so the ranges that are summed have no hot key."""
    spark = docs.sparkSession
    items = write_table(docs.groupBy("source", "doc_id", "size", "k1", "k2")
                        .agg(F.count(F.lit(1)).alias("copies")), "mix-items")
    order = ["_u", "doc_id", "size", "k1"]
    keyed = items.withColumn("_u", unit_hash(F.concat(F.lit(f"{seed}:line:"), id_text())))
    ranged = write_table(keyed.repartitionByRange(partitions(spark), *order).withColumn("_b", F.spark_partition_id()), "mix-ranges")
    words = F.col("size") * F.col("copies")
    sums = ranged.groupBy("source", "_b").agg(F.sum(words).alias("_sum"))
    start = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_b2"), F.coalesce(
        F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")
                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy("source", "_b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (ranged.join(start, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2")))
            .withColumn("before", F.col("_start") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
            .select("source", "doc_id", "size", "k1", "k2", "copies", "before"))


def split_quotas(quotas: Column, left_slots: Column, node: Column, seed: str) -> Column:
    """Left child's quotas: an urn draw without replacement over all blocks of
    ``quotas`` (array of (i, q)); see the module text, step 3."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x["q"])

    def one_source(acc, x):
        def one_block(urn, j):
            u = unit_hash(F.concat_ws(":", F.lit(seed), node, x["i"].cast("string"), j.cast("string")))
            goes = (u * urn["n"] < urn["m"]).cast("long")
            return F.struct((urn["m"] - goes).alias("m"), (urn["n"] - 1).alias("n"),
                            (urn["x"] + goes).alias("x"))
        urn = F.aggregate(F.when(x["q"] > 0, F.sequence(F.lit(1).cast("long"), x["q"]))
                          .otherwise(F.array().cast("array<long>")),
                          F.struct(acc["m"].alias("m"), acc["n"].alias("n"), F.lit(0).cast("long").alias("x")),
                          one_block)
        # the urn is folded once, into a one-element array
        return F.element_at(F.transform(F.array(urn), lambda d: F.struct(
            d["m"].alias("m"), d["n"].alias("n"),
            F.array_append(acc["left"], F.struct(x["i"].alias("i"), d["x"].alias("q"))).alias("left"))), 1)

    start = F.struct(left_slots.cast("long").alias("m"), total.alias("n"),
                     F.array().cast("array<struct<i:long,q:long>>").alias("left"))
    return F.aggregate(quotas, start, one_source, lambda acc: acc["left"])


def splitting_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(i, shard, q): every shard's exact quota of source ``i``, from rows (i, q)."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("qs")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"),
        F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"]).alias("n"), "qs")

    def slots(a, b):  # block slots of shards a..b-1
        return F.floor(F.col("n") * b / F.lit(shards)) - F.floor(F.col("n") * a / F.lit(shards))

    for _ in range(max(0, math.ceil(math.log2(shards)))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))
        left = split_quotas(F.col("qs"), slots(F.col("lo"), mid), node, seed)
        open_ = F.col("hi") - F.col("lo") > 1
        drawn = nodes.withColumn("mid", mid).withColumn(
            "left", F.when(open_, left).otherwise(F.col("qs")))
        right = F.zip_with("qs", "left", lambda a, b: F.struct(a["i"].alias("i"), (a["q"] - b["q"]).alias("q")))
        children = F.when(open_, F.array(
            F.struct("lo", F.col("mid").alias("hi"), "n", F.col("left").alias("qs")),
            F.struct(F.col("mid").alias("lo"), "hi", "n", right.alias("qs")))).otherwise(
            F.array(F.struct("lo", "hi", "n", "qs")))
        nodes = drawn.select(F.inline(children))
    return nodes.select(F.col("lo").alias("shard"), F.inline("qs")).select("i", "shard", "q")


def mix(docs: DataFrame, shards: int = 16, weights: Sequence[float] = WEIGHTS, max_repeat: int = 3,
        block_words: int = 16_384, least_blocks: int = 64, max_blocks: int = 65_536, seed: str = "mix") -> DataFrame:
    """The mix as narrow rows, one for each document (copy) and pass over its source:
    (source, doc_id, k1, k2, size, source_size, target, copy, pass, words, shard,
    position); k1 and k2 are the :func:`record_key`.

    ``words`` of the document are taken in that pass (the whole size or none, but for one document of a
    source). A pass whose block was not drawn has ``words`` 0 and no shard. Blocks hold about ``block_words`` words: fewer in
    a source that would have under ``least_blocks`` of them, more if the total would make over ``max_blocks``."""
    k1, k2 = record_key()
    sizes = docs.select("source", "doc_id", word_count().alias("size"), k1.alias("k1"), k2.alias("k2"))
    line = write_table(documents_on_line(sizes, seed), "mix-line")
    per = source_targets(line.select("source", (F.col("size") * F.col("copies")).alias("size")),
                         weights, max_repeat)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    one = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    whole = F.col("source_size") * max_repeat
    per = write_table(per.withColumns({
        "i": (F.row_number().over(one) - 1).cast("long"),
        "quota": F.floor(F.col("target") + 0.5).cast("long"),
        "bw": F.greatest(F.lit(1), F.least(F.greatest(F.lit(block_words), F.ceil(total * max_repeat / F.lit(max_blocks))),
                                           F.ceil(whole / F.lit(least_blocks)))).cast("long")}), "mix-sources")

    p = per.select(F.col("source").alias("_s"), "source_size", "target", "i", "quota", "bw")
    passes = F.sequence(F.lit(0), F.lit(max_repeat - 1))
    pieces = (line.join(p, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
              .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
              .withColumn("pass", F.explode(passes))
              .withColumn("at", F.col("before") + (F.col("copy") - 1) * F.col("size") + F.col("pass") * F.col("source_size"))
              .withColumn("block", F.floor(F.col("at") / F.col("bw")).cast("long")))

    blocks = (pieces.filter("size > 0").groupBy("i", "block")
              .agg(F.sum("size").alias("n"), F.min("at").alias("first"), F.first("quota").alias("quota")))
    hashed = unit_hash(F.concat_ws(":", F.lit(f"{seed}:block"), F.col("i").cast("string"), F.col("block").cast("string")))
    order = Window.partitionBy("i").orderBy(hashed, "block")  # a source's blocks: at most max_blocks, not its documents
    permuted = blocks.withColumns({
        "_rank": (F.row_number().over(order) - 1).cast("long"),
        "taken_before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    drawn = write_table(permuted.filter("taken_before < quota").select("i", "block", "first", "_rank", "taken_before"), "mix-blocks")

    leaves = splitting_tree(drawn.groupBy("i").agg(F.count(F.lit(1)).alias("q")), shards, seed)
    dealt = leaves.withColumn("_to", F.sum("q").over(Window.partitionBy("i").orderBy("shard")))
    draws = dealt.filter("q > 0").select("i", "shard", F.explode(
        F.sequence(F.col("_to") - F.col("q"), F.col("_to") - 1)).alias("_rank"))
    placed = drawn.join(draws, ["i", "_rank"]).select("i", "block", "shard", "first", "taken_before")

    # what the target leaves for the piece in its block; nothing without a shard
    room = F.col("quota") - F.col("taken_before") - (F.col("at") - F.col("first"))
    words = F.when(F.col("shard").isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room))).otherwise(0)
    place = unit_hash(F.concat_ws(":", F.lit(f"{seed}:row"), id_text(), F.col("copy").cast("string"),
                                  F.col("pass").cast("string")))
    return (pieces.join(placed, ["i", "block"], "left").withColumn("words", words)
            .select("source", "doc_id", "k1", "k2", "size", "source_size", "target", "copy", "pass", "words",
                    F.when(F.col("words") > 0, F.col("shard")).alias("shard"),
                    F.when(F.col("words") > 0, place).alias("position")))


def taken_words(mixed: DataFrame) -> DataFrame:
    """Per document (copy): the words the mix takes, summed over its passes."""
    return (mixed.groupBy("k1", "k2", "copy")
            .agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"),
                 F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                 F.sum("words").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def materialize_mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, by shard and in the order of the shards' positions: a document comes
    whole, as often as it is taken. The one document of a source that its target cuts comes if at least half of
    it is taken. ``docs`` is read twice; texts are shuffled to their takes and to their shards."""
    k1, k2, shard, position = fresh(docs, "_k1", "_k2", "_shard", "_position")
    takes = mix(docs.select("doc_id", "source", "text"), **params).filter("words > 0 AND 2 * words >= size").select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("shard").alias(shard), F.col("position").alias(position))
    keyed = docs.withColumns(dict(zip((k1, k2), record_key())))
    # repeated rows are one row here, and their takes bring them back
    rows = keyed.dropDuplicates([k1, k2]).join(takes, [k1, k2])
    n = partitions(docs.sparkSession)
    return rows.repartitionByRange(n, shard, position).sortWithinPartitions(shard, position).select(*docs.columns)

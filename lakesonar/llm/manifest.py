"""Operator 12: a Merkle manifest of a dataset in concatenated-level strings.

Rows are leaves; the leaves of a group stand in key order, and every ``RUN`` consecutive nodes of a level (the
last run: fewer, even one) become their hash until one is left, the group's subroot.
The subroots, in group order, likewise give the root.

A group's leaves are cut into aligned blocks of ``RUN ** levels`` nodes. A block keeps
each of its levels as one string of 64 hex digits a node (as bytes, so that a
substring is an offset): parents are hashes of its fixed-width substrings, and the siblings of a node are
the two substrings that flank it in its run. Blocks give one node each;
those are the leaves of the next round, whose blocks are cut the same way, until a group
fits one block. Sibling segments then go down: a block's own path is joined to it once, and its nodes append their
segments to it. So no level of the dataset is ever in one task, rows are narrow
(two hashes and the key), and the number of rounds grows with the logarithm of the rows.

Defined results: a null value is ``-`` in a leaf's input; null groups come first; null keys come
first in their group, rows of one key in the order of their leaves; repeated rows are leaves of their own;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import with_rank, write_table

RUN = 8
DIGITS = 64  # hex digits of a sha256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The hash of a row's values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def parents(level: Column) -> Column:
    """The next level's string of a level's string."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (RUN * DIGITS)).cast("int") - 1)
    hashes = F.transform(runs, lambda r: F.sha2(F.substring(level, r * RUN * DIGITS + 1, F.lit(RUN * DIGITS)), 256))
    return F.array_join(hashes, "").cast("binary")


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks (g, b, more, rows, strings) of ``nodes`` (g, i, node, ...): ``rows`` are the block's
    nodes in order, ``strings`` its levels from the nodes to its top; ``more``: the group
    has other blocks, so that the block ends ``levels`` above whatever its size."""
    size = RUN ** levels
    payload = [c for c in nodes.columns if c not in ("g", "i", "node")]
    cut = nodes.withColumn("b", F.floor(F.col("i") / size).cast("long"))
    rows = cut.groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct("i", "node", *payload))).alias("rows"))
    # only a group's first block does not know by itself whether another one follows
    second = nodes.filter(F.col("i") == size).select("g", F.lit(0).cast("long").alias("b"), F.lit(True).alias("more"))
    known = rows.join(second, ["g", "b"], "left").withColumn("more", (F.col("b") > 0) | F.col("more").isNotNull())
    first = F.array_join(F.transform("rows", lambda x: x["node"]), "").cast("binary")

    def climb(strings, _):
        top = F.element_at(strings, -1)
        goes = F.col("more") | (F.length(top) > DIGITS)
        return F.when(goes, F.array_append(strings, parents(top))).otherwise(strings)

    return known.withColumn("strings", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(first), climb))


def climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Written block tables, from the leaves up, and the one node (g, node) left of each group."""
    tables = []
    while True:
        table = write_table(blocks_of(nodes, levels), "manifest-blocks")
        tables.append(table)
        nodes = table.select("g", F.col("b").alias("i"), F.element_at("strings", -1).cast("string").alias("node"))
        if table.filter("more").isEmpty():
            return tables, nodes.select("g", "node")


def segments(strings: Column, place: Column, levels: int) -> Column:
    """The sibling segments of the node at ``place`` of a block's first string: an array of
    (left, right), one for each level that has a parent in the block."""
    def flanks(level: int) -> Column:
        string = F.get(strings, F.lit(level))
        at = F.floor(place / RUN ** level).cast("int")
        run = at - at % RUN
        end = F.least(run + RUN, (F.length(string) / DIGITS).cast("int"))
        return F.struct(F.substring(string, run * DIGITS + 1, (at - run) * DIGITS).alias("left"),
                        F.substring(string, (at + 1) * DIGITS + 1, (end - at - 1) * DIGITS).alias("right"))
    return F.slice(F.array(*[flanks(j) for j in range(levels)]), 1, F.size(strings) - 1)


def descended(blocks: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The nodes of ``blocks`` with their own ``path`` to the top: their segments in front of
    their block's, which ``paths`` (g, b, path, ...) gives."""
    carried = [c for c in paths.columns if c not in ("g", "b", "path")]
    fields = [f.name for f in blocks.schema["rows"].dataType.elementType]
    out = F.transform("rows", lambda x, place: F.struct(
        *[x[f].alias(f) for f in fields],
        F.concat(segments(F.col("strings"), place, levels), F.col("path")).alias("path")))
    return blocks.join(paths, ["g", "b"]).select("g", *carried, F.inline(out))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields=FIELDS,
             extra: dict[str, Column] | None = None, levels: int = 4) -> DataFrame:
    """One row for each row of ``docs``: (key, leaf, subroot, root, path, and the columns of
    ``extra``, computed beside the leaf). ``path`` holds the sibling segments (left, right), as bytes of
    hex text, from the leaf's level to the root's; :func:`folded` folds a leaf through it."""
    extra = extra or {}
    group_key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first
    leaves = docs.select(group_key.alias("g"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("node"),
                         *[c.alias(f"x_{n}") for n, c in extra.items()])
    ranked = with_rank(leaves, ["key", "node"], ["g"], "i")
    tables, subroots = climbed(ranked, levels)

    ordered = with_rank(subroots.select("g", "node"), ["g"], [], "i")
    tops, root = climbed(ordered.select(F.lit("").alias("g"), "i", "node", F.col("g").alias("of")), levels)
    first = root.first()  # the one row of the root
    paths = tops[-1].select("g", "b", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    for table in reversed(tops[1:]):
        paths = descended(table, paths, levels).select("g", F.col("i").alias("b"), "path")
    paths = descended(tops[0], paths, levels).select(
        F.col("of").alias("g"), F.lit(0).cast("long").alias("b"), "path", F.col("node").alias("subroot"))
    for table in reversed(tables[1:]):
        paths = write_table(descended(table, paths, levels).select(
            "g", F.col("i").alias("b"), "path", "subroot"), "manifest-paths")
    return descended(tables[0], paths, levels).select(
        F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", F.lit(first["node"] if first else None).cast("string").alias("root"),
        "path", *[F.col(f"x_{n}").alias(n) for n in extra])


def proof(path: Column) -> Column:
    """All sibling hashes of a path, level by level, left to right, as one text."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["left"], x["right"])).cast("string")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its sibling segments give."""
    return F.aggregate(path, start.cast("binary"), lambda a, x: F.sha2(
        F.concat(x["left"], a, x["right"]), 256).cast("binary")).cast("string")

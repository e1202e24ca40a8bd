"""Operator 9: Merkle fingerprints of documents over paragraphs and sections.

A text is split at blank lines into sections, a section at line feeds into
paragraphs, and a paragraph into leaves whose ends its content sets: a leaf ends with the space after
a word that ends in one of ``LEAF_END``, at the latest after ``LEAF_WORDS`` words. A word put
in changes the leaf it falls into, and the leaves behind keep their hashes. Each split can be
undone, so nothing of the text is outside the tree. A leaf's hash is the md5 of its text; a paragraph's, a section's
and the root's the md5 of their children's hashes, joined. Equal roots mean equal
texts; where roots differ, differing branches lead to the edits (:func:`edits`,
:func:`first_edit`). The fingerprint is the tree as one string, of the inner nodes and leaves the first 32 bits:

    root ":" section { ";" section }
    section = hash "=" paragraph { "|" paragraph },  paragraph = hash "~" leaf { "," leaf }

The likeness of two fingerprints is 1 for equal roots, else the distinct leaves they share over the larger number of
distinct leaves.

Everything is built-in expressions; texts are shuffled once.

Defined results: a null text counts as empty (one empty leaf); rows alike in key
and text are one document in the order and each get its result; a null key comes last in
descending order; a lone document is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesonar.llm.common import text_or_empty, with_rank, write_table

LEAF_WORDS = 16
LEAF_END = "[dr.]"
# up to a word that ends a leaf; else the most words a leaf has; else what is left; an empty paragraph is one empty leaf
LEAF = (f"(?:[^ ]* ){{0,{LEAF_WORDS - 1}}}?[^ ]*{LEAF_END} |(?:[^ ]* ){{{LEAF_WORDS}}}"
        f"|(?:[^ ]* ){{1,{LEAF_WORDS - 1}}}\\z|(?:[^ ]* ){{0,{LEAF_WORDS - 1}}}[^ ]+|^$")
HASH = 8  # hex digits of a node below the root
TREE = 34  # where the sections start


def joined(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes, ""))


def fingerprint(text: Column) -> Column:
    leaves = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(LEAF), 0), F.md5)))
    paragraphs = F.transform(leaves, lambda s: F.transform(s, lambda p: F.struct(joined(p).alias("h"), p.alias("below"))))
    sections = F.transform(paragraphs, lambda s: F.struct(joined(s["h"]).alias("h"), s.alias("below")))

    def short(h):
        return F.substring(h, 1, HASH)

    def paragraph(p):
        return F.concat(short(p["h"]), F.lit("~"), F.array_join(F.transform(p["below"], short), ","))

    def section(s):
        return F.concat(short(s["h"]), F.lit("="), F.array_join(F.transform(s["below"], paragraph), "|"))

    # as the one element of an array the sections have a name, and are not computed twice
    return F.transform(F.array(sections), lambda t: F.concat(
        joined(t["h"]), F.lit(":"), F.array_join(F.transform(t, section), ";")))[0]


def leaf_set(fp: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(
        F.substring(fp, TREE, 2 ** 31 - 1), "[0-9a-f]+=[0-9a-f]+~|[0-9a-f]+~", ""), "[,|;]"))


def likeness(fp_a: Column, fp_b: Column) -> Column:
    """0 to 1 from two fingerprints."""
    a, b = leaf_set(fp_a), leaf_set(fp_b)
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return F.when(F.substring(fp_a, 1, 32) == F.substring(fp_b, 1, 32), F.lit(1.0)).otherwise(shared)


def children(node: Column, level: int) -> Column:
    """The nodes below the root's tree (level 0), a section (1) or a paragraph (2), each as its part of the fingerprint."""
    below = F.substring(node, TREE if level == 0 else HASH + 2, 2 ** 31 - 1)
    return F.split(below, (";", "\\|", ",")[level])


def first_edit(fp_a: Column, fp_b: Column) -> Column:
    """The first differing place of two fingerprints as "section/paragraph/leaf", 0-based (null: equal
    roots). One branch is followed: at each level the first child whose hash differs or that one side lacks."""
    def down(a, b, level, path):
        def step(pair):
            x, y = pair["x"], pair["y"]
            at = F.array_position(F.zip_with(x, y, lambda m, n: ~F.substring(m, 1, HASH).eqNullSafe(F.substring(n, 1, HASH))), F.lit(True))
            return F.struct(at.alias("at"), F.get(x, at.cast("int") - 1).alias("x"), F.get(y, at.cast("int") - 1).alias("y"))

        def onward(found):
            here = F.concat(path, (found["at"] - 1).cast("string"))
            if level == 2:
                return here
            return F.when(found["x"].isNull() | found["y"].isNull(), here).otherwise(
                down(found["x"], found["y"], level + 1, F.concat(here, F.lit("/"))))
        pair = F.array(F.struct(children(a, level).alias("x"), children(b, level).alias("y")))
        return F.transform(F.transform(pair, step), onward)[0]
    return F.when(F.substring(fp_a, 1, 32) != F.substring(fp_b, 1, 32), down(fp_a, fp_b, 0, F.lit("")))


def edits(pairs: DataFrame, key: str, fp_a: str, fp_b: str) -> DataFrame:
    """Where the fingerprints ``fp_a`` and ``fp_b`` of a pair differ: (key, side, section, paragraph, leaf), side
    "a" or "b", places 0-based, for the leaves that only one side has.

    Differing branches alone are followed: the sections whose hash the other side lacks,
    their paragraphs of which the same holds, and those paragraphs' leaves. A node that differs while
    all nodes below it occur on the other side too (moved or repeated ones) is given itself, null below.
    ``key`` names a pair and must be unique."""
    differ = F.substring(fp_a, 1, 32) != F.substring(fp_b, 1, 32)
    nodes = pairs.filter(differ).select(F.col(key), F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col(fp_a).alias("node")),
        F.struct(F.lit("b").alias("side"), F.col(fp_b).alias("node")))).alias("n")).select(key, "n.*")
    places, out = [], None
    for level, name in enumerate(("section", "paragraph", "leaf")):
        parents = nodes
        below = nodes.select(key, "side", *places, F.posexplode(children(F.col("node"), level)).alias(name, "node"))
        same = Window.partitionBy(key, F.substring("node", 1, HASH))
        nodes = write_table(below.withColumn("one", F.min("side").over(same) == F.max("side").over(same))
                            .filter("one").drop("one"), "merkle-edits")
        places.append(name)
        if level:
            whole = parents.join(nodes, [key, "side", *places[:-1]], "left_anti").select(key, "side", *places[:-1])
            whole = whole.select(key, "side", *[F.col(c) if c in places[:-1] else F.lit(None).cast("int").alias(c)
                                                for c in ("section", "paragraph", "leaf")])
            out = whole if out is None else out.unionByName(whole)
    return out.unionByName(nodes.select(key, "side", *places))


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct (doc_id, th, n) with the next document in descending ``doc_id``
    order: next_id, next_th, next_n (after the last one: the first)."""
    distinct = rows.groupBy("doc_id", "th").agg(F.first("n").alias("n"))
    ranked = write_table(with_rank(distinct, ["doc_id", "th"], [], "rank"), "merkle-ranks")
    count = ranked.count()
    nexts = ranked.select(((F.col("rank") + 1) % F.lit(max(count, 1))).alias("rank"), F.col("doc_id").alias("next_id"),
                          F.col("th").alias("next_th"), F.col("n").alias("next_n"))
    return ranked.join(nexts, "rank").drop("rank")


def join_key(id_: str, th: str) -> Column:
    """Id and text hash as one key that is never null."""
    return F.concat_ws(":", F.col(th).cast("string"), F.col(id_).cast("string"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents (doc_id, text), of their edited texts (the last
    third replaced by the start of the next document in descending ``doc_id`` order), the
    first place where these two differ, and the likeness to the edited text's and to the next document's fingerprint.

    Neighbours are found on narrow rows; then each text is shuffled once, to its
    key, and the start of a next document (a third of this one's length) and its
    fingerprint are sent to the document that needs them."""
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    pairs = write_table(neighbours(base.select("doc_id", "th", F.length("text").cast("long").alias("n"))), "merkle-pairs")
    # both uses of the texts need the same two columns, so one exchange serves both
    rows = base.select(join_key("doc_id", "th").alias("key"), "text")
    wanted = pairs.select(join_key("next_id", "next_th").alias("key"), "doc_id", join_key("doc_id", "th").alias("to"),
                          F.floor(F.col("n") / 3).cast("int").alias("k"))
    given = (rows.join(wanted, "key")
             .select(F.col("to").alias("key"), "doc_id", F.substring("text", F.lit(1), F.col("k")).alias("head"),
                     fingerprint(F.col("text")).alias("next_fp"))
             .groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "head", "next_fp")]))
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    both = rows.join(given, "key").select(
        "doc_id", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"), "next_fp",
        F.concat(F.substring("text", F.lit(1), n - k), F.col("head")).alias("edited"))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fp").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
        first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"))

"""Candidate snippets and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.functions.jsonfix import indented
from lakesonar.functions.text import best_or_unknown

GRAMS_SQL = ("array_distinct(flatten(transform(filter(split(lower({t}), '[^a-z0-9]+'), w -> w <> ''), "
             "w -> transform(sequence(1, length(w)), i -> substr(concat('#', w, '#'), i, 3)))))")


# What an answer says of each of its at most k hits.
HIT = ["rank", "id", "distance", "enriched_text", "json_summary"]


def grams(text: str) -> Column:
    """Distinct character 3-grams of the words ``#word#`` of a text column."""
    return F.expr(GRAMS_SQL.format(t=text))


def snippet(rank: str = "rank", json_col: str = "json_summary",
            text_col: str = "enriched_text") -> Column:
    """``Candidate #i - Table Name: {name}\\n{indented JSON}`` for a JSON
    object, else ``Candidate #i - {enriched_text}``. A missing or null name
    falls back to ``Candidate_i`` (Q16)."""
    js = F.col(json_col)
    v = F.try_parse_json(F.when(F.regexp_replace(js, r"(?U)^\s+|\s+$", "") != "", js))
    is_obj = v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT"))
    name = F.coalesce(F.get_json_object(js, "$.name"), F.concat(F.lit("Candidate_"), F.col(rank).cast("string")))
    pretty = indented(F.when(is_obj, js))
    head = F.concat(F.lit("Candidate #"), F.col(rank).cast("string"), F.lit(" - "))
    return F.when(is_obj, F.concat(head, F.lit("Table Name: "), name, F.lit("\n"), F.coalesce(pretty, js))) \
        .otherwise(F.concat(head, F.coalesce(F.col(text_col), F.lit(""))))


def join_snippets(cands: DataFrame, q_id: str = "query_id") -> DataFrame:
    """Snippets of one question joined with newlines in rank order (bounded by k)."""
    return cands.groupBy(q_id).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]), "\n")
        .alias("schemas_text"))


def rerank_prompt(template: str, query_col: str = "query", schemas_col: str = "schemas_text") -> Column:
    """Fill the ``{q}`` and ``{s}`` slots of the rerank template."""
    return F.replace(F.replace(F.lit(template), F.lit("{q}"), F.col(query_col)),
                     F.lit("{s}"), F.col(schemas_col))


def coverage_scores(hits: DataFrame, q_text: str = "query", c_text: str = "enriched_text") -> DataFrame:
    """N9 score: share of the question's distinct 3-grams found among the
    candidate's (name, field names, descriptions)."""
    q, c = grams(q_text), grams(c_text)
    return hits.withColumn("coverage", F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q))
                           .otherwise(F.lit(0.0)))


def pick_best(scored: DataFrame, q_id: str = "query_id", score: str = "coverage") -> DataFrame:
    """Best candidate per question: highest score, then best rank. ``max_by``
    aggregates partially, so no question's candidates need one task."""
    return scored.groupBy(q_id).agg(
        F.max_by("id", F.struct(F.col(score), -F.col("rank"))).alias("best_table_name"),
        F.array_sort(F.collect_list(F.struct(*HIT))).alias("top_k"))


def rerank_with_model(prompts: DataFrame, model_fn, prompt_col: str = "prompt", replies: tuple[str, str] | None = None,
                      factory: bool = False) -> DataFrame:
    """The model picks one table; failures answer ``UnknownTable``."""
    from lakesonar.operators.enrich import _called
    r = _called(prompts, prompt_col, model_fn, replies, factory)
    return (r.withColumn("best_table_name", best_or_unknown(F.col("_reply"), F.col("_error").isNotNull()))
            .drop("_reply", "_error"))

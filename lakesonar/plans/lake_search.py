"""End-to-end lake search: index a lake, answer a table of questions.

indexing:  tables → profile → offline enrichment (E5) → summaries (J1-J3)
           → indexed text → V4 embedding → index records (X2) [→ X3/X4 store]
querying:  questions → V4 embedding → exact top-k (K1) → candidate snippets
           (N1-N2) → coverage rerank (N9) or a model (N4-N6) → answers (N8)

One Spark job per phase; the questions are a DataFrame, not a loop.

A user's ``model_fn`` (``list[str] -> list[str]``) fills in descriptions of the summaries, a
user's ``embed_fn`` (``list[str] -> list[vector]``) with its ``model_id`` embeds records and
questions in place of V4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesonar.functions.text import strip
from lakesonar.operators.embed import MODEL_ID, embed_with, hashed_embedding
from lakesonar.operators.enrich import enrich_structured, offline_dataset_description, offline_enrich
from lakesonar.operators.profile import profile
from lakesonar.operators.rerank import coverage_scores, pick_best, snippet
from lakesonar.operators.retrieve import top_k
from lakesonar.operators.summary import summarize, summary_json

# The answer to a question without a match, the instruction of structured
# enrichment, and the part of a model's reply that enters a summary.
UNKNOWN = "UnknownTable"
INSTRUCTION = "Fill in the empty texts of this JSON and reply with the JSON alone."
REPLY = ("dataset_description string, fields array<struct<column string, "
         "properties struct<semantic_type string, description string>>>")


def build_summaries(tables, sample_rows: int | None = None, n_samples: int = 3,
                    exact=True, enrich: bool = True) -> DataFrame:
    """(name, file_name, dataset_description, fields, field_names, json_summary, enriched_text).

    ``enrich=False`` (J6) keeps the base summary: empty semantic types,
    descriptions and dataset description.
    """
    p = profile(tables, n_samples=n_samples, exact=exact, sample_rows=sample_rows)
    # one row per column, used twice below: materialise it once
    p = materialize(offline_enrich(p) if enrich else p)
    s = summarize(p, offline_dataset_description(p) if enrich else None)
    return materialize(s.withColumn("enriched_text", index_text()))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder (one row per
    table here): later steps read it instead of re-profiling the lake."""
    from lakesonar.session import shared_dir
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def index_text() -> F.Column:
    """Indexed prose: table name and column names (samples stay out)."""
    return F.concat_ws(" ", F.col("name"), F.array_join("field_names", " "))


def apply_model(summaries: DataFrame, model_fn, instruction: str = INSTRUCTION) -> DataFrame:
    """The texts of the model's repaired reply (dataset description; semantic type and
    description of each column by its name) replace those of the summary, the statistics stay, and
    ``json_summary`` and the indexed text follow. ``status`` is ``ok``, or ``base`` for a record
    that keeps its base summary because the call or the reply failed."""
    s = enrich_structured(summaries, model_fn, instruction)
    s = s.withColumn("_r", F.when(F.col("status") == "ok", F.from_json("enriched_json", REPLY)))

    def said(reply, old):
        return F.coalesce(F.when(F.trim(reply) != "", reply), old)

    def field(f):
        mine = F.get(F.filter("_r.fields", lambda r: r["column"] == f["column"]), 0)["properties"]
        p = f["properties"]
        return f.withField("properties", p.withField("semantic_type", said(mine["semantic_type"], p["semantic_type"]))
                           .withField("description", said(mine["description"], p["description"])))

    text = F.concat_ws(" ", index_text(), F.when(F.trim("_r.dataset_description") != "", F.col("_r.dataset_description")))
    s = (s.withColumn("fields", F.transform("fields", field))
         .withColumn("enriched_text", text)
         .withColumn("dataset_description", said(F.col("_r.dataset_description"), F.col("dataset_description")))
         .withColumn("status", F.when(F.col("status") == "ok", "ok").otherwise("base")))
    return materialize(s.withColumn("json_summary", summary_json(s)).drop("_r", "enriched_json"))


def embedded(df: DataFrame, id_col: str, text_col: str, embed_fn=None, model_id: str = MODEL_ID,
             factory: bool = False) -> DataFrame:
    """(id, embedding) of the rows with a text: V4, or V1/V2 with a user's ``embed_fn``,
    whose vectors need a ``model_id`` of their own."""
    if (embed_fn is None) != (model_id == MODEL_ID):
        raise ValueError(f"embed_fn and a model_id other than {MODEL_ID} go together")
    if embed_fn is None:
        return hashed_embedding(df, id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(strip(F.col("text")) != "")
    return embed_with(rows, "text", embed_fn, factory=factory).select("id", F.col("embedding").cast("array<double>"))


def index_records(summaries: DataFrame, embed_fn=None, model_id: str = MODEL_ID, factory: bool = False) -> DataFrame:
    """Records ready for the index: (id, embedding, norm, enriched_text, json_summary, model_id)."""
    from lakesonar.operators.index import record_id
    s = summaries.withColumn("id", record_id())
    emb = embedded(s, "id", "enriched_text", embed_fn, model_id, factory)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)) if embed_fn else F.lit(1.0)
    status = [F.col("status")] if "status" in s.columns else []
    return (s.join(emb, "id", "left")
            .select("id", "embedding", F.when(F.col("embedding").isNotNull(), length).alias("norm"),
                    "enriched_text", "json_summary", *status, F.lit(model_id).alias("model_id")))


def table_questions(tables) -> DataFrame:
    """One question per table, made from its column names without the key and
    the table prefix: ``Which table has <a> and <b> ...``. ``expected_table``
    is the table the columns came from. Built from the schemas (metadata
    already on the driver, like the column catalog); ids follow table names."""
    import re
    from lakesonar.operators.profile import _as_items
    items = sorted(_as_items(tables), key=lambda t: t[0])
    rows = []
    for name, df in items:
        words = [re.sub(r"^[a-z]+_", "", f.name) for f in df.schema.fields[1:]]
        if words:
            rows.append((len(rows) + 1, "Which table has " + " and ".join(words), name))
    spark = items[0][1].sparkSession
    return spark.createDataFrame(rows, "query_id long, query string, expected_table string")


def check_model(index: DataFrame, model_id: str = MODEL_ID) -> int | None:
    """V3: questions must be embedded by the model that built the index, whose vectors have
    one dimension; returns it (None: no vectors). One small aggregate over the index."""
    ids = F.collect_set("model_id") if "model_id" in index.columns else F.array().cast("array<string>")
    size = F.size("embedding") if "embedding" in index.columns else F.lit(None).cast("int")
    found = index.agg(ids.alias("ids"), F.min(F.when(size > 0, size)).alias("low"), F.max(size).alias("high")).first()
    if found["ids"] and set(found["ids"]) != {model_id}:
        raise ValueError(f"index was built with {sorted(found['ids'])}, questions use {model_id}")
    if found["low"] is not None and found["low"] != found["high"]:
        raise ValueError(f"index holds vectors of {found['low']} to {found['high']} dimensions")
    return found["low"]


def candidates(questions: DataFrame, index: DataFrame, k: int = 3, metric: str = "cosine",
               include_failed: bool = False, embed_fn=None, model_id: str = MODEL_ID,
               factory: bool = False) -> DataFrame:
    """K1 + N1: the top-k index records of every question with their snippets."""
    dim = check_model(index, model_id)
    if not include_failed and "status" in index.columns:
        index = index.filter(F.coalesce(F.col("status"), F.lit("ok")) != "failed")
    q_emb = embedded(questions, "query_id", "query", embed_fn, model_id, factory).withColumnRenamed("id", "query_id")
    hits = top_k(q_emb, index.select("id", "embedding"), k=k, metric=metric, dim=dim)
    hits = (hits.join(questions.select("query_id", "query"), "query_id")
            .join(index.select("id", "enriched_text", "json_summary"), "id"))
    return hits.withColumn("snippet", snippet())


def answer(questions: DataFrame, index: DataFrame, k: int = 3, metric: str = "cosine",
           include_failed: bool = False, embed_fn=None, model_id: str = MODEL_ID, factory: bool = False) -> DataFrame:
    """(query_id, query, best_table_name, in_candidates, top_k) per question,
    reranked by 3-gram coverage (N9)."""
    hits = candidates(questions, index, k, metric, include_failed, embed_fn, model_id, factory)
    return _for_all(questions, pick_best(coverage_scores(hits)))


def _for_all(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question with its answer; one that matches nothing (no token, empty
    index) gets ``UnknownTable`` and no candidates."""
    top = answers.schema["top_k"].dataType
    return (questions.select("query_id", "query").join(answers.drop("query"), "query_id", "left")
            .withColumns({"best_table_name": F.coalesce("best_table_name", F.lit(UNKNOWN)),
                          "top_k": F.coalesce("top_k", F.array().cast(top))})
            .withColumn("in_candidates", F.exists("top_k", lambda h: h["id"] == F.col("best_table_name"))))


def answer_with_model(questions: DataFrame, index: DataFrame, model_fn, template: str,
                      k: int = 3, metric: str = "cosine", embed_fn=None, model_id: str = MODEL_ID,
                      factory: bool = False) -> DataFrame:
    """N2-N8 with a model: snippets joined per question, template filled, one
    model call per question (Arrow batches), reply parsed, ``UnknownTable`` on
    failure, and whether the answer is among the candidates (N7)."""
    from lakesonar.operators.rerank import HIT, join_snippets, rerank_prompt, rerank_with_model
    hits = candidates(questions, index, k, metric, False, embed_fn, model_id, factory)
    tops = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct(*HIT))).alias("top_k"))
    prompts = (join_snippets(hits).join(questions.select("query_id", "query"), "query_id")
               .withColumn("prompt", rerank_prompt(template)))
    return _for_all(questions, rerank_with_model(prompts, model_fn).join(tops, "query_id"))


def build_index(spark, tables, path: str | None = None, mode: str = "upsert",
                sample_rows: int | None = None, exact=True, embed_fn=None, model_id: str = MODEL_ID,
                factory: bool = False, model_fn=None, instruction: str = INSTRUCTION,
                inventory: DataFrame | None = None) -> DataFrame:
    """Profile, summarise, enrich, embed and store the tables; returns the stored index.
    ``factory`` is for ``embed_fn`` (:func:`embed_with`). With the lake's ``inventory`` a record keeps the newest
    modification time of its table's files, which ``reindex_delta`` compares.

    The index is a written Parquet table under ``path`` (default: a new folder
    in the shared checkpoint folder), so later steps read it instead of
    recomputing profiles and embeddings.
    """
    from lakesonar.operators.index import insert_if_absent, open_index, upsert
    from lakesonar.session import new_table_path
    path = path or new_table_path(spark, "lake-index")
    summaries = build_summaries(tables, sample_rows=sample_rows, exact=exact)
    if model_fn is not None:
        summaries = apply_model(summaries, model_fn, instruction)
    recs = index_records(summaries, embed_fn, model_id, factory)
    if inventory is not None:
        times = inventory.groupBy(F.col("table_name").alias("id")).agg(F.max("modified_at").alias("source_modified_at"))
        recs = recs.join(times, "id", "left")
    (upsert if mode == "upsert" else insert_if_absent)(spark, path, recs, batch=1)
    return open_index(spark, path)


def lake_search(spark, tables, questions: DataFrame | None = None, k: int = 3,
                index_path: str | None = None, exact=True, embed_fn=None, model_id: str = MODEL_ID,
                factory: bool = False, model_fn=None, instruction: str = INSTRUCTION) -> DataFrame:
    """Index the given tables and answer the questions (one per table when
    none are given)."""
    if questions is None:
        questions = table_questions(tables)
    idx = build_index(spark, tables, index_path, exact=exact, embed_fn=embed_fn, model_id=model_id,
                      factory=factory, model_fn=model_fn, instruction=instruction)
    return answer(questions, idx, k=k, embed_fn=embed_fn, model_id=model_id, factory=factory)

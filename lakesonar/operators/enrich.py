"""Enrichment (E1-E5): batch model calls as an Arrow UDF surface.

``model_fn`` is a plain Python callable ``list[str] -> list[str]`` supplied by
the user; it runs inside ``mapInPandas`` so a client is built once per task
and prompts travel in Arrow batches. A failing batch is retried item by item
so that one bad prompt fails one row, not the task. The offline default (E5)
is a set of SQL expressions and needs no model at all.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.functions.jsonfix import repair, try_parse
from lakesonar.functions.semantic import sql_description, sql_semantic_type
from lakesonar.functions.text import strip
from lakesonar.session import new_table_path, table_exists

# Prompt slots and the failure marker of prose enrichment.
JSON_SLOT = "{json_summary}"
FAILED_PREFIX = "LLM call failed; no enriched summary generated. Error details: "

ModelFn = Callable[[list[str]], list[str]]


# Prompts sent to a model in one call.
MODEL_BATCH = 64

def call_model(df: DataFrame, prompt_col: str, model_fn: ModelFn,
               reply_col: str = "reply", error_col: str = "error",
               factory: bool = False) -> DataFrame:
    """Add (reply, error) by calling ``model_fn`` on Arrow batches of prompts.

    With ``factory=True`` ``model_fn`` is a zero-argument callable returning
    the batch function, called once per task (for clients that are costly to
    build). Output is deterministic for a deterministic model, so task retries
    are safe.
    """
    from lakesonar.session import ship_package
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(reply_col, T.StringType()),
                                              T.StructField(error_col, T.StringType())])

    def run(batches):
        fn = model_fn() if factory else model_fn
        for pdf in batches:
            prompts = pdf[prompt_col].tolist()
            replies, errors = [None] * len(prompts), [None] * len(prompts)
            # a failing call is halved until the failing prompts stand alone
            spans = [(i, min(i + MODEL_BATCH, len(prompts))) for i in range(0, len(prompts), MODEL_BATCH)]
            while spans:
                a, b = spans.pop()
                try:
                    out = list(fn(prompts[a:b]))
                    if len(out) != b - a:
                        raise ValueError("model returned a different number of replies")
                    replies[a:b] = out
                except Exception as e:  # noqa: BLE001 - isolate the failing prompts
                    if b - a == 1:
                        errors[a] = f"{type(e).__name__}: {e}"
                    else:
                        spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
            pdf = pdf.copy()
            pdf[reply_col] = pd.Series(replies, dtype=object)
            pdf[error_col] = pd.Series(errors, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)


REPLY_SCHEMA = "prompt_hash string, model_id string, prompt string, reply string, error string, run long"


def prompt_hash(prompt: F.Column, model_id: str) -> F.Column:
    """The key of a stored reply: a hash of the model's id and the prompt."""
    return F.sha2(F.concat(F.lit(f"{model_id}\n"), prompt), 256)


def stored_replies(spark, path: str, kind: str = "replies") -> DataFrame:
    """The reply table under ``path``, or its ``errors``: one row for each prompt and run that failed."""
    if not table_exists(spark, f"{path}/{kind}"):
        return spark.createDataFrame([], REPLY_SCHEMA)
    return spark.read.schema(REPLY_SCHEMA).parquet(f"{path}/{kind}")


def call_model_stored(df: DataFrame, prompt_col: str, model_fn: ModelFn, path: str, model_id: str, run: int = 0,
                      reply_col: str = "reply", error_col: str = "error", factory: bool = False) -> DataFrame:
    """:func:`call_model` through a table of replies: each distinct prompt that has no stored reply is called
    once, its reply is added to ``<path>/replies`` or its reason to ``<path>/errors``, and rows get theirs by a join. A
    later run calls no prompt that was answered, and failed ones again."""
    spark = df.sparkSession
    prompts = df.select(F.col(prompt_col).alias("prompt")).filter("prompt IS NOT NULL").distinct()
    keyed = prompts.select(prompt_hash(F.col("prompt"), model_id).alias("prompt_hash"), "prompt")
    new = keyed.join(stored_replies(spark, path).select("prompt_hash"), "prompt_hash", "left_anti")
    called = call_model(new, "prompt", model_fn, factory=factory).select(
        "prompt_hash", F.lit(model_id).alias("model_id"), "prompt", "reply", "error", F.lit(run).cast("long").alias("run"))
    staged = new_table_path(spark, "model-calls")  # the model is called once, whatever is read from it
    called.write.parquet(staged)
    called = spark.read.schema(REPLY_SCHEMA).parquet(staged)
    for kind, rows in (("replies", called.filter("error IS NULL")), ("errors", called.filter("error IS NOT NULL"))):
        rows.write.mode("append").parquet(f"{path}/{kind}")
    # a run that was repeated half-way may have stored a reply twice
    known = stored_replies(spark, path).dropDuplicates(["prompt_hash"]).select("prompt_hash", F.col("reply").alias(reply_col))
    failed = called.filter("error IS NOT NULL").select("prompt_hash", F.col("error").alias(error_col))
    key = "_prompt_hash"
    return (df.withColumn(key, prompt_hash(F.col(prompt_col), model_id))
            .join(known.withColumnRenamed("prompt_hash", key), key, "left")
            .join(failed.withColumnRenamed("prompt_hash", key), key, "left").drop(key))


def _called(df: DataFrame, prompt_col: str, model_fn: ModelFn, replies: tuple[str, str] | None, factory: bool) -> DataFrame:
    """(_reply, _error) by a call, or through the reply table ``replies`` = (path, model id)."""
    if replies is None:
        return call_model(df, prompt_col, model_fn, "_reply", "_error", factory)
    return call_model_stored(df, prompt_col, model_fn, *replies, reply_col="_reply", error_col="_error", factory=factory)


def structured_prompt(instruction: str, json_col: str = "json_summary"):
    """E1 prompt: the instruction followed by the summary JSON."""
    return F.concat(F.lit(instruction), F.lit("\n"), F.col(json_col))


def prose_prompt(template: str, json_col: str = "json_pretty"):
    """E3 prompt: literal replacement of ``{json_summary}`` in the template."""
    return F.replace(F.lit(template), F.lit(JSON_SLOT), F.col(json_col))


def enrich_structured(summaries: DataFrame, model_fn: ModelFn, instruction: str,
                      on_error: str = "keep_base", replies: tuple[str, str] | None = None, factory: bool = False) -> DataFrame:
    """Model reply → R1/R2 repair → R3 parse.

    Adds ``enriched_json`` (repaired text), ``status`` and ``display_name``
    (the model's ``name``; the index id stays the source name, Q14).
    ``on_error='raise'`` fails the job on the first bad row, as the reference;
    ``'keep_base'`` keeps the base summary and marks the row failed. ``replies`` = (path, model id): see
    :func:`call_model_stored`.
    """
    df = summaries.withColumn("_prompt", structured_prompt(instruction))
    df = _called(df, "_prompt", model_fn, replies, factory)
    fixed = repair(F.col("_reply"))
    ok = F.col("_error").isNull() & try_parse(fixed).isNotNull()
    out = (df.withColumn("_fixed", fixed)
           .withColumn("status", F.when(ok, "ok").otherwise("failed"))
           .withColumn("enriched_json", F.when(ok, F.col("_fixed")).otherwise(F.col("json_summary")))
           .withColumn("display_name", F.when(ok, F.get_json_object("_fixed", "$.name"))))
    if on_error == "raise":
        out = out.withColumn("status", F.when(F.col("status") == "ok", "ok").otherwise(
            F.raise_error(F.lit("a reply could not be parsed as JSON (on_error='raise')"))))
    return out.drop("_prompt", "_reply", "_error", "_fixed")


def enrich_prose(summaries: DataFrame, model_fn: ModelFn, template: str,
                 replies: tuple[str, str] | None = None, factory: bool = False) -> DataFrame:
    """Prose ``enriched_text``; a failure becomes the marker text with
    ``status='failed'`` (kept out of search by default)."""
    df = summaries.withColumn("_prompt", prose_prompt(template))
    df = _called(df, "_prompt", model_fn, replies, factory)
    failed = F.col("_error").isNotNull()
    return (df.withColumn("enriched_text", F.when(failed, F.concat(F.lit(FAILED_PREFIX), F.col("_error")))
                          .otherwise(strip(F.col("_reply"))))
            .withColumn("status", F.when(failed, "failed").otherwise("ok"))
            .drop("_prompt", "_reply", "_error"))


def offline_enrich(profile_df: DataFrame) -> DataFrame:
    """E5 on the ``profile`` rows: fills ``semantic_type`` and ``description``."""
    return (profile_df.withColumn("semantic_type", F.expr(sql_semantic_type()))
            .withColumn("description", F.expr(sql_description())))


def offline_dataset_description(profile_df: DataFrame) -> DataFrame:
    """E5: (table_name, dataset_description) from a template over the columns,
    aggregated per table (bounded by the column count)."""
    g = profile_df.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_rows").alias("rows"),
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("cs"))
    return g.select("table_name", F.concat(
        F.lit("Table "), F.col("table_name"), F.lit(" with "), F.col("n").cast("string"),
        F.lit(" columns and "), F.col("rows").cast("string"), F.lit(" rows: "),
        F.array_join(F.transform("cs", lambda x: x["column_name"]), ", "), F.lit(".")
    ).alias("dataset_description"))

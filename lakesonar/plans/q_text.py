"""Registered JSON-repair, reply, enrichment and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesonar.functions.jsonfix import extract_json, remove_trailing_commas, repair, try_parse
from lakesonar.functions.semantic import sql_semantic_type
from lakesonar.functions.text import UNKNOWN_TABLE, best_or_unknown, parse_table_name
from lakesonar.operators.embed import hashed_terms
from lakesonar.operators.enrich import call_model, offline_enrich
from lakesonar.operators.profile import profile
from lakesonar.plans.q_profile import all_schemas, duck_dtype, duck_source, lake_with_dates
from lakesonar.plans.registry import LAKE_TABLES, query, read_lake, union_sql, read_table
from lakesonar.session import new_table_path

# --- JSON repair (R1-R4) ----------------------------------------------------

def _wrapped_spark():
    return F.when(F.col("event_id") % 13 == 0,
                  F.concat(F.lit("no json here, id "), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("Sure! Here is the summary:\n"), F.col("props"), F.lit("\nHope this helps }{ :)")))
WRAPPED_DUCK = ("CASE WHEN event_id % 13 = 0 THEN 'no json here, id ' || event_id::VARCHAR "
                "ELSE 'Sure! Here is the summary:' || chr(10) || props || chr(10) || 'Hope this helps }{ :)' END")


@query("extract_json", f"""
SELECT event_id, nullif(regexp_extract(t, '(?s)\\{{.*\\}}', 0), '') AS extracted
FROM (SELECT event_id, {WRAPPED_DUCK} AS t FROM events)""")
def q_extract_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", extract_json(_wrapped_spark()).alias("extracted"))


def _commas_spark(e):
    return (F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", "}", ", }"))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"list": [1, 2,\n ], "s": "a,}", "p": '),
                                                      F.col("props"), F.lit(",\t}")))
            .otherwise(F.col("props")))


COMMAS_DUCK = ("CASE WHEN event_id % 3 = 0 THEN replace(props, '}', ', }') "
               "WHEN event_id % 3 = 1 THEN '{\"list\": [1, 2,' || chr(10) || ' ], \"s\": \"a,}\", \"p\": ' || props || ',' || chr(9) || '}' "
               "ELSE props END")


@query("trim_commas", f"""
SELECT event_id, regexp_replace(s, ',\\s*(\\}}|\\])', '\\1', 'g') AS fixed
FROM (SELECT event_id, {COMMAS_DUCK} AS s FROM events)""")
def q_trim_commas(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", remove_trailing_commas(_commas_spark(e)).alias("fixed"))


def _broken_spark():
    s = _commas_spark(None)
    wrapped = F.concat(F.lit("Result: "), s, F.lit(" -- end"))
    return F.when(F.col("event_id") % 11 == 0, F.regexp_replace(wrapped, '"k"', '"k')).otherwise(wrapped)


BROKEN_DUCK = (f"CASE WHEN event_id % 11 = 0 THEN replace('Result: ' || ({COMMAS_DUCK}) || ' -- end', '\"k\"', '\"k') "
               f"ELSE 'Result: ' || ({COMMAS_DUCK}) || ' -- end' END")


@query("parse_repaired", f"""
SELECT event_id, coalesce(json_valid(r), false) AS is_valid,
       CASE WHEN json_valid(r) THEN json_extract_string(r, '$.k') END AS k,
       CASE WHEN json_valid(r) THEN json_extract_string(r, '$.p.k') END AS pk
FROM (SELECT event_id, regexp_replace(nullif(regexp_extract({BROKEN_DUCK}, '(?s)\\{{.*\\}}', 0), ''),
      ',\\s*(\\}}|\\])', '\\1', 'g') AS r FROM events)""")
def q_parse_repaired(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r = repair(_broken_spark())
    ok = try_parse(r).isNotNull()
    return e.select("event_id", r.alias("r")).select(
        "event_id", F.coalesce(try_parse(F.col("r")).isNotNull(), F.lit(False)).alias("is_valid"),
        F.when(try_parse(F.col("r")).isNotNull(), F.get_json_object("r", "$.k")).alias("k"),
        F.when(try_parse(F.col("r")).isNotNull(), F.get_json_object("r", "$.p.k")).alias("pk"))


# --- reply parsing (N5, N6) --------------------------------------------------

REPLY_DUCK = ("CASE WHEN turn % 4 = 0 THEN 'The best table is: ' || role || '_' || conv_id::VARCHAR || '.events, because' "
              "WHEN turn % 4 = 1 THEN chr(9) || ' ' || role || '_table ' || chr(10) "
              "WHEN turn % 4 = 2 THEN 'Answer:' || chr(10) || '   sales.daily_revenue' "
              "ELSE text END")


def _reply_spark():
    return (F.when(F.col("turn") % 4 == 0, F.concat(F.lit("The best table is: "), "role", F.lit("_"),
                                                    F.col("conv_id").cast("string"), F.lit(".events, because")))
            .when(F.col("turn") % 4 == 1, F.concat(F.lit("\t "), "role", F.lit("_table \n")))
            .when(F.col("turn") % 4 == 2, F.lit("Answer:\n   sales.daily_revenue"))
            .otherwise(F.col("text")))


@query("parse_reply", f"""
SELECT conv_id, turn, CASE WHEN m <> '' THEN m ELSE regexp_replace(reply, '^\\s+|\\s+$', '', 'g') END AS best_table_name
FROM (SELECT conv_id, turn, reply, regexp_extract(reply, ':\\s*([\\p{{L}}\\p{{N}}\\p{{M}}_.]+)', 1) AS m
      FROM (SELECT conv_id, turn, {REPLY_DUCK} AS reply FROM conversations))""")
def q_parse_reply(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", parse_table_name(_reply_spark()).alias("best_table_name"))


# --- batch model surface (E1-E4, N4, N5) -------------------------------------

def fake_model(prompts):
    """A deterministic stand-in for a model client: answers with a table name
    built from the prompt, and fails on prompts whose length is a multiple of 5."""
    out = []
    for p in prompts:
        if len(p) % 5 == 0:
            raise RuntimeError("model unavailable")
        role, turn = p.split("|", 2)[:2]
        out.append(f"Best table: {role}_t{turn}")
    return out


@query("model_batch", f"""
SELECT conv_id, turn, CASE WHEN length(p) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN length(p) % 5 = 0 THEN '{UNKNOWN_TABLE}' ELSE role || '_t' || turn::VARCHAR END AS best_table_name
FROM (SELECT conv_id, turn, role, role || '|' || turn::VARCHAR || '|' || text AS p FROM conversations)""")
def q_model_batch(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = c.withColumn("prompt", F.concat_ws("|", "role", F.col("turn").cast("string"), "text"))
    r = call_model(c, "prompt", fake_model)
    failed = F.col("error").isNotNull()
    return r.select("conv_id", "turn", F.when(failed, "failed").otherwise("ok").alias("status"),
                    best_or_unknown(F.col("reply"), failed).alias("best_table_name"))


# --- stored replies (E1, E2, R3) ----------------------------------------------

REPLIES_ID = "reversing"


def reversing_model(prompts):
    """Stand-in model: answers back to front; fails on prompts whose length is a multiple of 5."""
    if any(len(p) % 5 == 0 for p in prompts):
        raise RuntimeError("model unavailable")
    return [p[::-1] for p in prompts]


@query("model_replies", f"""
WITH p AS (SELECT DISTINCT text AS prompt, conv_id % 2 = 0 AS early FROM conversations WHERE text IS NOT NULL),
first AS (SELECT prompt, CASE WHEN bool_or(early) THEN 1 ELSE 2 END AS run, length(prompt) % 5 = 0 AS failed FROM p GROUP BY prompt),
runs AS (SELECT prompt, run, failed FROM first UNION ALL SELECT prompt, 2, true FROM first WHERE failed AND run = 1)
SELECT sha256('{REPLIES_ID}' || chr(10) || prompt) AS prompt_hash, run::BIGINT AS run, CASE WHEN failed THEN 'errors' ELSE 'replies' END AS kind,
  CASE WHEN failed THEN 'RuntimeError: model unavailable' ELSE length(prompt)::VARCHAR END AS outcome FROM runs""")
def q_model_replies(spark, sf_dir):
    """The stored replies and failures of two runs over conversation texts: the even conversations, then all. Each
    prompt is answered in one run; failed ones are tried in both."""
    from lakesonar.operators.enrich import call_model_stored, stored_replies
    path = new_table_path(spark, "model-replies")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    call_model_stored(c.filter("conv_id % 2 = 0"), "text", reversing_model, path, REPLIES_ID, run=1)
    call_model_stored(c, "text", reversing_model, path, REPLIES_ID, run=2)
    rows = [stored_replies(spark, path, kind).select("prompt_hash", "run", F.lit(kind).alias("kind"), F.coalesce(
        "error", F.length("reply").cast("string")).alias("outcome")) for kind in ("replies", "errors")]
    return rows[0].union(rows[1])


# --- semantic types (E5) -----------------------------------------------------

def _semantic_oracle():
    parts = []
    for t, cols in all_schemas().items():
        for c, ty in cols:
            st = sql_semantic_type(column=f"'{c}'", dtype="dt", first_sample="s1", duck=True)
            if ty == "VARCHAR":
                s1 = (f"(SELECT v FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {duck_source(t)} "
                      f"WHERE {c} IS NOT NULL) ORDER BY md5(v), v LIMIT 1)")
            else:
                s1 = "NULL"
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {st} AS semantic_type "
                         f"FROM (SELECT {duck_dtype(t, c, ty)} AS dt, {s1} AS s1 FROM {duck_source(t)})")
    return union_sql(parts)


@query("semantic_types", _semantic_oracle())
def q_semantic_types(spark, sf_dir):
    p = offline_enrich(profile(lake_with_dates(spark, sf_dir)))
    return p.select("table_name", "column_name", "semantic_type")


# --- prompt building (E1, E3) ------------------------------------------------

# A prose prompt with the summary slot.
PROSE_TEMPLATE = "Describe this dataset in a few sentences for a search index.\n---\n{json_summary}\n---"


@query("enrich_prompt")
def q_enrich_prompt(spark, sf_dir):
    """No oracle (the summaries hold engine-specific number texts): see tests/test_text_json.py."""
    from lakesonar.operators.enrich import prose_prompt
    from lakesonar.plans.lake_search import build_summaries
    from lakesonar.operators.summary import summary_json
    s = build_summaries(read_lake(spark, sf_dir))
    s = s.withColumn("json_pretty", summary_json(s, pretty=True)).withColumn("prompt", prose_prompt(PROSE_TEMPLATE))
    return s.select(F.col("name").alias("table_name"), "prompt", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").alias("prompt_len"))


# --- hashed embedding (V4) ---------------------------------------------------

HASH_TERMS_DUCK = """
WITH w AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents),
g AS (SELECT id, substr('#' || w || '#', i::INTEGER, 3) AS g FROM (SELECT id, w, unnest(generate_series(1, length(w))) AS i FROM w WHERE w <> '')),
tf AS (SELECT id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 256 AS bucket, count(*) AS tf FROM g GROUP BY ALL)
SELECT id AS doc_id, bucket::INTEGER AS bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS weight FROM tf"""


@query("hash_embedding", HASH_TERMS_DUCK)
def q_hash_embedding(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    t = hashed_terms(d, "doc_id", "text")
    return t.select(F.col("id").alias("doc_id"), F.col("bucket").cast("int").alias("bucket"), "tf",
                    F.round("weight", 6).alias("weight"))


# --- structured and prose enrichment through a model (E1-E4) -----------------

def fake_enricher(prompts):
    """Stand-in model for enrichment: wraps a JSON reply in prose with a trailing
    comma; fails when the summary's table name has a length divisible by 3."""
    import json as _json
    out = []
    for p in prompts:
        body = p[p.index("{"):]
        name = _json.loads(body)["name"]
        if len(name) % 3 == 0:
            raise RuntimeError("rate limited")
        out.append(f'Sure! {{"name": "{name}_enriched", "dataset_description": "table {name}",}} Done.')
    return out


def _enrich_oracle():
    tabs = ", ".join(f"'{t}'" for t in LAKE_TABLES)
    return f"""
SELECT table_name AS name,
  CASE WHEN length(table_name) % 3 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN length(table_name) % 3 = 0 THEN NULL ELSE table_name || '_enriched' END AS display_name,
  CASE WHEN length(table_name) % 3 = 0 THEN NULL ELSE 'table ' || table_name END AS model_description,
  CASE WHEN length(table_name) % 3 = 0 THEN 'failed' ELSE 'ok' END AS prose_status,
  CASE WHEN length(table_name) % 3 = 0 THEN 'LLM call failed; no enriched summary generated. Error details: RuntimeError: rate limited'
       ELSE 'Sure! {{"name": "' || table_name || '_enriched", "dataset_description": "table ' || table_name || '",}} Done.' END AS enriched_text
FROM (SELECT DISTINCT table_name FROM information_schema.columns WHERE table_name IN ({tabs}))"""


@query("enrich_model", _enrich_oracle())
def q_enrich_model(spark, sf_dir):
    from lakesonar.operators.enrich import enrich_prose, enrich_structured
    from lakesonar.operators.summary import summarize, summary_json
    from lakesonar.plans.lake_search import INSTRUCTION, materialize
    s = materialize(summarize(profile(read_lake(spark, sf_dir))))
    st = enrich_structured(s, fake_enricher, INSTRUCTION, on_error="keep_base")
    st = st.withColumn("model_description", F.get_json_object(
        F.when(F.col("status") == "ok", F.col("enriched_json")), "$.dataset_description"))
    pr = enrich_prose(s.withColumn("json_pretty", summary_json(s, pretty=True)), fake_enricher,
                      "Enrich this summary:\n{json_summary}")
    return (st.select("name", "status", "display_name", "model_description")
            .join(pr.select("name", F.col("status").alias("prose_status"), "enriched_text"), "name"))


# --- catalog listing (S1, C1) --------------------------------------------------

@query("catalog_tables", """
SELECT table_name, count(*) AS n_columns FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
  'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations') GROUP BY table_name""")
def q_catalog_tables(spark, sf_dir):
    from lakesonar.operators.schema import catalog_columns
    from lakesonar.sources.inventory import list_tables
    for name, df in read_lake(spark, sf_dir).items():
        df.createOrReplaceTempView(f"lake_{name}")
    names = [r["table_name"] for r in list_tables(spark).filter(F.col("table_name").startswith("lake_")).collect()]
    cols = None
    for n in names:                          # catalog metadata only: one schema per table
        c = catalog_columns(spark, n)
        cols = c if cols is None else cols.unionByName(c)
    return cols.groupBy(F.regexp_replace("table_name", "^lake_", "").alias("table_name")).agg(
        F.count(F.lit(1)).alias("n_columns"))

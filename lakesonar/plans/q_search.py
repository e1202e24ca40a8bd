"""Registered retrieval, index, rerank and lake-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesonar.operators.ann import build_ivf, recall_at_k, top_k_ivf, top_k_lsh
from lakesonar.operators.embed import hashed_embedding
from lakesonar.operators.index import compact, insert_if_absent, open_index, reindex_delta, remove, upsert
from lakesonar.operators.rerank import coverage_scores, snippet
from lakesonar.operators.retrieve import top_k
from lakesonar.plans.lake_search import answer, build_index, table_questions
from lakesonar.plans.registry import LAKE_TABLES, query, read_lake, read_table
from lakesonar.session import new_table_path
from lakesonar.sources.inventory import inventory

ORACLE_DIR = "/root/testdata/sf0.01"
TIE = 9


def duck_terms(src: str, id_col: str, text_col: str) -> str:
    """DuckDB SQL of the V4 sparse vector (id, bucket, w) of ``text_col``."""
    return f"""(SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM (
  SELECT id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 256 AS bucket, count(*) AS tf FROM (
    SELECT id, substr('#' || w || '#', i::INTEGER, 3) AS g FROM (
      SELECT id, w, unnest(generate_series(1, length(w))) AS i FROM (
        SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text_col}), '[^a-z0-9]+')) AS w FROM {src})
      WHERE w <> '')) GROUP BY ALL))"""


def duck_grams(t: str) -> str:
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), "
            f"lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w)), "
            f"lambda i: substr('#' || w || '#', i::INTEGER, 3)))))")


# --- exact top-k on the embeddings table (K1-K4) -----------------------------

def _topk_oracle(metric):
    if metric == "cosine":
        d = "1 - list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[])"
        out = f"round(1 - round({d}, {TIE}), 6) AS score"
    else:
        d = "list_distance(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) ^ 2"
        out = f"round(round({d}, {TIE}), 6) AS distance"
    return f"""
SELECT query_id, rank, id, {out.replace(d, 'dd').replace('round(dd', 'round(dd')} FROM (
  SELECT q.vec_id AS query_id, x.vec_id::VARCHAR AS id, {d} AS dd,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({d}, {TIE}), x.vec_id::VARCHAR) AS rank
  FROM embeddings q, embeddings x) WHERE rank <= 3"""


@query("topk_cosine", _topk_oracle("cosine"))
def q_topk_cosine(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    h = top_k(e.select(F.col("vec_id").alias("query_id"), "embedding"),
              e.select(F.col("vec_id").cast("string").alias("id"), "embedding"), k=3, metric="cosine")
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "id",
                    F.round("score", 6).alias("score"))


@query("topk_l2", _topk_oracle("l2sq"))
def q_topk_l2(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    h = top_k(e.select(F.col("vec_id").alias("query_id"), "embedding"),
              e.select(F.col("vec_id").cast("string").alias("id"), "embedding"), k=3, metric="l2sq")
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "id",
                    F.round("distance", 6).alias("distance"))


# --- benchmark questions over documents (V4, K1) -----------------------------

@query("topk_documents", f"""
WITH dt AS {duck_terms('documents', 'doc_id', 'text')},
bt AS {duck_terms('benchmark', 'item_id', 'text')},
s AS (SELECT b.id AS query_id, d.id AS doc, sum(b.w * d.w) AS score FROM bt b JOIN dt d USING (bucket) GROUP BY ALL)
SELECT query_id, rank, doc::VARCHAR AS id, round(1 - round(1 - score, {TIE}), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - score, {TIE}), doc::VARCHAR) AS rank FROM s)
WHERE rank <= 3""")
def q_topk_documents(spark, sf_dir):
    t = read_lake(spark, sf_dir, ["documents", "benchmark"])
    docs = hashed_embedding(t["documents"], "doc_id", "text").select(F.col("id").cast("string").alias("id"), "embedding")
    qs = hashed_embedding(t["benchmark"], "item_id", "text").withColumnRenamed("id", "query_id")
    h = top_k(qs, docs, k=3)
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


# --- index maintenance (X1-X4, X6, X7) ---------------------------------------

def _doc_batches(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    rec = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("enriched_text"),
                   F.to_json(F.struct(F.col("doc_id").cast("string").alias("name"), "source", "lang"))
                   .alias("json_summary"), "doc_id")
    emb = hashed_embedding(d, "doc_id", "text")
    rec = rec.join(emb.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    b1 = rec.filter((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0)).drop("doc_id")
    b2 = rec.filter((F.col("doc_id") % 2 == 1) | (F.col("doc_id") % 3 == 0)).drop("doc_id")
    return b1, b2


BATCHES_DUCK = """
WITH b1 AS (SELECT doc_id::VARCHAR AS id, 1 AS batch FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0),
b2 AS (SELECT doc_id::VARCHAR AS id, 2 AS batch FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0)"""


@query("index_insert_if_absent", BATCHES_DUCK + """
SELECT id, batch::BIGINT AS batch FROM b1 UNION ALL SELECT id, batch::BIGINT FROM b2 WHERE id NOT IN (SELECT id FROM b1)""")
def q_index_insert_if_absent(spark, sf_dir):
    path = new_table_path(spark, "index-insert")
    b1, b2 = _doc_batches(spark, sf_dir)
    insert_if_absent(spark, path, b1, batch=1)
    insert_if_absent(spark, path, b1, batch=1)     # idempotent: nothing added
    insert_if_absent(spark, path, b2, batch=2)
    return open_index(spark, path).select("id", "batch")


@query("index_upsert", BATCHES_DUCK + """
SELECT id, batch::BIGINT AS batch FROM b2 UNION ALL SELECT id, batch::BIGINT FROM b1 WHERE id NOT IN (SELECT id FROM b2)""")
def q_index_upsert(spark, sf_dir):
    path = new_table_path(spark, "index-upsert")
    b1, b2 = _doc_batches(spark, sf_dir)
    upsert(spark, path, b1, batch=1)
    upsert(spark, path, b2, batch=2)
    return open_index(spark, path).select("id", "batch")


@query("index_deltas", f"""
WITH t AS {duck_terms('documents', 'doc_id', 'text')},
v AS (SELECT id, round(sum((bucket + 1) * w), 6) AS checksum FROM t GROUP BY id)
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS batch,
  'ok' AS status, checksum, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes
FROM documents LEFT JOIN v ON v.id = doc_id WHERE doc_id % 10 <> 0""")
def q_index_deltas(spark, sf_dir):
    """Rows as stored after two upserts, a removal, a rewrite of the touched buckets and a last delta."""
    path = new_table_path(spark, "index-deltas")
    b1, b2 = _doc_batches(spark, sf_dir)
    upsert(spark, path, b1, batch=1)
    gone = b1.union(b2).filter(F.col("id").cast("long") % 10 == 0)
    remove(spark, path, gone)
    compact(spark, path)
    upsert(spark, path, b2.filter(F.col("id").cast("long") % 10 != 0), batch=2)
    checksum = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return open_index(spark, path).select("id", "batch", "status", F.round(checksum, 6).alias("checksum"),
                                          F.coalesce(F.octet_length("enriched_text"), F.lit(0)).cast("long").alias("n_bytes"))


@query("reindex_delta", f"""
SELECT regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '') AS table_name
FROM glob('{ORACLE_DIR}/*.parquet')
WHERE regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '') >= 'm'""")
def q_reindex_delta(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    first = inv.filter(F.col("table_name") < "m")          # an earlier, partial run
    tabs = {r["table_name"]: spark.read.parquet(r["path"]) for r in first.select("table_name", "path").collect()}
    return reindex_delta(inv, build_index(spark, tabs, inventory=first)).select("table_name")


# --- candidates, rerank and lake search (N1-N9, N8) --------------------------

@query("candidate_snippets", """
WITH c AS (SELECT conv_id AS query_id, turn + 1 AS rank, text AS enriched_text,
  CASE WHEN turn % 5 = 0 THEN to_json({'name': role || '_' || conv_id::VARCHAR, 'text': text})::VARCHAR
       WHEN turn % 5 = 1 THEN to_json({'text': text})::VARCHAR
       WHEN turn % 5 = 2 THEN '{' || text
       WHEN turn % 5 = 3 THEN '[1, 2]'
       ELSE '  ' END AS js FROM conversations),
k AS (SELECT *, CASE WHEN json_valid(js) THEN json_type(CASE WHEN json_valid(js) THEN js END) = 'OBJECT' ELSE false END AS is_obj FROM c)
SELECT query_id, rank, CASE WHEN is_obj THEN 'json' ELSE 'text' END AS kind,
  CASE WHEN is_obj THEN 'Candidate #' || rank::VARCHAR || ' - Table Name: ' || coalesce(json_extract_string(CASE WHEN is_obj THEN js END, '$.name'), 'Candidate_' || rank::VARCHAR)
       ELSE 'Candidate #' || rank::VARCHAR || ' - ' || enriched_text END AS header
FROM k""")
def q_candidate_snippets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    js = (F.when(F.col("turn") % 5 == 0, F.to_json(F.struct(
        F.concat("role", F.lit("_"), F.col("conv_id").cast("string")).alias("name"), "text")))
        .when(F.col("turn") % 5 == 1, F.to_json(F.struct("text")))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit("{"), "text"))
        .when(F.col("turn") % 5 == 3, F.lit("[1, 2]"))
        .otherwise(F.lit("  ")))
    cands = c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"),
                     F.col("text").alias("enriched_text"), js.alias("json_summary"))
    s = cands.withColumn("snippet", snippet())
    is_json = F.col("snippet").contains(" - Table Name: ") & F.col("json_summary").startswith("{") \
        & F.try_parse_json("json_summary").isNotNull()
    first_line = F.when(is_json, F.substring_index("snippet", "\n", 1)).otherwise(F.col("snippet"))
    return s.select("query_id", "rank", F.when(is_json, "json").otherwise("text").alias("kind"),
                    first_line.alias("header"))


def _search_oracle(what: str) -> str:
    tabs = ", ".join(f"'{t}'" for t in LAKE_TABLES)
    base = f"""
WITH cols AS (SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ({tabs})),
idx AS (SELECT table_name AS id, table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal_position) AS txt FROM cols GROUP BY table_name),
qs AS (SELECT row_number() OVER (ORDER BY table_name) AS query_id, table_name AS expected_table,
  'Which table has ' || string_agg(regexp_replace(column_name, '^[a-z]+_', ''), ' and ' ORDER BY ordinal_position) AS query
  FROM cols WHERE ordinal_position >= 2 GROUP BY table_name),
it AS {duck_terms('idx', 'id', 'txt')},
qt AS {duck_terms('qs', 'query_id', 'query')},
sc AS (SELECT q.id AS query_id, d.id AS id, sum(q.w * d.w) AS score FROM qt q JOIN it d USING (bucket) GROUP BY ALL),
al AS (SELECT qs.query_id, idx.id, coalesce(sc.score, 0) AS score FROM qs CROSS JOIN idx LEFT JOIN sc ON sc.query_id = qs.query_id AND sc.id = idx.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - score, {TIE}), id) AS rank FROM al) WHERE rank <= 3),
cov AS (SELECT h.query_id, h.rank, h.id, qs.query, qs.expected_table,
  CASE WHEN len({duck_grams('qs.query')}) > 0 THEN len(list_intersect({duck_grams('qs.query')}, {duck_grams('idx.txt')}))
       / len({duck_grams('qs.query')}) ELSE 0 END AS coverage
  FROM hits h JOIN qs USING (query_id) JOIN idx ON idx.id = h.id)"""
    if what == "coverage":
        return base + "\nSELECT query_id, rank, id, round(coverage, 6) AS coverage FROM cov"
    if what == "base":
        return base
    return base + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, rank) AS r FROM cov) WHERE r = 1),
tops AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS top_ids FROM cov GROUP BY query_id)
SELECT b.query_id, b.query, b.expected_table, b.id AS best_table_name, t.top_ids, true AS in_candidates,
       b.id = b.expected_table AS is_correct
FROM best b JOIN tops t USING (query_id)"""


@query("rerank_coverage", _search_oracle("coverage"))
def q_rerank_coverage(spark, sf_dir):
    tabs = read_lake(spark, sf_dir)
    qs = table_questions(tabs)
    idx = build_index(spark, tabs)
    q_emb = hashed_embedding(qs, "query_id", "query").withColumnRenamed("id", "query_id")
    hits = top_k(q_emb, idx.select("id", "embedding"), k=3)
    hits = hits.join(qs, "query_id").join(idx.select("id", "enriched_text"), "id")
    return coverage_scores(hits).select("query_id", F.col("rank").cast("long").alias("rank"), "id",
                                        F.round("coverage", 6).alias("coverage"))


@query("lake_search", _search_oracle("answer"))
def q_lake_search(spark, sf_dir):
    tabs = read_lake(spark, sf_dir)
    qs = table_questions(tabs)
    idx = build_index(spark, tabs)
    a = answer(qs, idx, k=3).join(qs.select("query_id", "expected_table"), "query_id")
    return a.select("query_id", "query", "expected_table", "best_table_name",
                    F.array_join(F.transform("top_k", lambda x: x["id"]), ",").alias("top_ids"),
                    "in_candidates", (F.col("best_table_name") == F.col("expected_table")).alias("is_correct"))


@query("answer_hits", _search_oracle("base") + """
SELECT c.query_id, c.rank, c.id, idx.txt AS enriched_text, c.id AS summary_name FROM cov c JOIN idx ON idx.id = c.id""")
def q_answer_hits(spark, sf_dir):
    """Every hit of an answer with its indexed text and its summary."""
    tabs = read_lake(spark, sf_dir)
    a = answer(table_questions(tabs), build_index(spark, tabs, exact="auto"), k=3).select("query_id", F.inline("top_k"))
    return a.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "enriched_text",
                    F.get_json_object("json_summary", "$.name").alias("summary_name"))


@query("topk_few", """
SELECT q.vec_id AS query_id, x.vec_id::VARCHAR AS id, (SELECT count(*) FROM embeddings WHERE label = 3) AS n_hits
FROM embeddings q, embeddings x WHERE x.label = 3 AND q.label < 3""")
def q_topk_few(spark, sf_dir):
    """K3: more neighbours asked for than the index has rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    h = top_k(e.filter("label < 3").select(F.col("vec_id").alias("query_id"), "embedding"),
              e.filter("label = 3").select(F.col("vec_id").cast("string").alias("id"), "embedding"), k=1_000_000, counted="n_hits")
    return h.select("query_id", "id", F.col("n_hits").cast("long").alias("n_hits"))


# --- approximate search (K5) -------------------------------------------------

def _vectors(spark, sf_dir):
    """The embeddings as an index and as questions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return (e.select(F.col("vec_id").cast("string").alias("id"), "embedding"),
            e.select(F.col("vec_id").alias("query_id"), "embedding"))


# The vectors of this table have no clusters, so a question has to read most cells or buckets.
IVF = {"k": 3, "n_probe": 7}
LSH = {"k": 3, "tables": 6, "per_key": 1, "bucket_length": 0.3}


def _with_recall(approx, idx, qs, extra):
    approx = approx.checkpoint(eager=True)  # at most k rows a question, read twice
    r = recall_at_k(approx, top_k(qs, idx, k=3))
    return approx.join(r, "query_id").select("query_id", "rank", "id", F.round("score", 6).alias("score"), extra,
                                             F.round("recall", 6).alias("recall"))


@query("topk_ivf")
def q_topk_ivf(spark, sf_dir):
    idx, qs = _vectors(spark, sf_dir)
    celled, cells = build_ivf(idx, n_cells=8)
    return _with_recall(top_k_ivf(qs, celled, cells, **IVF), idx, qs, "n_cells")


@query("topk_ivf_bounded", _topk_oracle("cosine"))
def q_topk_ivf_bounded(spark, sf_dir):
    idx, qs = _vectors(spark, sf_dir)
    celled, cells = build_ivf(idx, n_cells=8)
    h = top_k_ivf(qs, celled, cells, k=3, n_probe=2, bound=True)
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query("topk_lsh")
def q_topk_lsh(spark, sf_dir):
    idx, qs = _vectors(spark, sf_dir)
    return _with_recall(top_k_lsh(qs, idx, **LSH), idx, qs, "n_candidates")


@query("ann_recall", """
SELECT method, (SELECT count(*) FROM embeddings) AS n_questions, at_least, true AS reached
FROM (VALUES ('ivf', 0.95::DOUBLE), ('ivf bounded', 1.0::DOUBLE), ('lsh', 0.9::DOUBLE)) m(method, at_least)""")
def q_ann_recall(spark, sf_dir):
    """Mean recall at 3 of the approximate searches against the exact one, every vector a question."""
    idx, qs = _vectors(spark, sf_dir)
    celled, cells = build_ivf(idx, n_cells=8)
    exact = top_k(qs, idx, k=3).checkpoint(eager=True)  # read by each method
    out = None
    for method, at_least, approx in (("ivf", 0.95, top_k_ivf(qs, celled, cells, **IVF)),
                                     ("ivf bounded", 1.0, top_k_ivf(qs, celled, cells, k=3, n_probe=2, bound=True)),
                                     ("lsh", 0.9, top_k_lsh(qs, idx, **LSH))):
        one = recall_at_k(approx, exact).agg(F.count(F.lit(1)).alias("n_questions"), F.avg("recall").alias("recall")).select(
            F.lit(method).alias("method"), "n_questions", F.lit(at_least).alias("at_least"), (F.col("recall") >= at_least).alias("reached"))
        out = one if out is None else out.union(one)
    return out


# --- rerank through a model (N2-N7) ------------------------------------------

# A rerank prompt with the question and candidate slots.
RERANK_TEMPLATE = "Question: {q}\n\nCandidates:\n{s}\n\nName one candidate that answers it."


def fake_reranker(prompts):
    """Stand-in model: fails on questions of even length, names a table that is
    no candidate where 3 divides the length, else answers with the first candidate."""
    import re as _re
    out = []
    for p in prompts:
        q = p.split("Question: ", 1)[1].split("\n", 1)[0]
        if len(q) % 2 == 0:
            raise RuntimeError("overloaded")
        m = _re.search(r"Candidate #1 - Table Name: (\S+)", p)
        out.append("Best table: elsewhere" if len(q) % 3 == 0 else f"Best table: {m.group(1)}")
    return out


def _rerank_model_oracle():
    base = _search_oracle("base")
    return base + """
SELECT c.query_id, CASE WHEN length(c.query) % 2 = 0 THEN 'UnknownTable' WHEN length(c.query) % 3 = 0 THEN 'elsewhere'
       ELSE c.id END AS best_table_name, length(c.query) % 2 <> 0 AND length(c.query) % 3 <> 0 AS in_candidates
FROM cov c WHERE c.rank = 1"""


@query("rerank_model", _rerank_model_oracle())
def q_rerank_model(spark, sf_dir):
    from lakesonar.plans.lake_search import answer_with_model
    tabs = read_lake(spark, sf_dir)
    qs = table_questions(tabs)
    a = answer_with_model(qs, build_index(spark, tabs), fake_reranker, RERANK_TEMPLATE)
    return a.select("query_id", "best_table_name", "in_candidates")


# --- an index built with a user's models (V1-V3, E1, J2) -----------------------

LETTERS_ID = "letter-counts"


def letter_vectors(texts):
    """Stand-in embedding model: how often each letter occurs."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def describing_model(prompts):
    """Stand-in model for enrichment: describes the table and its first column in prose around
    JSON with a trailing comma; fails when the table name's length is divisible by 3."""
    import json
    out = []
    for p in prompts:
        s = json.loads(p[p.index("{"):])
        if len(s["name"]) % 3 == 0:
            raise RuntimeError("rate limited")
        out.append(f'Sure! {{"name": "{s["name"]}", "dataset_description": "about {s["name"]}", "fields": [{{"column": '
                   f'"{s["field_names"][0]}", "properties": {{"semantic_type": "key", "description": "first"}}}}],}} Done.')
    return out


@query("index_with_model")
def q_index_with_model(spark, sf_dir):
    """One row per table: its index record, and the table found for its question with the
    same embedding model. No oracle (summary texts): see tests/test_search.py."""
    tabs = read_lake(spark, sf_dir)
    idx = build_index(spark, tabs, embed_fn=letter_vectors, model_id=LETTERS_ID, model_fn=describing_model)
    found = answer(table_questions(tabs), idx, k=len(LAKE_TABLES), embed_fn=letter_vectors, model_id=LETTERS_ID)
    asked = table_questions(tabs).select("query_id", F.col("expected_table").alias("id"))
    return idx.select("id", "status", "model_id", "embedding", "norm", "enriched_text", "json_summary").join(
        asked.join(found.select("query_id", "best_table_name", "top_k"), "query_id"), "id", "left").drop("query_id")

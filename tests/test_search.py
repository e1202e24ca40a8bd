import numpy as np
from pyspark.sql import functions as F

from lakesonar.operators.index import insert_if_absent, open_index, upsert, index_exists
from lakesonar.operators.rerank import snippet
from lakesonar.operators.retrieve import top_k
from lakesonar.session import new_table_path

SF = "/root/testdata/sf0.001"


def test_topk_order_ties_and_metrics(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    qs = e.filter(F.col("vec_id") < 5).select(F.col("vec_id").alias("query_id"), "embedding")
    idx = e.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    cos = top_k(qs, idx, k=4, metric="cosine").collect()
    l2 = top_k(qs, idx, k=4, metric="l2sq").collect()
    by = {}
    for r in cos:
        by.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q, hs in by.items():
        hs.sort()
        assert [h[0] for h in hs] == [1, 2, 3, 4]
        assert all(hs[i][1] <= hs[i + 1][1] for i in range(3))
        assert hs[0][2] == str(q)                  # a vector is its own nearest
    # unit vectors: cosine and l2 rank the same
    a = sorted((r["query_id"], r["rank"], r["id"]) for r in cos)
    b = sorted((r["query_id"], r["rank"], r["id"]) for r in l2)
    assert a == b


def test_topk_brute_force_and_chunks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    ids = [str(r["vec_id"]) for r in rows]
    qs = e.filter(F.col("label") == 3).select(F.col("vec_id").alias("query_id"), "embedding")
    got = top_k(qs, e.select(F.col("vec_id").cast("string").alias("id"), "embedding"), k=3,
                max_broadcast_bytes=1024).collect()   # forces several question chunks
    xn = x / np.linalg.norm(x, axis=1)[:, None]
    for q in {r["query_id"] for r in got}:
        qi = [i for i, r in enumerate(rows) if r["vec_id"] == q][0]
        d = np.round(1 - xn @ xn[qi], 9)
        order = sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))[:3]
        mine = [r["id"] for r in sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])]
        assert mine == [ids[i] for i in order]


def test_topk_fewer_than_k(spark):
    idx = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<double>")
    got = top_k(qs, idx, k=5).collect()
    assert sorted(r["id"] for r in got) == ["a", "b"]


def test_no_cross_join_in_topk_plan(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    h = top_k(e.select(F.col("vec_id").alias("query_id"), "embedding"),
              e.select(F.col("vec_id").cast("string").alias("id"), "embedding"), k=3)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_index_idempotent_and_upsert(spark):
    recs1 = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("a", "v1-dup")], "id string, json_summary string")
    recs2 = spark.createDataFrame([("b", "v2"), ("c", "v2")], "id string, json_summary string")
    p = new_table_path(spark, "t-index")
    assert not index_exists(spark, p)
    insert_if_absent(spark, p, recs1, batch=1)
    insert_if_absent(spark, p, recs1, batch=1)
    once = sorted((r["id"], r["json_summary"]) for r in open_index(spark, p).collect())
    assert [i for i, _ in once] == ["a", "b"]              # in-batch duplicate removed, second insert no-op
    insert_if_absent(spark, p, recs2, batch=2)
    got = {r["id"]: r["json_summary"] for r in open_index(spark, p).collect()}
    assert got["b"] == "v1" and got["c"] == "v2"           # repeated id ignored (X4)
    q = new_table_path(spark, "t-upsert")
    upsert(spark, q, recs1, batch=1)
    upsert(spark, q, recs2, batch=2)
    got = {r["id"]: r["json_summary"] for r in open_index(spark, q).collect()}
    assert got["b"] == "v2" and set(got) == {"a", "b", "c"}
    assert index_exists(spark, q)


def _files(path):
    import os
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    import pytest
    from lakesonar.operators import index as ix
    p = str(tmp_path / "idx")

    def recs(pairs):
        return spark.createDataFrame(pairs, "id string, json_summary string")

    def rows():
        return {r["id"]: r["json_summary"] for r in open_index(spark, p).collect()}

    ix.create_index(spark, p, buckets=40)
    assert not index_exists(spark, p)
    upsert(spark, p, recs([(f"r{i}", "v1") for i in range(300)]))
    touched = ix.compact(spark, p)
    state = ix.commit_of(spark, p)
    assert len(touched) > 30 and not state["deltas"] and set(map(int, state["base"])) == set(touched)
    before = _files(p)
    upsert(spark, p, recs([("r1", "v2"), ("new", "v2")]))
    assert len(_files(p) - before) <= 2 and before <= _files(p)     # a write of two rows writes those
    ix.remove(spark, p, recs([("r2", "")]).select("id"))
    want = {f"r{i}": "v1" for i in range(300) if i != 2} | {"r1": "v2", "new": "v2"}
    assert rows() == want
    touched = ix.compact(spark, p)
    after = ix.commit_of(spark, p)
    assert 1 <= len(touched) <= 3 and rows() == want
    same = {b for b in state["base"] if after["base"].get(b) == state["base"][b]}
    assert same == set(state["base"]) - set(map(str, touched))       # all other buckets keep their files
    ix.vacuum(spark, p)
    assert rows() == want and len(_files(p)) == len(after["base"])
    for i in range(3):                                               # deltas are put into buckets by themselves
        upsert(spark, p, recs([("r5", f"w{i}")]), max_deltas=2)
    assert not ix.commit_of(spark, p)["deltas"] and rows()["r5"] == "w2"
    with pytest.raises(RuntimeError):                                # a lost race is an error
        ix._commit(spark, p, after)


def test_snippets(spark):
    rows = [(1, '{"name": "orders", "x": 1}', "t1"), (2, '{"x": 1}', "t2"), (3, '{"name": null}', "t3"),
            (4, "[1, 2]", "t4"), (5, "   ", "t5"), (6, "{broken", "t6")]
    df = spark.createDataFrame(rows, "rank int, json_summary string, enriched_text string")
    s = dict(df.select("rank", snippet()).collect())
    assert s[1].startswith("Candidate #1 - Table Name: orders\n")
    assert s[2].startswith("Candidate #2 - Table Name: Candidate_2\n")
    assert s[3].startswith("Candidate #3 - Table Name: Candidate_3\n")   # null name falls back (Q16)
    assert s[4] == "Candidate #4 - t4" and s[5] == "Candidate #5 - t5" and s[6] == "Candidate #6 - t6"


def test_model_failures_isolated(spark):
    from lakesonar.operators.enrich import call_model

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("boom")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("ok1",), ("bad",), ("ok2",)], "p string")
    out = {r["p"]: (r["reply"], r["error"]) for r in call_model(df, "p", model).collect()}
    assert out["ok1"] == ("OK1", None) and out["ok2"] == ("OK2", None)
    assert out["bad"][0] is None and "boom" in out["bad"][1]


def test_known_prompts_are_not_called_again(spark, tmp_path):
    from lakesonar.operators.enrich import call_model_stored, enrich_prose, enrich_structured, stored_replies
    log, path = tmp_path / "calls", str(tmp_path / "replies")
    log.mkdir()

    def model(prompts):
        import uuid
        (log / uuid.uuid4().hex).write_text("\n".join(prompts))
        if any(p.startswith("bad") for p in prompts):
            raise RuntimeError("no")
        return [f"{{\"name\": \"{p}\"}}" for p in prompts]

    def called():
        out = sorted(p for f in log.iterdir() for p in f.read_text().split("\n") if p)
        for f in log.iterdir():
            f.unlink()
        return out

    one = spark.createDataFrame([("a",), ("a",), ("b",), ("bad",), (None,)], "p string").repartition(3)
    got = call_model_stored(one, "p", model, path, "m", run=1)
    rows = sorted(((r["p"], r["reply"], r["error"]) for r in got.collect()), key=str)
    assert rows == sorted([("a", '{"name": "a"}', None)] * 2 + [("b", '{"name": "b"}', None), ("bad", None, "RuntimeError: no"), (None, None, None)], key=str)
    assert set(called()) == {"a", "b", "bad"}
    two = spark.createDataFrame([("a",), ("c",), ("bad",)], "p string")
    again = {r["p"]: (r["reply"], r["error"]) for r in call_model_stored(two, "p", model, path, "m", run=2).collect()}
    assert again["a"] == ('{"name": "a"}', None) and again["bad"][1] == "RuntimeError: no"
    assert set(called()) == {"c", "bad"}                               # the answered prompt is known, the failed one is tried again
    assert [(r["run"], r["prompt"]) for r in stored_replies(spark, path, "errors").orderBy("run").collect()] == [(1, "bad"), (2, "bad")]
    other = call_model_stored(two.filter("p = 'a'"), "p", model, path, "another model", run=3)
    assert other.first()["reply"] == '{"name": "a"}' and called() == ["a"]   # another model's replies are its own
    s = spark.createDataFrame([("x", "X")], "name string, json_summary string").withColumn("json_pretty", F.col("json_summary"))
    for _ in range(2):
        assert enrich_prose(s, model, "tell {json_summary}", replies=(path, "m")).first()["status"] == "ok"
        assert enrich_structured(s, model, "do", replies=(path, "m")).first()["status"] in ("ok", "failed")
    assert sorted(called()) == ["X", "do", "tell X"]                    # each prompt once; the second one has two lines


def test_bad_reply_can_fail_the_job(spark):
    import pytest
    from lakesonar.operators.enrich import enrich_structured
    s = spark.createDataFrame([("x", "{}")], "name string, json_summary string")
    assert enrich_structured(s, lambda ps: ["no json"] * len(ps), "do").first()["status"] == "failed"
    with pytest.raises(Exception, match="on_error"):
        enrich_structured(s, lambda ps: ["no json"] * len(ps), "do", on_error="raise").collect()


def test_dimension_is_checked(spark):
    import pytest
    from lakesonar.plans.lake_search import answer, check_model
    idx = spark.createDataFrame([("a", [1.0, 2.0], "m", "t", "{}"), ("b", None, "m", "t", "{}")],
                                "id string, embedding array<double>, model_id string, enriched_text string, json_summary string")
    assert check_model(idx, "m") == 2
    qs = spark.createDataFrame([(1, "x")], "query_id long, query string")
    with pytest.raises(ValueError, match="dimensions"):
        answer(qs, idx, embed_fn=lambda ts: [[1.0, 2.0, 3.0] for _ in ts], model_id="m")
    mixed = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, embedding array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        check_model(mixed)


def test_embedding_calls_are_bounded(spark):
    from lakesonar.operators.embed import EMBED_BATCH, embed_with
    df = spark.range(500).selectExpr("CAST(id AS string) AS t").coalesce(1)
    sizes = embed_with(df, "t", lambda ts: [[float(len(ts))] for _ in ts]).selectExpr("embedding[0] AS n").distinct().collect()
    assert max(r["n"] for r in sizes) == EMBED_BATCH


def test_lake_search_end_to_end(spark):
    from lakesonar.plans.lake_search import lake_search, table_questions
    from lakesonar.plans.registry import read_lake
    tabs = read_lake(spark, SF)
    a = lake_search(spark, tabs).join(table_questions(tabs).select("query_id", "expected_table"), "query_id")
    rows = a.collect()
    assert len(rows) == 14
    assert all(r["in_candidates"] for r in rows)
    assert sum(r["best_table_name"] == r["expected_table"] for r in rows) >= 10


def _clustered(spark, n=1200, dim=16, clusters=12, seed=4):
    """Vectors around a few centers, and some of them, moved a little, as questions."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim)) * 3
    x = centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.15
    idx = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    q = x[::40] + rng.normal(size=x[::40].shape) * 0.05
    return idx, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")


def _hits(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


def test_bounded_cells_are_exact_and_skip_cells(spark):
    from lakesonar.operators.ann import build_ivf, top_k_ivf
    idx, qs = _clustered(spark)
    for metric in ("cosine", "l2sq"):
        celled, cells = build_ivf(idx, n_cells=12, metric=metric)
        got = top_k_ivf(qs, celled, cells, k=5, n_probe=1, bound=True)
        assert _hits(got) == _hits(top_k(qs, idx, k=5, metric=metric))
        assert got.agg(F.max("n_cells")).first()[0] < 6            # the bound rules cells out
        small = top_k_ivf(qs, celled, cells, k=5, n_probe=1, bound=True, max_broadcast_bytes=16 * 8 * 20)  # salted cells, question chunks
        assert _hits(small) == _hits(got)


def test_bounded_cells_without_clusters_and_with_few_rows(spark):
    from lakesonar.operators.ann import build_ivf, top_k_ivf
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    idx = e.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    qs = e.filter("label < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    celled, cells = build_ivf(idx, n_cells=5)
    assert _hits(top_k_ivf(qs, celled, cells, k=4, n_probe=1, bound=True)) == _hits(top_k(qs, idx, k=4))
    assert _hits(top_k_ivf(qs, celled, cells, k=4, n_probe=5)) == _hits(top_k(qs, idx, k=4))  # all cells: exact
    few = top_k_ivf(qs, celled, cells, k=300, n_probe=1, bound=True)     # fewer rows than k: every cell is read
    assert few.count() == qs.count() * 200


def test_only_probed_cells_are_read(spark):
    from lakesonar.operators import ann
    idx, qs = _clustered(spark)
    celled, cells = ann.build_ivf(idx, n_cells=12)
    one, dim = ann._asked(qs.limit(1), "query_id", "embedding", "cosine")
    asked = ann.probed_cells(one, cells, 2).checkpoint(eager=True)
    hits, n_asked = ann._joined(asked, celled, cells, 3, dim, 1 << 20)
    assert len(n_asked) == 2
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [cell" in plan and " ".join(map(str, sorted(n_asked))).replace(" ", ",") in plan


def test_lsh_recall_and_candidates(spark):
    from lakesonar.operators.ann import recall_at_k, top_k_lsh
    idx, qs = _clustered(spark)
    exact = top_k(qs, idx, k=3)
    got = top_k_lsh(qs, idx, k=3, tables=12, per_key=3, bucket_length=0.4)
    assert recall_at_k(got, exact).agg(F.avg("recall")).first()[0] >= 0.9
    r = got.groupBy("query_id").agg(F.max("n_candidates").alias("n"), F.count("id").alias("k"), F.countDistinct("id").alias("d")).collect()
    assert all(x["k"] == x["d"] for x in r) and np.mean([x["n"] for x in r]) < 12 * 1200 / 3
    small = top_k_lsh(qs, idx, k=3, tables=12, per_key=3, bucket_length=0.4, max_broadcast_bytes=16 * 8 * 30)
    assert _hits(small) == _hits(got)
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert top_k_lsh(none, idx).count() == 0


def test_ann_ties_nulls_and_zero_vectors(spark):
    from lakesonar.operators.ann import build_ivf, top_k_ivf, top_k_lsh
    rows = [(f"r{i:02d}", [1.0, 0.0]) for i in range(20)] + [("z", [0.0, 1.0]), ("n", None), ("o", [0.0, 0.0])]
    idx = spark.createDataFrame(rows, "id string, embedding array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "query_id long, embedding array<double>")
    celled, cells = build_ivf(idx, n_cells=2)
    got = _hits(top_k_ivf(qs, celled, cells, k=2, n_probe=1, bound=True))
    assert got == [(1, 1, "r00"), (1, 2, "r01"), (2, 1, "z"), (2, 2, "r00")]
    assert [h for h in _hits(top_k_lsh(qs, idx, k=2)) if h[1] == 1] == [(1, 1, "r00"), (2, 1, "z")]


def test_model_mismatch_refused(spark):
    import pytest
    from lakesonar.plans.lake_search import check_model
    idx = spark.createDataFrame([("a", "other-model")], "id string, model_id string")
    with pytest.raises(ValueError):
        check_model(idx)
    check_model(spark.createDataFrame([("a", None)], "id string, model_id string"))


def test_topk_grid_plan_matches_broadcast_plan(spark):
    """Beyond the broadcast budget the block grid (cogroup) gives the same hits,
    with no nested-loop join and no per-chunk driver collect."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    qs = e.select(F.col("vec_id").alias("query_id"), "embedding")
    idx = e.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    for metric in ("cosine", "l2sq"):
        small = top_k(qs, idx, k=3, metric=metric, max_broadcast_bytes=4096)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in small.collect())
        ref = sorted((r["query_id"], r["rank"], r["id"])
                     for r in top_k(qs, idx, k=3, metric=metric).collect())
        assert got == ref


def test_topk_ties_break_by_id_on_both_plans(spark):
    """Identical vectors tie exactly; the k smallest ids win, whichever plan runs."""
    ids = [f"r{i:02d}" for i in range(40)]
    rows = [(i, [1.0, 0.0, 0.0]) for i in reversed(ids)] + [("z", [0.0, 1.0, 0.0])]
    idx = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    qs = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.5, 0.5, 0.0])],
                               "query_id long, embedding array<double>")
    for budget in (1 << 20, 16):                       # broadcast, then the block grid
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in top_k(qs, idx, k=3, max_broadcast_bytes=budget).collect())
        assert got == [(1, 1, "r00"), (1, 2, "r01"), (1, 3, "r02"),
                       (2, 1, "z"), (2, 2, "r00"), (2, 3, "r01"),
                       (3, 1, "r00"), (3, 2, "r01"), (3, 3, "r02")]


def test_topk_skips_rows_without_vectors(spark):
    idx = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])],
                                "id string, embedding array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.2]), (2, None)], "query_id long, embedding array<double>")
    for budget in (1 << 20, 8):
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in top_k(qs, idx, k=3, max_broadcast_bytes=budget).collect())
        assert got == [(1, 1, "a"), (1, 2, "c")]


def test_null_summary_keeps_its_record(spark, tmp_path):
    from lakesonar.operators.index import upsert
    rec = spark.createDataFrame([("a", [1.0, 0.0], None, "failed")], "id string, embedding array<double>, json_summary string, status string")
    row = upsert(spark, str(tmp_path / "idx"), rec).first()
    assert row["embedding"] == [1.0, 0.0] and row["status"] == "failed" and row["indexed_at"] is not None


def test_every_question_is_answered(spark):
    from lakesonar.plans.lake_search import answer, build_index
    idx = build_index(spark, {"region": spark.createDataFrame([(1, "x")], "r_key int, r_name string")})
    qs = spark.createDataFrame([("q1", "r name"), ("q2", "???"), ("q3", "")], "query_id string, query string")
    got = {r["query_id"]: r for r in answer(qs, idx).collect()}
    assert got["q1"]["best_table_name"] == "region" and got["q1"]["in_candidates"]
    assert all(got[q]["best_table_name"] == "UnknownTable" and got[q]["top_k"] == [] for q in ("q2", "q3"))


def test_snippet_is_indented_in_key_order(spark):
    df = spark.createDataFrame([(1, '{"name": "t", "fields": [{"column": "b", "a": 1}]}', "x")],
                               "rank int, json_summary string, enriched_text string")
    text = df.select(snippet().alias("s")).first()["s"]
    assert text == ('Candidate #1 - Table Name: t\n{\n  "name": "t",\n  "fields": [\n    {\n      "column": "b",\n'
                    '      "a": 1\n    }\n  ]\n}')


def test_boolean_samples_are_json_booleans(spark):
    import json
    from lakesonar.plans.lake_search import build_summaries
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    js = json.loads(build_summaries({"t": df}).first()["json_summary"])
    assert sorted(js["fields"][0]["properties"]["samples"]) == [False, True]


def test_index_with_a_users_models(spark):
    import json
    import pytest
    from lakesonar.plans import q_search as q
    from lakesonar.plans.lake_search import answer, build_summaries
    from lakesonar.plans.registry import LAKE_TABLES, read_lake
    sf = "/root/testdata/sf0.001"
    base = {r.name: json.loads(r.json_summary) for r in build_summaries(read_lake(spark, sf)).collect()}
    got = {r.id: r for r in q.q_index_with_model(spark, sf).collect()}
    assert got.keys() == LAKE_TABLES.keys()
    for t, r in got.items():
        s, want = json.loads(r.json_summary), base[t]
        text = " ".join([t, *[c for c, _ in LAKE_TABLES[t]]])
        assert r.status == ("base" if len(t) % 3 == 0 else "ok")
        if r.status == "ok":
            want["dataset_description"] = f"about {t}"
            want["fields"][0]["properties"].update(semantic_type="key", description="first")
            text += f" about {t}"
        assert s == want and r.enriched_text == text and r.model_id == q.LETTERS_ID
        v = q.letter_vectors([text])[0]
        assert r.embedding == v and abs(r.norm - sum(x * x for x in v) ** 0.5) < 1e-9
        assert r.top_k is None or len(r.top_k) == len(LAKE_TABLES)  # base records are searched too
    idx = spark.createDataFrame([("a", [1.0] * 26, q.LETTERS_ID)], "id string, embedding array<double>, model_id string")
    qs = spark.createDataFrame([(1, "x")], "query_id long, query string")
    with pytest.raises(ValueError):
        answer(qs, idx)
    with pytest.raises(ValueError):
        answer(qs, idx, embed_fn=q.letter_vectors)


def test_many_hits_come_in_bounded_frames():
    """all rows asked for, in frames that do not grow with questions times rows; F7, F8: as a full sort has them."""
    import numpy as np
    from lakesonar.operators import retrieve as R
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (4500, 4)).astype(float)
    ids = np.array([str(i) for i in range(len(x))], dtype=object)
    for metric in ("cosine", "l2sq"):
        q_ids, q, q_sq = R._prepare_questions([f"q{i}" for i in range(200)], list(x[:200]), metric)
        frames = list(R._score_topk(q_ids, q, q_sq, 1_000_000, metric, ids, x))
        assert max(map(len, frames)) <= R.OUT_ROWS and len(frames) > 1
        whole = [t for f in frames for t in zip(f["query_id"], f["distance"], f["id"])]
        best = [t for f in R._score_topk(q_ids, q, q_sq, 3, metric, ids, x) for t in zip(f["query_id"], f["distance"], f["id"])]
        want = [t for n in q_ids for t in sorted(t for t in whole if t[0] == n)[:3]]
        assert best == want


def test_groups_do_not_grow_with_the_input():
    """A group's vectors and hits stay within their budget whatever is asked for."""
    from lakesonar.operators import retrieve as R
    for dim, k in ((64, 3), (256, 3), (64, 1_000_000), (1, 50)):
        rows = R.group_rows(1 << 40, dim, k)
        assert 8 * dim * rows <= R.GROUP_BYTES and rows * min(k, rows) <= R.GROUP_HITS


def test_many_hits_are_ranked_without_a_shuffle(spark):
    """with more neighbours asked for than Spark cuts beforehand, hits never meet in a shuffle or a window;
    questions that share an id (or have none) are ranked as one, as before."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 1150:04d}", rng.normal(size=3).tolist()) for i in range(1200)] + [("zero", [0.0] * 3), (None, [1.0] * 3), ("no", None)]
    idx = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    plain = [(i, rng.normal(size=3).tolist()) for i in range(5)]
    odd = [(2, [0.1, 0.2, 0.3]), (None, [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (7, None)]
    for extra in ([], odd):
        qs = spark.createDataFrame(plain + extra, "query_id long, embedding array<double>")
        for k, metric in ((1001, "cosine"), (1_000_000, "l2sq")):
            h = top_k(qs, idx, k=k, metric=metric, counted="n")
            plan = h._jdf.queryExecution().executedPlan().toString()
            assert extra or "Window" not in plan
            got = sorted(((r["query_id"], r["rank"], r["id"], r["distance"], r["n"]) for r in h.collect()), key=str)
            want = top_k(qs, idx, k=k, metric=metric, counted="n", max_broadcast_bytes=8192).collect()  # ranked by a window
            assert got == sorted(((r["query_id"], r["rank"], r["id"], r["distance"], r["n"]) for r in want), key=str)
            assert h.columns == ["query_id", "id", "score", "distance", "rank", "n"] and len(got) >= 5 * 1001


def test_embedding_memory_does_not_grow_with_the_batch(monkeypatch):
    """a batch's texts are counted in small chunks, with the same counts as text by text."""
    import pandas as pd
    from lakesonar.operators import embed as E
    texts = pd.Series([None, "", "?!", *[f"Word {i} und mehr " * 40 for i in range(3000)], "x" * (3 << 20)])
    seen = []
    count = E._count_chunk
    monkeypatch.setattr(E, "_count_chunk", lambda t, *a: seen.append((len(t), sum(map(len, t)))) or count(t, *a))
    got = E.term_counts(texts)
    assert max(b for n, b in seen if n > 1) <= 1 << 20 and len(seen) > 2
    assert got["tf"][:3].tolist() == [None] * 3 and got["norm"][:3].isna().all()
    for i in (3, 1500, 3003):
        assert got["tf"][i].tolist() == E.term_counts(texts[i:i + 1].reset_index(drop=True))["tf"][0].tolist()

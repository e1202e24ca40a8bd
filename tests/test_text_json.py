from pyspark.sql import functions as F

from lakesonar.functions.jsonfix import extract_json, remove_trailing_commas, repair, try_parse
from lakesonar.functions.render import clean_nan_frame
from lakesonar.functions.text import best_or_unknown, parse_table_name


def test_replies(spark):
    rows = [(1, "Best table: sales.daily"), (2, "  orders_table \n\t"), (3, "a: b: c"),
            (4, "Answer: db.schema.tbl."), (5, "Table: données_ventes"), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = dict(df.select("id", parse_table_name(F.col("text")).alias("t")).collect())
    assert got[1] == "sales.daily"
    assert got[2] == "orders_table"
    assert got[3] == "b"
    assert got[4] == "db.schema.tbl."
    assert got[5] == "données_ventes"      # Unicode \w as in Python
    assert got[6] == ""
    assert got[7] is None
    failed = df.select(best_or_unknown(F.col("text"), F.col("id") == 1).alias("b")).collect()
    assert failed[0]["b"] == "UnknownTable" and failed[6]["b"] == "UnknownTable"


def test_broken_json(spark):
    rows = [(1, 'Here you go: {"a": 1, "b": [1, 2,],} thanks'), (2, '{"s": "x,}", "t": 2,}'),
            (3, "only } before {"), (4, "no json"), (5, '{"a": {"b": 1,},}')]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: r for r in df.select("id", extract_json(F.col("text")).alias("e"),
                                         repair(F.col("text")).alias("r"),
                                         try_parse(repair(F.col("text"))).isNotNull().alias("ok")).collect()}
    assert out[1]["r"] == '{"a": 1, "b": [1, 2]}' and out[1]["ok"]
    assert out[2]["r"] == '{"s": "x}", "t": 2}'           # commas inside strings too, as the reference
    assert out[3]["e"] is None and out[4]["e"] is None
    assert out[5]["ok"]


def test_clean_nan_nested(spark):
    df = spark.createDataFrame([([1.0, float("nan")], {"k": float("nan")}, (float("nan"), [float("inf")]))],
                               "a array<double>, m map<string,double>, s struct<x:double, y:array<double>>")
    r = clean_nan_frame(df).first()
    assert r["a"] == [1.0, None] and r["m"] == {"k": None}
    assert r["s"]["x"] is None and r["s"]["y"] == [float("inf")]


def test_hashed_terms_brute_force_and_map_only(spark):
    """V4 term counts equal a plain per-word computation; the plan has no exchange."""
    import hashlib
    import re
    from collections import Counter
    from lakesonar.operators.embed import HASH_DIM, hashed_embedding, hashed_terms
    texts = [(1, "Hello, World! hello"), (2, "a b#c  x1 2024-01-05"), (3, "Straße ÜBER café İstanbul"),
             (4, ""), (5, None), (6, "### ,,, !!!"), (7, "totalprice o_totalprice O_TOTALPRICE")]
    df = spark.createDataFrame(texts, "id long, text string")

    def brute(t):
        c = Counter()
        for w in re.split("[^a-z0-9]+", t.lower()):
            if w:
                p = "#" + w + "#"
                for i in range(len(w)):
                    c[int(hashlib.md5(p[i:i + 3].encode()).hexdigest()[:8], 16) % HASH_DIM] += 1
        return dict(c)
    got = {}
    for r in hashed_terms(df, "id", "text").collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["tf"]
    want = {i: brute(t) for i, t in texts if t is not None and brute(t)}
    assert got == want
    emb = hashed_embedding(df, "id", "text")
    # only spread()'s round-robin for a scan smaller than the core count; no keyed shuffle
    assert "hashpartitioning" not in emb._jdf.queryExecution().executedPlan().toString()
    vecs = {r["id"]: r["embedding"] for r in emb.collect()}
    assert set(vecs) == set(want)
    assert all(abs(sum(x * x for x in v) - 1.0) < 1e-9 and len(v) == HASH_DIM for v in vecs.values())


def test_prose_prompts_hold_the_summaries(spark):
    import hashlib
    import json
    import numpy as np
    import pandas as pd
    from lakesonar.plans.q_text import PROSE_TEMPLATE, q_enrich_prompt
    from lakesonar.plans.registry import LAKE_TABLES, NUMERIC_DUCK
    sf = "/root/testdata/sf0.001"
    got = {r.table_name: r for r in q_enrich_prompt(spark, sf).collect()}
    assert got.keys() == LAKE_TABLES.keys()
    head, tail = PROSE_TEMPLATE.split("{json_summary}")
    for t, cols in LAKE_TABLES.items():
        r, frame = got[t], pd.read_parquet(f"{sf}/{t}.parquet")
        assert r.prompt.startswith(head) and r.prompt.endswith(tail)
        assert (r.prompt_md5, r.prompt_len) == (hashlib.md5(r.prompt.encode()).hexdigest(), len(r.prompt))
        s = json.loads(r.prompt[len(head):-len(tail)])
        assert s["name"] == t and s["dataset_description"] and s["field_names"] == [c for c, _ in cols]
        for f, (c, ty) in zip(s["fields"], cols):
            p, v = f["properties"], frame[c]
            assert f["column"] == c and p["description"] and p["semantic_type"] is not None
            if ty in NUMERIC_DUCK:
                assert np.isclose(p["min"], v.min()) and np.isclose(p["max"], v.max())
                assert abs(p["std"] - v.std()) < 1
            if ty in ("INTEGER", "BIGINT", "VARCHAR"):
                texts = sorted({str(x) for x in v.dropna()}, key=lambda x: hashlib.md5(x.encode()).hexdigest())[:3]
                assert [str(x) for x in p["samples"]] == texts and p["num_unique_values"] == v.nunique()

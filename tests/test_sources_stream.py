from pyspark.sql import functions as F

from lakesonar.sources.inventory import inventory, parse_s3_path
from lakesonar.sources.scan import read_file

SF = "/root/testdata/sf0.001"


def test_inventory_prunes_content(spark):
    inv = inventory(spark, SF)
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert inv.count() == 14


def test_s3_paths(spark):
    df = spark.createDataFrame([("s3://bucket",), ("s3://bucket/",), ("s3://b/a/b/c.csv",), ("gs://x/y",)], "p string")
    got = [tuple(r) if r[0] is not None else None for r in
           df.select(parse_s3_path(F.col("p")).alias("x")).select("x.bucket", "x.prefix").collect()]
    assert got[0] == ("bucket", "") and got[1] == ("bucket", "") and got[2] == ("b", "a/b/c.csv")
    assert got[3] is None          # other schemes give no parts


def test_unsupported_format(spark):
    import pytest
    with pytest.raises(ValueError):
        read_file(spark, "/tmp/x.json")


def test_merged_stats_equal_one_shot(spark):
    from lakesonar.operators.profile import profile
    from lakesonar.streaming.stats import merge_stats, partial_stats
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    parts = partial_stats({"l": li.filter("l_linenumber <= 3")}, "a").unionByName(
        partial_stats({"l": li.filter("l_linenumber > 3")}, "b"))
    m = {r["ordinal"]: r for r in merge_stats(parts).collect()}
    p = {r["ordinal"]: r for r in profile({"l": li}).collect()}
    for o, r in p.items():
        if r["dtype"] == "number":
            assert abs(m[o]["std"] - r["std"]) < 1e-9 * max(1.0, r["std"])
            assert m[o]["min_num"] == r["min_num"] and m[o]["max_num"] == r["max_num"]
            assert m[o]["n_rows"] == r["n_rows"]


def test_partials_by_part_column_equal_separate_parts(spark):
    """A part column gives, in one job, the partials that separate parts give."""
    from lakesonar.streaming.stats import partial_stats
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    part = F.when(F.col("l_linenumber") <= 3, "a").otherwise("b")
    one = partial_stats({"l": li}, part)
    two = partial_stats({"l": li.filter("l_linenumber <= 3")}, "a").unionByName(
        partial_stats({"l": li.filter("l_linenumber > 3")}, "b"))
    cols = ["part", "table_name", "ordinal", "n_rows", "n", "min_num", "max_num"]
    assert sorted(tuple(r) for r in one.select(*cols).collect()) == \
        sorted(tuple(r) for r in two.select(*cols).collect())
    assert one.select("ordinal").distinct().count() == len(li.columns)   # part column not profiled


def test_csv_columns_infer_from_all_rows(spark):
    """C2 types a CSV by all its rows, as a whole-file read does."""
    from lakesonar.operators.schema import file_columns
    from lakesonar.session import new_table_path
    from lakesonar.sources.scan import read_file
    rows = [(i, float(i) / 2, f"n{i}") for i in range(150)] + [(150, 1.0, "x")]
    df = spark.createDataFrame(rows, "a long, b double, c string").withColumn(
        "a", F.when(F.col("a") == 150, F.lit("late text")).otherwise(F.col("a").cast("string")))
    path = new_table_path(spark, "t-csv-late")
    df.repartition(1).write.option("header", "true").csv(path)
    listed = {r["column_name"]: r["type_name"] for r in file_columns(spark, "t", path, fmt="csv").collect()}
    assert listed == {f.name: f.dataType.simpleString() for f in read_file(spark, path, fmt="csv").schema.fields}
    assert listed == {"a": "string", "b": "double", "c": "string"}


def test_default_file_of_an_empty_lake(spark, tmp_path):
    import pytest
    from lakesonar.sources.inventory import inventory, list_tables, pick_default_file
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(ValueError):
        pick_default_file(inventory(spark, str(tmp_path)))
    spark.range(1).createOrReplaceTempView("my_temp")
    assert "my_temp" not in {r["table_name"] for r in list_tables(spark, "default").collect()}


def test_stream_over_flat_csv_and_partitioned_tables(spark, tmp_path):
    from lakesonar.operators.index import open_index
    from lakesonar.sources.inventory import inventory
    from lakesonar.streaming.reindex import start_reindex
    root = tmp_path / "lake"
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    nation.coalesce(1).write.partitionBy("n_regionkey").parquet(f"{root}/nation")
    region = spark.read.parquet(f"{SF}/region.parquet").toPandas()
    region.to_parquet(f"{root}/region.parquet")
    region.to_csv(f"{root}/regions.csv", index=False)
    names = {"nation", "region", "regions"}
    assert {r["table_name"] for r in inventory(spark, str(root)).collect()} == names
    start_reindex(spark, str(root), str(tmp_path / "idx"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r["id"]: r for r in open_index(spark, str(tmp_path / "idx")).collect()}
    assert set(got) == names and all(r["source_modified_at"] is not None for r in got.values())
    assert "n_regionkey" in got["nation"]["json_summary"] and "r_name" in got["regions"]["json_summary"]


def test_csv_as_other_tools_write_it(spark, tmp_path):
    import pandas as pd
    rows = pd.DataFrame({"a": [1, 2, 3], "t": ["line one\nline two", 'say "hi", ok', ""], "x": [0.5, None, 2.0]})
    rows.to_csv(tmp_path / "t.csv", index=False)
    got = read_file(spark, str(tmp_path / "t.csv")).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "line one\nline two", 0.5), (2, 'say "hi", ok', None), (3, None, 2.0)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3,4,5\n6,7\n")
    got = read_file(spark, str(tmp_path / "bad.csv"), bad_records="_bad").orderBy("a").collect()
    assert [(r["a"], r["_bad"]) for r in got] == [(1, None), (3, "3,4,5"), (6, None)]


def _names(spark, root):
    return {(r["table_name"], r["format"]) for r in inventory(spark, str(root)).collect()}


def test_nested_mixed_and_colliding_tables(spark, tmp_path):
    from lakesonar.sources.inventory import source_names
    from lakesonar.sources.scan import read_source
    root = tmp_path / "lake"
    one = spark.createDataFrame([(1, "x"), (2, "y")], "id long, p string").coalesce(1)
    one.write.parquet(f"{root}/sales/eu/orders")
    one.write.partitionBy("p").parquet(f"{root}/sales/us/refunds")
    one.write.option("header", "true").csv(f"{root}/mixed")
    one.write.mode("append").parquet(f"{root}/mixed")
    one.toPandas().to_parquet(f"{root}/mixed.parquet")
    one.write.parquet(f"{root}/sales/eu/orders/archive/old")            # a table below a table
    want = {("sales/eu/orders", "parquet"), ("sales/us/refunds", "parquet"), ("mixed", "parquet"), ("mixed (csv)", "csv"),
            ("mixed.parquet", "parquet"), ("sales/eu/orders/archive/old", "parquet")}
    assert _names(spark, root) == want
    sources = {r["source"]: r["table_name"] for r in inventory(spark, str(root)).collect()}
    assert source_names(sources, str(root)) == sources                 # both forms of the rule agree
    for s in sources:
        df = read_source(spark, str(root), s)
        assert sorted(df.columns) == ["id", "p"] and sorted(r["id"] for r in df.collect()) == [1, 2]


def test_stream_adds_files_without_reading_the_table_again(spark, tmp_path):
    import json
    import shutil
    from lakesonar.operators import index as ix
    from lakesonar.plans.lake_search import build_summaries
    from lakesonar.sources.scan import read_source
    from lakesonar.streaming import reindex as rx
    root, idx, ckpt = tmp_path / "lake", str(tmp_path / "idx"), str(tmp_path / "ckpt")
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    read = []
    real = rx.read_files
    rx.read_files = lambda sp, r, s, paths, **k: read.append((s, len(paths))) or real(sp, r, s, paths, **k)
    try:
        li.filter("l_linenumber <= 3").coalesce(1).write.parquet(f"{root}/a/line")
        ev.coalesce(1).write.partitionBy("event_type").parquet(f"{root}/b/ev")
        rx.start_reindex(spark, str(root), idx, ckpt).awaitTermination()
        li.filter("l_linenumber > 3").coalesce(1).write.mode("append").parquet(f"{root}/a/line")
        li.filter("l_linenumber > 3").coalesce(1).write.mode("append").option("header", "true").csv(f"{root}/a/line")  # now mixed
        rx.start_reindex(spark, str(root), idx, ckpt).awaitTermination()
    finally:
        rx.read_files = real
    assert sorted(read) == [("a/line|csv", 1), ("a/line|parquet", 1), ("a/line|parquet", 1), ("b/ev|parquet", 5)]

    def same_as_full_profile():
        got = {r["id"]: r for r in ix.open_index(spark, idx).collect()}
        names = {r["table_name"]: r["source"] for r in inventory(spark, str(root)).collect()}
        assert set(got) == set(names)
        full = {r["name"]: json.loads(r["json_summary"]) for r in build_summaries(
            {n: read_source(spark, str(root), s) for n, s in names.items()}).collect()}
        for n, r in got.items():
            mine = json.loads(r["json_summary"])
            assert mine["field_names"] == full[n]["field_names"] and r["source_modified_at"] is not None
            for a, b in zip(mine["fields"], full[n]["fields"]):
                a, b = a["properties"], b["properties"]
                assert abs(a.pop("num_unique_values") - b["num_unique_values"]) <= 0.05 * b.pop("num_unique_values")
                if isinstance(a.get("std"), float):
                    assert abs(a.pop("std") - b["std"]) <= 1e-9 * max(1.0, b.pop("std"))
                assert a == b
        return set(got)

    assert same_as_full_profile() == {"a/line", "a/line (csv)", "b/ev"}
    assert rx.drop_missing(spark, str(root), idx) == 0
    gone = next(p for p in (root / "a" / "line").iterdir() if p.name.endswith(".csv"))
    gone.unlink()
    first = sorted((root / "b" / "ev").glob("event_type=*"))[0]
    shutil.rmtree(first)
    spark.catalog.clearCache()
    assert rx.drop_missing(spark, str(root), idx) == 2
    assert same_as_full_profile() == {"a/line", "b/ev"}


def test_distinct_error_is_marked(spark):
    from lakesonar.operators.profile import profile
    t = {"t": spark.range(5000).selectExpr("id", "id % 7 AS k", "CAST(id AS string) AS s")}
    exact = profile(t, n_samples=0).collect()
    assert all(r["distinct_is_exact"] and r["distinct_error"] == 0 for r in exact)
    truth = {r["column_name"]: r["num_unique_values"] for r in exact}
    for r in profile(t, n_samples=0, exact=False).collect():
        assert not r["distinct_is_exact"]
        assert abs(r["num_unique_values"] - truth[r["column_name"]]) <= r["distinct_error"] * truth[r["column_name"]]


def test_file_stats_shuffle_few_values(spark, monkeypatch):
    """only values that can be samples reach the shuffle, and the samples are the least md5s."""
    import hashlib
    from pyspark.sql import functions as F
    from lakesonar.streaming import stats
    sent, least = [], stats.smallest
    monkeypatch.setattr(stats, "smallest", lambda v, *a: sent.append(v.count()) or least(v, *a))
    df = spark.range(20000).selectExpr("id", "CAST(id AS STRING) AS s", "id % 2 = 0 AS odd")
    got = {r["column_name"]: r["samples"] for r in stats.file_stats({"t": df.select("id", "s")}, F.lit("f")).collect()}
    want = sorted(map(str, range(20000)), key=lambda v: hashlib.md5(v.encode()).hexdigest())[:3]
    assert [x["value"] for x in got["id"]] == [x["value"] for x in got["s"]] == want
    assert sent[0] < 400


def test_file_stats_hash_a_repeated_value_once(spark, monkeypatch):
    """texts and md5s are made once for a value of a column of few values, not for every cell; samples, dates and
    counts of each file are those of its rows."""
    import hashlib
    from pyspark.sql import functions as F
    from lakesonar.streaming import stats
    made, real = [], stats.hashed_few
    monkeypatch.setattr(stats, "hashed_few", lambda *a: made.append(real(*a)) or made[-1])
    df = spark.range(20000).selectExpr("id % 6 AS k", "IF(id % 4 = 0, NULL, id) AS many", "date_format(DATE'2020-01-01' + CAST(id % 40 AS INT), 'yyyy-MM-dd') AS d",
                                      "concat(repeat('x', 300), id % 10) AS long", "concat(repeat('y', 300), id) AS longs", "id % 2 AS p")
    got = {(r["file"], r["column_name"]): r for r in stats.file_stats({"t": df}, F.concat(F.lit("f"), "p")).collect()}
    hashed = made[0].filter("value IS NOT NULL").groupBy("part", "col").count().collect()
    assert sorted(r["count"] for r in hashed) == [1, 1, 3, 3, 20, 20]      # p, k and d of two files; no value of many and long ones
    for f, rows in (("f0", range(0, 20000, 2)), ("f1", range(1, 20000, 2))):
        least = lambda vs: sorted({hashlib.md5(v.encode()).hexdigest(): v for v in vs}.items())[:3]
        want = {"k": [str(i % 6) for i in rows], "many": [str(i) for i in rows if i % 4], "long": ["x" * 300 + str(i % 10) for i in rows],
                "longs": ["y" * 300 + str(i) for i in rows]}
        for c, vs in want.items():
            assert [tuple(x) for x in got[f, c]["samples"]] == least(vs)
        m, d = got[f, "many"], got[f, "d"]
        xs = [i for i in rows if i % 4]
        assert (m["n_rows"], m["n_non_null"], m["n"], m["min_lnum"], m["max_lnum"], m["nb"]) == (10000, len(xs), len(xs), min(xs), max(xs), 0)
        assert abs(m["mean"] - sum(xs) / len(xs)) < 1e-6 and m["ok0"] == 0 and m["lo0"] is None
        assert (d["ok0"], d["nb"], str(d["lo0"])[:10], str(d["hi0"])[:10]) == (10000, 10000, f"2020-01-0{1 + int(f[1])}", f"2020-02-0{8 + int(f[1])}")

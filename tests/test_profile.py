import hashlib
import math
import re
from decimal import Decimal

from pyspark.sql import functions as F

from lakesonar.operators.profile import profile
from lakesonar.operators.summary import summarize


def _by_col(p):
    return {r["column_name"]: r for r in p.collect()}


def test_nan_is_null_and_inf_kept(nulls_nan):
    r = _by_col(profile({"t": nulls_nan}))
    d = r["d"]
    assert d["dtype"] == "number"
    assert d["n_rows"] == 6
    assert d["n_non_null"] == 4            # NaN and NULL are missing (Q5)
    assert d["num_unique_values"] == 3     # 1.0, inf, 0.0 (-0.0 == 0.0)
    assert d["max_num"] == math.inf and d["min_num"] == 0.0
    assert d["observed_nullable"] is True
    i = r["i"]
    assert i["n_non_null"] == 4 and i["integral"] is True
    assert abs(i["std"] - 2.0816659994661326) < 1e-9


def test_string_ratio_and_samples(nulls_nan):
    r = _by_col(profile({"t": nulls_nan}, n_samples=2))
    s = r["s"]
    assert s["num_unique_values"] == 4     # a, b, '', c (blank counts as a value)
    assert s["dtype"] == "string"          # 4 / 6 >= 0.5
    assert len(s["samples"]) == 2
    assert set(s["samples"]) <= {"a", "b", "", "c"}


def test_one_row_and_empty_and_all_null(spark):
    one = spark.createDataFrame([(1, 2.5, "x")], "i int, d double, s string")
    r = _by_col(profile({"one": one}))
    assert r["i"]["std"] is None and r["d"]["std"] is None     # Q4
    empty = spark.createDataFrame([], "i int, s string")
    r = _by_col(profile({"empty": empty}))
    assert r["s"]["dtype"] == "string" and r["s"]["n_rows"] == 0 and r["s"]["samples"] == []
    alln = spark.createDataFrame([(None,), (None,)], "s string")
    r = _by_col(profile({"alln": alln}))
    assert r["s"]["dtype"] == "string" and r["s"]["num_unique_values"] == 0   # Q6


def test_boolean_decimal_nested(spark):
    df = spark.createDataFrame(
        [(True, Decimal("1.50"), [1, 2], {"k": 1.0}, (1.0, [float("nan")])),
         (None, Decimal("2.25"), [1, 2], {"k": float("nan")}, (2.0, [3.0]))],
        "b boolean, m decimal(12,2), a array<int>, mp map<string,double>, st struct<x:double, y:array<double>>")
    r = _by_col(profile({"t": df}))
    assert r["b"]["dtype"] == "boolean" and r["b"]["std"] is None       # Q1
    assert r["m"]["dtype"] == "number" and r["m"]["max_num"] == 2.25     # Q2
    assert r["a"]["dtype"] == "array<int>" and r["a"]["num_unique_values"] == 1
    assert r["mp"]["dtype"].startswith("map")
    assert r["st"]["dtype"].startswith("struct")


def test_date_strings(spark):
    rows = [("2024-01-05", "20240105", "01/05/2024", "25/12/2024", "2024", "2024-01-05", "x", "", "2024-01-05 10:00:00.5"),
            ("2023-12-31", "20231231", "12/31/2023", "13/01/2023", "1999", "05/01/2024", "2024-01-01", "", "2023-12-31 23:59:59"),
            ("2024-02-29", "20240229", "02/29/2024", "31/01/2023", "2000", None, "2024-01-02", "", "2024-02-29 00:00:00")]
    df = spark.createDataFrame(rows, "iso string, compact string, us string, eu string, year string, "
                                     "mixed string, bad string, blank string, iso_t string")
    r = _by_col(profile({"t": df}))
    assert r["iso"]["dtype"] == "date" and r["iso"]["min"] == "2023-12-31T00:00:00"
    assert r["compact"]["date_format"] == "compact"
    assert r["us"]["date_format"] == "us"
    assert r["eu"]["date_format"] == "eu" and r["eu"]["max"] == "2024-12-25T00:00:00"
    assert r["year"]["date_format"] == "year"
    assert r["mixed"]["dtype"] != "date"           # one format for the whole column
    assert r["bad"]["dtype"] != "date"
    assert r["blank"]["dtype"] != "date"           # nothing to parse
    assert r["iso_t"]["dtype"] == "date" and r["iso_t"]["max"] == "2024-02-29T00:00:00"
    assert r["iso_t"]["min"] == "2023-12-31T23:59:59"


def test_ratio_edge(spark):
    below = spark.createDataFrame([(str(i % 4),) for i in range(10)], "s string")   # 4/10
    at = spark.createDataFrame([(str(i % 5),) for i in range(10)], "s string")      # 5/10
    assert _by_col(profile({"t": below}))["s"]["dtype"] == "category"
    assert _by_col(profile({"t": at}))["s"]["dtype"] == "string"


def test_samples_subset_and_size(spark):
    from lakesonar.plans.registry import read_lake
    tabs = read_lake(spark, "/root/testdata/sf0.001", ["nation", "orders"])
    p = profile(tabs, n_samples=3).collect()
    for r in p:
        assert len(r["samples"]) == min(3, r["num_unique_values"])
    region = _by_col(profile({"n": tabs["nation"]}))
    vals = {str(x[0]) for x in tabs["nation"].select("n_regionkey").collect()}
    assert set(region["n_regionkey"]["samples"]) <= vals


def test_exact_vs_approx(spark):
    from lakesonar.plans.registry import read_lake
    tabs = read_lake(spark, "/root/testdata/sf0.001", ["orders"])
    ex = _by_col(profile(tabs))
    ap = _by_col(profile(tabs, exact=False))
    for c in ex:
        e, a = ex[c]["num_unique_values"], ap[c]["num_unique_values"]
        assert abs(e - a) <= max(2, 0.1 * e)


def test_summary_json_types(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (3, 4.5, "b")], "i int, d double, s string")
    s = summarize(profile({"t": df})).first()
    import json
    j = json.loads(s["json_summary"])
    f = {x["column"]: x["properties"] for x in j["fields"]}
    assert j["field_names"] == ["i", "d", "s"]
    assert f["i"]["std"] == 1 and isinstance(f["i"]["min"], int)   # P3 truncation
    assert f["d"]["min"] == 2.5 and "std" not in f["s"]
    assert j["dataset_description"] == "" and f["s"]["semantic_type"] == ""


def test_no_python_in_profile_plan(spark):
    from lakesonar.plans.registry import read_lake
    p = profile(read_lake(spark, "/root/testdata/sf0.001", ["lineitem"]))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_approx_mode_equals_exact_but_distinct(spark):
    """Approximate mode skips the per-value shuffle; samples (with a value that
    fills a third of the rows, long texts, fewer values than n), counts, std,
    min/max and dates are the same as in exact mode."""
    long_a, long_b = "a" * 400, "b" * 300
    rows = [(i, "hot" if i % 3 == 0 else f"v{i}", long_a if i % 2 else long_b,
             "x" if i < 200 else None, float(i) / 7, f"2024-01-{1 + i % 28:02d}")
            for i in range(600)]
    df = spark.createDataFrame(rows, "id long, s string, t string, few string, d double, ds string")
    one = spark.createDataFrame([(None,)], "z string")
    tabs = {"t1": df, "t2": one}
    cols = ["table_name", "column_name", "dtype", "n_rows", "n_non_null", "std", "min", "max",
            "date_format", "samples"]

    def rows_of(exact):
        out = {}
        for r in profile(tabs, exact=exact).collect():
            d = r.asDict()
            d["std"] = None if d["std"] is None else round(d["std"], 9)
            out[(d["table_name"], d["column_name"])] = {c: d[c] for c in cols}
        return out
    ex, ap = rows_of(True), rows_of(False)
    assert ex == ap
    assert ap[("t1", "t")]["samples"] and all(len(v) in (300, 400) for v in ap[("t1", "t")]["samples"])
    assert ap[("t1", "few")]["samples"] == ["x"]
    assert ap[("t2", "z")]["samples"] == []


def test_approx_samples_equal_exact_randomized(spark):
    """Columns with 1 to 40 distinct values (so 1 to 16 md5 classes are filled),
    skewed counts and nulls: approximate samples equal exact samples."""
    import random
    rnd = random.Random(7)
    cols = {}
    for j in range(12):
        k = rnd.choice([1, 2, 3, 4, 5, 8, 13, 40])
        vals = [f"v{j}_{rnd.randrange(10**6)}" for _ in range(k)]
        cols[f"c{j}"] = [None if rnd.random() < 0.1 else
                         (vals[0] if rnd.random() < 0.4 else rnd.choice(vals)) for _ in range(300)]
    rows = list(zip(*[cols[c] for c in sorted(cols)]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in sorted(cols)))
    for n in (1, 3, 6):
        ex = {r["column_name"]: r["samples"] for r in profile({"t": df}, n_samples=n).collect()}
        ap = {r["column_name"]: r["samples"] for r in profile({"t": df}, n_samples=n, exact=False).collect()}
        assert ex == ap


def test_auto_mode_exact_near_category_threshold(spark):
    """Ratios 0.499 / 0.501 sit on either side of the category threshold: auto
    mode counts them exactly and decides as the exact mode does; a column far
    from the threshold keeps its sketch count."""
    n = 1000
    rows = [(f"a{i % 499}", f"b{i % 501}", f"c{i % 5}", f"d{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    ex = {r["column_name"]: r for r in profile({"t": df}).collect()}
    au = {r["column_name"]: r for r in profile({"t": df}, exact="auto").collect()}
    assert ex["a"]["dtype"] == au["a"]["dtype"] == "category"
    assert ex["b"]["dtype"] == au["b"]["dtype"] == "string"
    assert au["a"]["num_unique_values"] == 499 and au["b"]["num_unique_values"] == 501
    assert {c: au[c]["dtype"] for c in au} == {c: ex[c]["dtype"] for c in ex}
    assert {c: au[c]["samples"] for c in au} == {c: ex[c]["samples"] for c in ex}


def test_numeric_queries_cover_the_lake(spark):
    import numpy as np
    import pandas as pd
    from lakesonar.plans import q_profile as q
    from lakesonar.plans.registry import LAKE_TABLES, NUMERIC_DUCK
    sf = "/root/testdata/sf0.001"
    frames = {t: pd.read_parquet(f"{sf}/{t}.parquet") for t in LAKE_TABLES}
    want = {(t, c): frames[t][c] for t, cols in LAKE_TABLES.items() for c, ty in cols if ty in NUMERIC_DUCK}
    for fn in (q.q_profile_numeric, q.q_profile_numeric_approx, q.q_profile_numeric_json):
        got = {(r.table_name, r.column_name): r for r in fn(spark, sf).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            r, whole = got[k], v.notna().all() and v.dtype.kind == "i"
            std, low, high = ("std_json", "min_json", "max_json") if "std_json" in r.__fields__ else ("std", "min_num", "max_num")
            sd = v.std()
            assert np.isclose(r[std], np.floor(sd) if std == "std_json" and whole else sd, rtol=1e-9, atol=1e-4)
            assert np.isclose(r[low], v.min()) and np.isclose(r[high], v.max())
    everything = {(t, c) for t, cols in LAKE_TABLES.items() for c, _ in cols}
    assert {(r[0], r[1]) for r in q.q_profile_distinct_approx(spark, sf).collect()} == everything
    lake = {(r.table_name, r.column_name): r for r in q.q_lake_profile(spark, sf).collect()}
    assert lake.keys() == everything
    for (t, c), r in lake.items():
        v = frames[t][c].map(lambda x: tuple(x) if isinstance(x, np.ndarray) else x)
        assert (r.n_columns, r.n_rows, r.num_unique_values) == (len(LAKE_TABLES[t]), len(v), v.nunique())
        assert r.n_samples == min(3, v.nunique()) and (r.std is not None) == ((t, c) in want)
        if v.dtype.kind == "i":
            texts = sorted({str(x) for x in v}, key=lambda x: hashlib.md5(x.encode()).hexdigest())[:3]
            assert (r.min, r.max, r.samples) == (str(v.min()), str(v.max()), "|".join(texts))
        elif v.dtype.kind == "M":
            assert (r.dtype, r.min, r.max) == ("date", v.min().isoformat(), v.max().isoformat())


def test_zoned_iso_timestamps_are_dates(spark):
    from lakesonar.plans import q_profile as q
    df = spark.createDataFrame([("2024-01-02T03:04:05Z", "2024-01-02T00:04:05+02:00", "2024-01-02T03:04:05.1Z", "2024-01-02T03:04:05+99:00"),
                                ("2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05.123456-05:30", "2024-01-03T00:00:00", "x")],
                               "z string, off string, mixed string, bad string")
    for mode in (True, False, "auto"):
        r = _by_col(profile({"t": df}, exact=mode))
        assert [r[c]["dtype"] for c in ("z", "off", "mixed")] == ["date"] * 3 and r["bad"]["dtype"] != "date"
        assert (r["z"]["min"], r["z"]["max"]) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.123456")
        assert (r["off"]["min"], r["off"]["max"]) == ("2024-01-01T22:04:05", "2024-01-02T08:34:05.123456")
        assert (r["mixed"]["min"], r["mixed"]["max"]) == ("2024-01-02T03:04:05.100000", "2024-01-03T00:00:00")
    sf = "/root/testdata/sf0.001"
    low, high = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 0 MINUTE ELSE INTERVAL 150 MINUTE END AS t").selectExpr(
        "date_format(min(t), \"yyyy-MM-dd'T'HH:mm:ss\")", "date_format(max(t), \"yyyy-MM-dd'T'HH:mm:ss\")").first()
    for fn in (q.q_profile_dates, q.q_profile_dates_approx):
        r = _by_col(fn(spark, sf))["d_zoned"]
        assert (r["dtype"], r["min"], r["max"]) == ("date", low, high)


def test_footer_counts_are_pushed_down(spark, tmp_path):
    from lakesonar.operators.schema import file_nullability, footer_counts, footer_reads, observed_nullability
    df = spark.createDataFrame([(1, "a", 1.0, [1]), (None, None, float("nan"), None), (3, "", None, [2])],
                               "i int, s string, d double, xs array<int>")
    path = str(tmp_path / "t")
    df.repartition(2).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList", None)
    with footer_reads(spark):
        counts, flat = footer_counts(spark.read.parquet(path))
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert flat == [0, 1] and "PushedAggregation: [COUNT(*), COUNT(i), COUNT(s)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList", None) == before
    got = {r["column_name"]: (r["n_rows"], r["n_null"]) for r in file_nullability(spark, {"t": path}).collect()}
    assert got == {"i": (3, 1), "s": (3, 1), "d": (3, 2), "xs": (3, 1)}          # NaN is missing
    wide = observed_nullability({"t": spark.read.parquet(path), "e": df.limit(0)})
    assert {(r["table_name"], r["ordinal"]): r["n_null"] for r in wide.collect()} == {
        ("t", 0): 1, ("t", 1): 1, ("t", 2): 2, ("t", 3): 1, ("e", 0): 0, ("e", 1): 0, ("e", 2): 0, ("e", 3): 0}
    plan = observed_nullability({"t": spark.read.parquet(path)})._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan


def test_local_times_keep_their_values_in_any_zone(spark):
    from lakesonar.operators.profile import profile
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS t UNION ALL SELECT timestamp_ntz'2024-03-10 03:30:00'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for exact in (True, False):
            (r,) = profile({"t": df}, exact=exact).collect()
            assert r["num_unique_values"] == 2 and (r["min"], r["max"]) == ("2024-03-10T02:30:00", "2024-03-10T03:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_decimal_and_double_texts(spark):
    from lakesonar.operators.profile import profile
    df = spark.sql("""SELECT CAST(c1 AS DECIMAL(38, 10)) AS wide, CAST(c2 AS DOUBLE) AS d FROM VALUES
      ('12345678901234567890.1234567891', '1e7'), ('12345678901234567890.1234567892', '0.0005'), ('-9.5', '1e20'),
      ('-12345678901234567890.1234567891', '-12345678.25'), ('-12345678901234567890.1234567892', NULL) AS t(c1, c2)""")
    for exact in (True, False):
        r = {x["column_name"]: x for x in profile({"t": df}, exact=exact, n_samples=9).collect()}
        assert r["wide"]["min"] == "-12345678901234567890.1234567892" and r["wide"]["max"] == "12345678901234567890.1234567892"
        assert set(r["d"]["samples"]) == {"10000000.0", "0.0005", "1.0E20", "-12345678.25"}
        assert r["d"]["min"] == "-12345678.25"


def test_samples_sort_low_hashes_only(spark):
    """The samples of columns with many and few values, cut down to low hashes or not, are the least md5s."""
    import hashlib
    from lakesonar.operators.profile import profile
    df = spark.range(6000).selectExpr("id", "concat('v', id % 5) AS few", "id % 400 AS some", "CAST(NULL AS STRING) AS none")
    want = {"id": range(6000), "few": [f"v{i}" for i in range(5)], "some": range(400), "none": []}
    for exact in (True, False):
        got = {r["column_name"]: r["samples"] for r in profile({"t": df}, exact=exact).collect()}
        for c, values in want.items():
            assert got[c] == sorted(map(str, values), key=lambda v: hashlib.md5(v.encode()).hexdigest())[:3], (exact, c)


def test_date_formats_keep_their_values(spark):
    """the quick conditions in front of a format change no result."""
    from lakesonar.functions.dates import DATE_FORMATS, sql_parse_with
    rows = ["2024-02-29", "2024-13-01", "2024-00-10", "2023-02-29", "2024-02-29 01:02:03", "2024-02-29 01:02:03.5",
            "2024-02-29T01:02:03Z", "2024-02-29T01:02:03+02:00", "20240229", "20241301", "2024", "1677", "2/3/2024", "13/3/2024",
            "3/13/2024", "12/12/2024", "0/1/2024", "01/02/2024", "", "2024-02-29\n", "99/99/9999", None]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    for name, regex, pattern in DATE_FORMATS:
        pat = pattern.replace("'", "\\'")
        year = " AND try_cast(v AS INT) BETWEEN 1678 AND 2261" if name == "year" else ""
        plain = f"(CASE WHEN v RLIKE r'{regex}'{year} THEN try_to_timestamp(v, '{pat}') END)"
        assert df.selectExpr("v", f"{sql_parse_with('v', name, regex, pattern)} AS a", f"{plain} AS b").filter("NOT a <=> b").isEmpty()


def test_values_travel_by_type_and_low_hashes_only(spark):
    """A distinct value's key is its column's number and one native value, no values are sorted to find
    their samples, and columns of many values, cut down in the scan, give the same statistics and samples."""
    df = spark.range(30000).selectExpr("id", "id % 7 AS few", "id % 6000 / 8 AS d", "concat(repeat('x', 300), id % 5000) AS long",
                                       "CAST(id % 9 AS DECIMAL(9, 2)) AS m", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS t",
                                       "date_format(timestamp'2024-01-01' + make_dt_interval(CAST(id % 50 AS INT)), 'dd/MM/yyyy') AS eu")
    rows = df.collect()
    text = {"t": lambda v: v.isoformat()}
    for exact in (True, False, "auto"):
        got = _by_col(profile({"t": df}, exact=exact))
        for c in df.columns:
            values = {text.get(c, str)(r[c]) for r in rows}
            assert got[c]["samples"] == sorted(values, key=lambda v: hashlib.md5(v.encode()).hexdigest())[:3], (exact, c)
            assert got[c]["num_unique_values"] == len(values) or exact is not True
        assert (got["eu"]["date_format"], got["eu"]["min"], got["eu"]["max"]) == ("eu", "2024-01-01T00:00:00", "2024-02-19T00:00:00")
        assert (got["m"]["min"], got["m"]["max"], got["t"]["max"]) == ("0.00", "8.00", "2024-01-01T08:19:59")
        assert got["d"]["n_rows"] == 30000 and abs(got["d"]["std"] - 216.510) < 0.01
    numbers = df.select("id", "few", "d")
    for exact in (True, False):
        plan = profile({"t": numbers}, exact=exact, materialize=False)._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan)
        assert "SortAggregate" not in plan and any("v#" in k for k in keys) and not any("lnum" in k for k in keys)

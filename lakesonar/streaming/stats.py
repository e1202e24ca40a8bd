"""Mergeable column statistics (2.12), and a stored table of them for each file.

A part of a table (a new file, a partition) yields per-column partial
statistics: count, mean, M2 (sum of squared deviations), min, max and an HLL
sketch. Partials merge exactly for count/mean/std/min/max (Chan et al.'s
pairwise update, written as one aggregation) and approximately for distincts
(``hll_union_agg``), so a new file updates a profile without a rescan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesonar.operators.profile import (DATE_LIKE, EXTREMES, LONG_TEXT, MANY_VALUES, NATIVE_TEXT, STAT_TYPES, VALUE_KEY, WIDE,
                                         _date_pick, _table_literal, _union, cells, column_catalog, column_numbers, described,
                                         has_decimals, native_text, native_value, numbers_frame, per_column, sample_limits,
                                         typed_cells)
from lakesonar.functions.dates import DATE_FORMATS, sql_parse_with
from lakesonar.functions.render import INTEGRAL, kind_of, quote, sql_nan_to_null
from lakesonar.operators.index import _fs
from lakesonar.session import shared_dir, table_exists

KEYS = ["table_name", "ordinal"]


PART_COL = "__part"


def partial_stats(tables, part) -> DataFrame:
    """(part, table_name, ordinal, n_rows, n, mean, m2, min_num, max_num, sketch).

    ``part`` names the part (a string), or is a column expression over the
    table's rows (a file name, a partition value): then every part of the
    table is summarised by the same aggregation, in one job.
    """
    items = tables.items() if isinstance(tables, dict) else tables
    if isinstance(part, str):
        c, part_key = cells(list(items)), F.lit(part)
    else:
        c = cells([(n, df.withColumn(PART_COL, part)) for n, df in items], part_col=PART_COL)
        part_key = F.col("part")
    c = c.select(part_key.alias("part"), *KEYS,
                 F.coalesce("num", F.col("lnum").cast("double")).alias("x"),
                 F.expr(VALUE_KEY).alias("value"))
    return (c.groupBy("part", *KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        (F.var_pop("x") * F.count("x")).alias("m2"),
        F.min("x").alias("min_num"), F.max("x").alias("max_num"),
        F.hll_sketch_agg("value").alias("sketch")))


def merge_stats(partials: DataFrame) -> DataFrame:
    """Merge partial statistics per column: exact n/mean/std/min/max, HLL distincts."""
    tot = partials.groupBy(*KEYS).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    joined = partials.join(tot.select(*KEYS, F.col("mean").alias("gmean")), KEYS)
    m = joined.groupBy(*KEYS).agg(
        (F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - F.col("gmean")) ** 2)).alias("m2"),
        F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))
    return tot.join(m, KEYS).select(
        *KEYS, "n_rows", "n", "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
        "min_num", "max_num", "approx_distinct")


# stored statistics of files --------------------------------------------------

# The sketch of a file's values (2^12 registers), and the most that a count from united sketches is
# off: three standard errors of 1.04 / sqrt(registers), as a share of the count.
SKETCH_LG = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_LG / 2)
# what tells a file apart, and a column in it (by name: files of a table may differ in columns)
FILE = ["source", "file"]
COLUMN = ["source", "column_name"]
SUMMED = ["n_rows", "n_non_null", "n", "nb"] + [f"ok{j}" for j in range(len(DATE_FORMATS))]
LEAST = ["min_num", "min_lnum", "min_ts", "min_tn"] + [f"lo{j}" for j in range(len(DATE_FORMATS))]
MOST = ["max_num", "max_lnum", "max_ts", "max_tn"] + [f"hi{j}" for j in range(len(DATE_FORMATS))]


def file_stats(tables, file, n_samples: int = 3) -> DataFrame:
    """Mergeable statistics of every column of every file: one row for each (source, file, column_name).

    ``tables`` are (source, DataFrame); ``file`` is an expression over their rows (the file's path).
    Besides the counts, moments and extremes (temporal ones too) a row holds a distinct sketch, the parse
    counts and extremes of each date format, and the ``n_samples`` values of least md5: all that a
    profile needs, in a size that does not depend on the file's.

    Counts, moments and extremes are aggregates of a table's native values. Texts and their md5, for sketch and samples,
    are made once for a value of a column of few values, and once for a cell of the other columns.
    """
    named = list(tables.items() if isinstance(tables, dict) else tables)
    items = [(n, df.withColumn(PART_COL, file)) for n, df in named]
    spark = items[0][1].sparkSession
    shared_dir(spark)
    numbers = numbers_frame(items, spark)
    # one row a column and file, read by all that follows
    stats = part_moments(items).join(F.broadcast(numbers), KEYS).checkpoint(eager=True)
    n_rows, few = stats.count(), few_valued(stats)
    on = F.col("part").eqNullSafe(F.col("_part")) & (F.col("col") == F.col("_col"))

    def beside(df):                        # keys that meet others null-safe
        return df.withColumnsRenamed({"part": "_part", "col": "_col"})

    limits = sample_limits(stats.select("table_name", "ordinal", "part", "col", F.col("u").alias("num_unique_values")), n_samples)
    # at most about EXPECTED_LOW (few values: MANY_VALUES) low hashes a column and file, without long texts
    few_limits = per_column(beside(limits.select("part", "col", "lim")), n_rows)
    low = F.when(F.col("vhash") < F.col("lim"), F.struct("vhash", "value"))
    found = [hashed_many(name, df, few, column_numbers(items), limits, n_rows) for name, df in items]
    once = hashed_few(items, few)
    if once is not None:
        found.append(once.join(few_limits, on).groupBy("part", "col").agg(
            F.hll_sketch_agg("vhash", F.lit(SKETCH_LG)).alias("sketch"), F.collect_set(low).alias("low")))
    found = _union([x for x in found if x is not None]).checkpoint(eager=True)
    values = found.select("part", "col", F.inline("low"))
    samples = smallest(values, ["part", "col"], n_samples) if n_samples > 0 else None
    if samples is not None:
        samples = with_long_values(samples, items, n_rows)
    none = spark.range(1).agg(F.hll_sketch_agg(F.lit(None).cast("string"), F.lit(SKETCH_LG))).first()[0]
    out = stats.join(beside(found.drop("low")), on, "left").drop("_part", "_col").withColumn("sketch", F.coalesce("sketch", F.lit(none)))
    dates = part_dates(items)
    if dates is not None:
        out = out.join(beside(dates), on, "left").drop("_part", "_col")
    have = set(out.columns)
    for j in range(len(DATE_FORMATS)):
        out = out.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast("timestamp") for c in (f"lo{j}", f"hi{j}")} | {
            f"ok{j}": F.coalesce(*([F.col(f"ok{j}")] if f"ok{j}" in have else []), F.lit(0)).cast("long")})
    if samples is None:
        out = out.withColumn("samples", F.lit(None).cast("array<struct<vhash:string,value:string>>"))
    else:
        out = out.join(beside(samples), on, "left").drop("_part", "_col")
    dated = [f"{c}{j}" for j in range(len(DATE_FORMATS)) for c in ("ok", "lo", "hi")]
    return out.select(*KEYS, "part", "n_rows", "n_non_null", "n", "mean", "m2", *EXTREMES, "sketch", "nb", *dated, "samples").join(
        column_catalog(named), KEYS).withColumnsRenamed({"table_name": "source", "part": "file"})


def part_moments(items) -> DataFrame:
    """(part, table_name, ordinal, n_rows, n_non_null, n, mean, m2, extremes, nb, u): counts, moments and extremes of every
    column of every part in its own type; ``u``: about how many values it has."""
    decimals, parts = has_decimals(items), []
    kinds = {"n": "BIGINT", "mean": "DOUBLE", "m2": "DOUBLE", "nb": "BIGINT"}
    for name, df in items:
        fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name != PART_COL]
        for at in range(0, len(fields), WIDE):
            aggs, structs = [], []
            for i, f in fields[at:at + WIDE]:
                dt, kind, c = f.dataType, kind_of(f.dataType), quote(f.name)
                x = sql_nan_to_null(c, dt)
                out = dict.fromkeys(["n", "mean", "m2", *EXTREMES, "nb"], "NULL") | {"n": "0", "nb": "0"}
                aggs += [f"count({x}) AS n{i}", f"approx_count_distinct({native_value(f)[1]}) AS u{i}"]
                if kind == "temporal" and not isinstance(dt, T.TimestampType):  # no zone: the session's must not move it
                    x = f"CAST({x} AS TIMESTAMP_NTZ)"
                if kind in ("number", "temporal"):
                    aggs += [f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
                if kind == "number":
                    aggs += [f"avg(CAST({x} AS DOUBLE)) AS a{i}", f"var_pop(CAST({x} AS DOUBLE)) AS v{i}"]
                    out |= {"n": f"n{i}", "mean": f"a{i}", "m2": f"v{i} * n{i}", "min_num": f"lo{i}", "max_num": f"hi{i}"}
                    if isinstance(dt, INTEGRAL):
                        out |= {"min_lnum": f"lo{i}", "max_lnum": f"hi{i}"}
                    elif decimals and not isinstance(dt, T.DoubleType):
                        out |= {"min_dec": f"lo{i}", "max_dec": f"hi{i}"}
                elif kind == "temporal":
                    end = "ts" if isinstance(dt, T.TimestampType) else "tn"
                    out |= {f"min_{end}": f"lo{i}", f"max_{end}": f"hi{i}"}
                elif kind == "string":
                    aggs.append(f"count_if({x} <> '') AS nb{i}")
                    out["nb"] = f"nb{i}"
                typed = ", ".join(f"'{k}', CAST({e} AS {kinds.get(k) or STAT_TYPES[k.split('_')[-1]]})" for k, e in out.items())
                structs.append(f"named_struct('table_name', {_table_literal(name)}, 'ordinal', {i}, 'n_rows', n_rows, "
                               f"'n_non_null', n{i}, {typed}, 'u', u{i})")
            if structs:
                parts.append(df.groupBy(F.col(PART_COL).cast("string").alias("part"))
                             .agg(F.expr("count(1) AS n_rows"), *[F.expr(a) for a in aggs])
                             .selectExpr("part", f"inline(array({', '.join(structs)}))"))
    return _union(parts)


def few_valued(stats: DataFrame) -> set:
    """The (table_name, ordinal) of the columns that have at most ``MANY_VALUES`` values, or about so many, in every part:
    metadata, at most one row a column."""
    return {(r[0], r[1]) for r in stats.groupBy(*KEYS).agg(F.max("u").alias("u")).filter(F.col("u") <= MANY_VALUES)
            .select(*KEYS).collect()}


def hashed_few(items, few: set) -> DataFrame | None:
    """(part, col, value, vhash): the values of the ``few`` columns as text (null if it is long) and the text's md5, each
    once from a part (long ones as often as they are there)."""
    parts = []
    for native, c in typed_cells(items, few, part_col=PART_COL).items():
        if native == "string":
            parts.append(c.filter(f"length(v) > {LONG_TEXT}").selectExpr("part", "col", "CAST(NULL AS STRING) AS value", "md5(v) AS vhash"))
            c = c.filter(f"length(v) <= {LONG_TEXT}")
        parts.append(c.distinct().selectExpr("part", "col", f"{NATIVE_TEXT[native]} AS value").selectExpr("*", "md5(value) AS vhash"))
    return _union(parts)


def hashed_many(name: str, df: DataFrame, few: set, number: dict, limits: DataFrame, n_rows: int) -> DataFrame | None:
    """(part, col, sketch, low) of a table's columns that are not in ``few``: the sketch of the md5s of their texts, and
    those under the column's limit with their texts (null if long). One aggregate of whole rows: none for each cell."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name != PART_COL and (name, i) not in few]
    out = []
    for at in range(0, len(fields), WIDE):
        native, text, low, aggs, structs = [], [], [], [], []
        for i, f in fields[at:at + WIDE]:
            kind, v = native_value(f)
            native.append(f"{v} AS v{i}")
            text.append(f"{native_text(kind, f'v{i}')} AS t{i}")
            low.append(F.max(F.when(F.col("ordinal") == i, F.col("lim"))).alias(f"l{i}"))
            short = f"CASE WHEN length(t{i}) <= {LONG_TEXT} THEN t{i} END" if kind == "string" else f"t{i}"
            aggs += [F.expr(f"hll_sketch_agg(h{i}, {SKETCH_LG}) AS s{i}"),
                     F.expr(f"collect_set(CASE WHEN h{i} < l{i} THEN named_struct('vhash', h{i}, 'value', {short}) END) AS w{i}")]
            structs.append(f"named_struct('col', {number[name, i]}, 'sketch', s{i}, 'low', w{i})")
        if not structs:
            continue
        ids = [i for i, _ in fields[at:at + WIDE]]
        rows = (df.selectExpr(f"CAST({quote(PART_COL)} AS STRING) AS part", *native).selectExpr("part", *text)
                .selectExpr("*", *[f"md5(t{i}) AS h{i}" for i in ids]))
        mine = limits.filter(F.col("table_name") == name).groupBy(F.col("part").alias("_part")).agg(*low)
        out.append(rows.join(per_column(mine, n_rows), F.col("part").eqNullSafe(F.col("_part"))).groupBy("part").agg(*aggs)
                   .selectExpr("part", f"inline(array({', '.join(structs)}))"))
    return _union(out)


def with_long_values(samples: DataFrame, items, n_rows: int) -> DataFrame:
    """``samples`` (part, col, samples) with the long texts among them, which come as their hash alone, fetched in full."""
    samples = samples.checkpoint(eager=True)
    each = samples.select("part", "col", F.inline("samples"))
    chosen = each.filter("value IS NULL").select(F.col("part").alias("_part"), F.col("col").alias("_col"), F.col("vhash").alias("_vhash"))
    source = typed_cells(items, kinds=("string", "other"), part_col=PART_COL).get("string")
    if source is None or chosen.isEmpty():
        return samples
    on = F.col("part").eqNullSafe(F.col("_part")) & (F.col("col") == F.col("_col")) & (F.col("vhash") == F.col("_vhash"))
    full = (source.filter(f"length(v) > {LONG_TEXT}").withColumn("vhash", F.md5("v")).join(per_column(chosen, n_rows), on, "left_semi")
            .groupBy("part", "col", "vhash").agg(F.min("v").alias("long"))
            .withColumnsRenamed({"part": "_part", "col": "_col", "vhash": "_vhash"}))
    return each.join(full, on, "left").groupBy("part", "col").agg(
        F.array_sort(F.collect_list(F.struct("vhash", F.coalesce("value", "long").alias("value")))).alias("samples"))


def part_dates(items) -> DataFrame | None:
    """(part, col, ok, lo and hi of each date format): how many values of a string column the format parses, and the
    least and largest date. Only values that may be dates leave the scan, and each distinct one is parsed once."""
    c = typed_cells(items, kinds=("string",), part_col=PART_COL).get("string")
    if c is None:
        return None
    values = c.filter(DATE_LIKE.format(e="v")).groupBy("part", "col", "v").agg(F.count(F.lit(1)).alias("n"))
    parsed = ", ".join(f"named_struct('f', {j}, 'p', {sql_parse_with('v', n, r, p)})" for j, (n, r, p) in enumerate(DATE_FORMATS))
    fits = values.selectExpr("part", "col", "n", f"inline(array({parsed}))").filter("p IS NOT NULL")
    aggs = []
    for j in range(len(DATE_FORMATS)):
        aggs += [f"sum(CASE WHEN f = {j} THEN n END) AS ok{j}", f"min(CASE WHEN f = {j} THEN p END) AS lo{j}",
                 f"max(CASE WHEN f = {j} THEN p END) AS hi{j}"]
    return fits.groupBy("part", "col").agg(*[F.expr(a) for a in aggs])


def smallest(values: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, samples): the ``n`` distinct values of least hash, as (vhash, value) in order. Repeated values collapse
    in the tasks, and a partial group limit leaves ``n`` a task before the window's shuffle."""
    w = Window.partitionBy(*keys).orderBy("vhash")
    ranked = (values.groupBy(*keys, "vhash").agg(F.min("value").alias("value"))
              .withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n))
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vhash", "value"))).alias("samples"))


def write_file_stats(stats: DataFrame, path: str, batch: int) -> None:
    """Store the statistics of a batch of files under ``path``. A batch that is run again replaces itself."""
    stats.withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def forget_files(spark: SparkSession, path: str, files: DataFrame, batch: int) -> None:
    """Record that ``files`` (source, file) are no longer there."""
    known = spark.read.parquet(path)
    lost = files.select(*FILE).distinct().withColumn("gone", F.lit(True))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields if f.name not in (*FILE, "gone", "batch")]
    lost.select(*FILE, "gone", *blank).write.mode("append").parquet(f"{path}/batch={batch}")


def next_batch(spark: SparkSession, path: str) -> int:
    """One more than the largest batch stored."""
    if not table_exists(spark, path):
        return 0
    fs, root = _fs(spark, path)
    return 1 + max([int(st.getPath().getName()[6:]) for st in fs.listStatus(root)
                    if st.getPath().getName().startswith("batch=")] or [-1])


def current_file_stats(spark: SparkSession, path: str) -> DataFrame:
    """The newest statistics of each file that is still there."""
    every = spark.read.parquet(path)
    newest = every.groupBy(*FILE).agg(F.max("batch").alias("batch"))
    return every.join(newest, [*FILE, "batch"], "left_semi").filter("NOT gone")


def _decimals_merged() -> list:
    """min_dec and max_dec of files: their texts, compared as the extremes that they are."""
    out = []
    for c, num, pick in (("min_dec", "min_num", F.min_by), ("max_dec", "max_num", F.max_by)):
        digits = F.when(F.col(num) < 0, F.translate(c, "0123456789", "9876543210")).otherwise(F.col(c))
        order = F.struct(num, F.length(c) * F.signum(num), digits)
        out.append(pick(c, F.when(F.col(c).isNotNull(), order)).alias(c))
    return out


def merged_profile(stats: DataFrame, n_samples: int = 3, by: dict[str, str] | None = None) -> DataFrame:
    """The ``profile`` schema from statistics of files: everything as a full scan gives it but
    ``num_unique_values``, which comes from the united sketches (``distinct_error``).

    A column has the position and type of the newest batch that holds it. ``by`` maps
    sources to the table names of the result."""
    newest = stats.groupBy(*COLUMN).agg(F.max_by(F.struct("ordinal", "spark_type", "kind", "integral"),
                                                 F.struct("batch", "ordinal")).alias("c"))
    catalog = newest.select(*COLUMN, "c.*")
    rows = (stats.groupBy(*FILE).agg(F.max("n_rows").alias("n")).groupBy("source").agg(F.sum("n").alias("source_rows")))
    total = stats.groupBy(*COLUMN).agg(
        *[F.sum(c).alias(c) for c in SUMMED], *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST],
        *_decimals_merged(), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("num_unique_values"))
    away = (stats.join(total.select(*COLUMN, F.col("mean").alias("gmean")), COLUMN).groupBy(*COLUMN).agg(
        (F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - F.col("gmean")) ** 2)).alias("m2")))
    few = smallest(stats.select(*COLUMN, F.inline("samples")), COLUMN, n_samples).select(
        *COLUMN, F.transform("samples", lambda x: x["value"]).alias("samples"))
    picked = total.selectExpr(*COLUMN, "n", "n_non_null", "num_unique_values", *EXTREMES, *_date_pick())
    out = (catalog.join(picked, COLUMN).join(away, COLUMN).join(few, COLUMN, "left").join(rows, "source")
           .withColumn("n_rows", F.col("source_rows"))  # a file without the column has nulls there
           .withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))
           .withColumn("distinct_error", F.lit(SKETCH_ERROR)))
    names = F.col("source") if by is None else F.element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), F.col("source"))
    return described(out.withColumn("table_name", names))

"""Approximate and pruned search (K5): inverted cells (IVF) and hashed buckets (LSH).

**Cells.** ``KMeans`` (pyspark.ml) is fitted on a bounded sample of the index vectors, every row is assigned to its
nearest centroid, and the index is written partitioned by cell, with each cell's size and radius (the largest
distance of a row to the centroid). A search runs in one or two rounds of the same *cell join*:

1. every question probes its ``n_probe`` nearest cells;
2. with ``bound=True`` also every other cell that may still hold a nearer row: by the triangle inequality no
   row of a cell is nearer than (distance to its centroid) - (its radius), so cells beyond the k-th
   distance found so far are never read. The result is exact.

**Buckets.** ``BucketedRandomProjectionLSH`` hashes questions and rows; ``per_key`` hashes make one key, each of
``tables`` keys is a bucket, and a question meets the rows of its buckets and only those. Scores are exact, recall depends on the keys.

**Cell join.** Questions are exploded to (question, cell) rows. A cell of more rows than the budget is salted into
several blocks, a cell that many questions probe gets several chunks of questions, and
``cogroup`` on (cell, block, chunk) scores one block against one chunk, each within
``max_broadcast_bytes`` and the group budget of exact search. Only probed cells are read (partition pruning on the written index).
No question passes through the driver, and every group yields at most ``k`` hits a question.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesonar.operators.retrieve import HIT_SCHEMA, MAX_BROADCAST_BYTES, TIE_DECIMALS, group_rows, score_group, spread
from lakesonar.session import new_table_path, ship_package

# The most rows KMeans is fitted on, the most bytes of centroids.
FIT_ROWS = 200_000
MAX_CENTROID_BYTES = 64 << 20


@dataclass
class Cells:
    """Centroids (cell, dimension), and each cell's radius and number of rows."""
    centers: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    metric: str

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Euclidean distances (vector, cell); cosine cells live on unit vectors."""
        sq = (vectors ** 2).sum(axis=1)[:, None] + (self.centers ** 2).sum(axis=1)[None, :] - 2 * vectors @ self.centers.T
        return np.sqrt(np.maximum(sq, 0.0))

    def reach(self, distance: np.ndarray) -> np.ndarray:
        """The Euclidean distance that a hit's distance stands for."""
        return np.sqrt(np.maximum(2 * distance if self.metric == "cosine" else distance, 0.0))


def _length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def _placed(index: DataFrame, metric: str, id_col: str, vec_col: str) -> DataFrame:
    """(id, embedding, point) of the rows with a direction (cosine) or a vector (l2sq)."""
    df = index.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    if metric != "cosine":
        return df.withColumn("point", F.col("embedding"))
    df = df.withColumn("_n", _length(F.col("embedding"))).filter("_n > 0")
    return df.withColumn("point", F.transform("embedding", lambda x: x / F.col("_n"))).drop("_n")


def build_ivf(index: DataFrame, n_cells: int = 16, seed: int = 42, path: str | None = None,
              id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine", fit_rows: int = FIT_ROWS):
    """Cluster the index vectors; returns (index with ``cell``, :class:`Cells`).

    ``fit_rows`` bounds (in expectation) the rows that KMeans sees; every row is assigned. The celled index is
    written partitioned by ``cell`` under ``path`` (default: the shared folder) and read back.
    """
    if metric not in ("cosine", "l2sq"):
        raise ValueError("metric must be 'cosine' or 'l2sq'")
    spark = index.sparkSession
    df = _placed(index, metric, id_col, vec_col)
    share = min(1.0, fit_rows / max(1, df.count()))
    points = df.select("id", "embedding", "point", array_to_vector("point").alias("features"))
    drawn = points if share >= 1 else points.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003)
    model = KMeans(k=n_cells, seed=seed, featuresCol="features", predictionCol="cell").fit(drawn)
    centers = np.array(model.clusterCenters(), dtype=np.float64)
    if centers.nbytes > MAX_CENTROID_BYTES:
        raise ValueError(f"{len(centers)} centroids exceed {MAX_CENTROID_BYTES} bytes: take fewer cells")
    path = path or new_table_path(spark, "ivf")
    (model.transform(points).select("id", "embedding", "point", F.col("cell").cast("int").alias("cell"))
     .write.mode("overwrite").partitionBy("cell").parquet(path))
    celled = spark.read.parquet(path)
    middles = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, middle array<double>")
    away = _length(F.zip_with("point", "middle", lambda a, b: a - b))
    source = celled.join(middles, "cell")  # one row a cell, bounded above
    radius, rows = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
    for r in source.groupBy("cell").agg(F.max(away).alias("far"), F.count(F.lit(1)).alias("n")).collect():  # one row a cell
        radius[r["cell"]], rows[r["cell"]] = r["far"], r["n"]
    return celled.drop("point"), Cells(centers, radius, rows, metric)


def cell_join(asked: DataFrame, index: DataFrame, sizes: DataFrame, k: int, metric: str, dim: int,
              max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hits of (qid, v, cell) questions among the (id, v, cell) rows of the same cell; ``sizes``
    (cell, n_rows, n_asked) tells how many blocks and chunks a cell is cut into."""
    per_group = group_rows(max_bytes, dim, k)
    cut = sizes.select("cell", F.ceil(F.col("n_rows") / per_group).cast("int").alias("blocks"),
                       F.ceil(F.col("n_asked") / per_group).cast("int").alias("chunks"))

    def places(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def part(key, n):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    qs = (asked.join(cut, "cell").withColumn("chunk", part("qid", "chunks"))
          .select("cell", "chunk", places("blocks").alias("block"), "qid", "v"))
    rows = (index.join(cut, "cell").withColumn("block", part("id", "blocks"))
            .select("cell", "block", places("chunks").alias("chunk"), "id", "v"))

    def run(qpdf, ipdf):
        return score_group(qpdf, ipdf, k, metric)

    keys = ["cell", "block", "chunk"]
    groups = int(cut.agg(F.sum(F.col("blocks").cast("long") * F.col("chunks"))).first()[0] or 0)
    return (spread(qs, groups, keys).groupBy(*keys)
            .cogroup(spread(rows, groups, keys).groupBy(*keys)).applyInPandas(run, HIT_SCHEMA))


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _asked(questions: DataFrame, q_id: str, q_vec: str, metric: str) -> tuple[DataFrame, int]:
    """(qid, v), checkpointed, of the questions that can match, and the dimension."""
    from lakesonar.session import shared_dir
    shared_dir(questions.sparkSession)
    qs = questions.select(F.col(q_id).cast("string").alias("qid"), F.col(q_vec).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    qs = qs.checkpoint(eager=True)
    return qs, int(qs.agg(F.max(F.size("v"))).first()[0] or 0)


def _typed(hits: DataFrame, questions: DataFrame, q_id: str) -> DataFrame:
    return hits.withColumn("query_id", F.col("query_id").cast(questions.schema[q_id].dataType)).withColumnRenamed("query_id", q_id)


def probed_cells(qs: DataFrame, cells: Cells, n_probe: int, found: DataFrame | None = None, k: int = 0) -> DataFrame:
    """(qid, v, cell): the ``n_probe`` nearest cells of each question or, with ``found`` (query_id,
    kth, n), all others that the bound does not rule out."""
    shared = qs.sparkSession.sparkContext.broadcast(cells)  # bounded by MAX_CENTROID_BYTES
    bounded = found is not None

    def choose(frames):
        c = shared.value
        for pdf in frames:
            if pdf.empty:
                continue
            v = np.stack([np.asarray(x, dtype=np.float64) for x in pdf["v"]])
            if c.metric == "cosine":
                n = np.linalg.norm(v, axis=1)
                v = v / np.where(n == 0, 1.0, n)[:, None]
            d = c.distances(v)
            near = np.argsort(d, axis=1, kind="stable")[:, :n_probe]
            take = np.zeros(d.shape, bool)
            np.put_along_axis(take, near, True, axis=1)
            if bounded:
                kth = c.reach(pdf["kth"].to_numpy(dtype=np.float64))
                kth = np.where(pdf["n"].to_numpy() < k, np.inf, kth)
                # a little room for rounded distances
                take = ~take & (c.rows > 0)[None, :] & (d - c.radius[None, :] <= kth[:, None] + 10.0 ** -(TIE_DECIMALS // 2))
            i, cell = np.nonzero(take)
            yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "cell": cell.astype("int32")})

    rows = qs if found is None else qs.join(
        found, qs["qid"] == found["query_id"], "left").select(
        "qid", "v", F.coalesce("kth", F.lit(0.0)).alias("kth"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.mapInPandas(choose, "qid string, v array<double>, cell int")


def _joined(asked: DataFrame, celled: DataFrame, cells: Cells, k: int, dim: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """The cell join over a written (qid, v, cell) table, and how often each cell is asked; other cells are not read."""
    n_asked = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    sizes = asked.sparkSession.createDataFrame(
        [(c, int(cells.rows[c]), n) for c, n in n_asked.items() if cells.rows[c]], "cell int, n_rows long, n_asked long")
    rows = celled.filter(F.col("cell").isin(sorted(n_asked))).select("id", F.col("embedding").alias("v"), "cell")
    return cell_join(asked, rows, sizes, k, cells.metric, dim, max_bytes), n_asked


def top_k_ivf(questions: DataFrame, celled: DataFrame, cells: Cells, k: int = 3,
              n_probe: int = 2, q_id: str = "query_id", q_vec: str = "embedding",
              max_broadcast_bytes: int = MAX_BROADCAST_BYTES, bound: bool = False) -> DataFrame:
    """(query_id, rank, id, score, distance, n_cells) over the probed cells; ``n_cells`` is the number
    of cells read for the question. ``bound=True`` goes on to every cell that may hold a nearer row: exact."""
    ship_package(questions.sparkSession)
    qs, dim = _asked(questions, q_id, q_vec, cells.metric)
    asked = probed_cells(qs, cells, n_probe).checkpoint(eager=True)
    hits = _best(_joined(asked, celled, cells, k, dim, max_broadcast_bytes)[0], k)
    seen = asked
    if bound:
        hits = hits.checkpoint(eager=True)  # at most k rows a question
        found = hits.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
        more = probed_cells(qs, cells, n_probe, found, k).checkpoint(eager=True)
        hits = _best(hits.drop("rank").union(_joined(more, celled, cells, k, dim, max_broadcast_bytes)[0]), k)
        seen = asked.union(more)
    n_cells = seen.groupBy(F.col("qid").alias("query_id")).agg(F.count(F.lit(1)).alias("n_cells"))
    return _typed(hits.join(n_cells, "query_id"), questions, q_id)


# LSH -----------------------------------------------------------------------

def _bucketed(df: DataFrame, model, tables: int, per_key: int) -> DataFrame:
    """``df`` once for each table, with the table's key as ``cell``."""
    hashed = model.transform(df.withColumn("features", array_to_vector("point")))
    one = [F.get(vector_to_array(F.get("hashes", F.lit(i))), F.lit(0)).cast("int") for i in range(tables * per_key)]
    keys = [F.xxhash64(F.lit(t), *one[t * per_key:(t + 1) * per_key]) for t in range(tables)]
    return hashed.select("id", "embedding", F.explode(F.array(*keys)).alias("cell"))


def top_k_lsh(questions: DataFrame, index: DataFrame, k: int = 3, metric: str = "cosine", tables: int = 16, per_key: int = 4,
              bucket_length: float = 0.5, seed: int = 42, q_id: str = "query_id", q_vec: str = "embedding",
              id_col: str = "id", vec_col: str = "embedding", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, id, score, distance, n_candidates) among the rows that share a bucket with the question.

    ``n_candidates`` counts the rows scored for a question (a row once for each bucket shared). More ``tables``
    raise the recall, more hashes ``per_key`` and shorter buckets lower the candidates; cosine buckets lie on unit vectors.
    """
    ship_package(questions.sparkSession)
    rows = _placed(index, metric, id_col, vec_col)
    qs, dim = _asked(questions, q_id, q_vec, metric)
    if not dim:  # no question has a vector
        return _typed(qs.sparkSession.createDataFrame([], HIT_SCHEMA).withColumns(
            {"rank": F.lit(1), "n_candidates": F.lit(0).cast("long")}), questions, q_id)
    asked = _placed(qs, metric, "qid", "v")
    # the projections depend on the dimension and the seed only
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=tables * per_key, seed=seed).fit(
        qs.sparkSession.createDataFrame([([0.0] * dim,)], "x array<double>").select(array_to_vector("x").alias("features")))
    asked = _bucketed(asked, model, tables, per_key).select(F.col("id").alias("qid"), F.col("embedding").alias("v"), "cell")
    rows = _bucketed(rows, model, tables, per_key).select("id", F.col("embedding").alias("v"), "cell")
    sizes = (rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))
             .join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n_asked")), "cell").checkpoint(eager=True))
    hits = cell_join(asked, rows, sizes, k, metric, dim, max_broadcast_bytes)
    hits = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("distance").alias("distance"))
    met = asked.join(sizes, "cell").groupBy(F.col("qid").alias("query_id")).agg(F.sum("n_rows").alias("n_candidates"))
    return _typed(_best(hits, k).join(met, "query_id"), questions, q_id)


def recall_at_k(approx: DataFrame, exact: DataFrame, q_id: str = "query_id") -> DataFrame:
    """Share of exact hits found by the approximate search, per question."""
    a = approx.select(q_id, "id").withColumn("found", F.lit(1))
    return (exact.select(q_id, "id").join(a, [q_id, "id"], "left")
            .groupBy(q_id).agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall")))

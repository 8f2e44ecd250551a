"""Vector search and similarity operators.

Both sides of a search or pair join are dealt into a grid of tiles of bounded size:
a row goes once to every tile of its row or column, a tile holds one side and
streams the other, and only results leave it. Nothing is collected or broadcast.
Scores are rounded to six places before they are ranked, ties go to the smaller id.
Null vectors match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors, and vectors of a pair join, that a tile holds.
QUERY_ROWS, PAIR_ROWS = 4096, 50_000
#: Streamed vectors compared in one step.
STEP = 1024
#: Rows that are worth a tile of their own where cores are free.
LEAST_ROWS = 512


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(col), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _tiles(left: DataFrame, right: DataFrame, across: int, down: int, half: bool = False) -> DataFrame:
    """Rows (id, v, grp) of both sides in partitions of one tile each: side 0 is a
    tile's held rows, side 1 the streamed ones. With ``half`` both sides are one
    table and only tiles on and above the diagonal are filled."""
    a = F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")
    b = F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")
    top, last = F.lit(0), F.lit(down - 1)
    held = left.select("id", "v", "grp", F.lit(0).alias("side"), a.alias("i")).withColumn("j", F.explode(F.sequence(F.col("i") if half else top, last)))
    flow = right.select("id", "v", "grp", F.lit(1).alias("side"), b.alias("j")).withColumn("i", F.explode(F.sequence(top, F.col("j") if half else F.lit(across - 1))))
    rows = held.select("id", "v", "grp", "side", "i", "j").unionByName(flow)
    return rows.repartitionById(across * down, F.col("i") * down + F.col("j")).sortWithinPartitions("side").select("id", "v", "grp", "side", (F.col("i") == F.col("j")).alias("diagonal"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(held ids, unit vectors, groups, streamed ids, unit vectors, groups, diagonal) step by step."""
    ids, vectors, groups = [], [], []
    held = None
    for batch in batches:
        side = batch.column(3).to_numpy()
        cut = int(np.searchsorted(side, 1))
        if cut:
            ids.append(batch.column(0)[:cut].to_numpy())
            vectors.append(_matrix(batch.column(1).slice(0, cut)))
            groups.append(np.array(batch.column(2)[:cut].to_pylist(), dtype=object))
        for lo in range(cut, batch.num_rows, STEP):
            if not ids:
                return
            if held is None:
                held = np.concatenate(ids), np.concatenate(vectors), np.concatenate(groups)
            part = batch.slice(lo, STEP)
            yield *held, part.column(0).to_numpy(), _matrix(part.column(1)), np.array(part.column(2).to_pylist(), dtype=object), part.column(4)[0].as_py()


def _rows(df: DataFrame, id_col: str, vec_col: str, group_col: str | None = None) -> DataFrame:
    grp = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    return df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), grp.alias("grp"))


def _parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def knn(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """V2, V4, O1: the exact ``k`` best items of each query: query_id, item_id, score, rank."""
    q, e = _rows(queries, id_col, vec_col), _rows(items, id_col, vec_col)
    n = e.count()
    across = max(1, -(-q.count() // QUERY_ROWS))
    down = max(1, min(_parallelism(e), -(-n // LEAST_ROWS)), -(-n // (20 * PAIR_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for ids, held, _, own, flow, _, _ in _stream(batches):
            score = np.round(held @ flow.T, 6)
            if skip_self:
                score[ids[:, None] == own[None]] = -np.inf
            named = np.broadcast_to(own, score.shape)
            if best is not None:
                score, named = np.concatenate([best[1], score], 1), np.concatenate([best[2], named], 1)
            top = np.lexsort((named, -score), axis=1)[:, :k]
            best = ids, np.take_along_axis(score, top, 1), np.take_along_axis(named, top, 1)
        if best is not None:
            keep = np.isfinite(best[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(best[0], best[1].shape[1])[keep.ravel()]), pa.array(best[2][keep]), pa.array(best[1][keep])], names=["query_id", "item_id", "score"])

    near = _tiles(q, e, across, down).mapInArrow(run, "query_id long, item_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", other: DataFrame | None = None,
                  group_col: str | None = None) -> DataFrame:
    """Exact pairs of cosine at least ``threshold``: a, b, score.

    Within one table a < b; with ``other`` every (row, other row) pair counts; with
    ``group_col`` only rows of one group pair.
    """
    left = _rows(vectors, id_col, vec_col, group_col)
    right = left if other is None else _rows(other, id_col, vec_col, group_col)
    cores = int(np.ceil(np.sqrt(2 * _parallelism(vectors))))

    def parts(df: DataFrame) -> int:
        n = df.count()
        return max(1, -(-n // PAIR_ROWS), min(cores, -(-n // LEAST_ROWS)))

    across = parts(left)
    down = across if other is None else parts(right)
    same, grouped = other is None, group_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, g, own, flow, h, diagonal in _stream(batches):
            found = np.round(held @ flow.T, 6)
            ok = found >= threshold
            if grouped:
                ok &= g[:, None] == h[None]
            if same and diagonal:
                ok &= ids[:, None] < own[None]
            i, j = np.nonzero(ok)
            a, b = ids[i], own[j]
            if same:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(found[i, j])], names=["a", "b", "score"])

    return _tiles(left, right, across, down, half=same).mapInArrow(run, "a long, b long, score double")


def similar_pairs_top(vectors: DataFrame, threshold: float, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each row first, threshold and a < b afterwards."""
    near = knn(vectors, vectors, k, id_col, vec_col, skip_self=False)
    return near.filter((F.col("score") > threshold) & (F.col("query_id") < F.col("item_id"))).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), "score")


def cross_source_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs across two sources, then pairs among the unmatched of the second."""
    cross = similar_pairs(left, threshold, other=right).withColumn("kind", F.lit("cross"))
    rest = right.join(cross.select(F.col("b").alias("vec_id")).distinct(), "vec_id", "left_anti")
    return cross.unionByName(similar_pairs(rest, threshold).withColumn("kind", F.lit("within")))


def mean_pairwise(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """V7: mean cosine over all pairs of each group, 1.0 below two members.

    With unit vectors the sum over pairs is (|sum|^2 - n) / 2, so no pair is formed.
    """
    from ..functions.vectors import norm

    unit = vectors.withColumn("__n", norm(F.col(vec_col))).select(group_col, F.posexplode(vec_col).alias("i", "x"), "__n")
    sums = unit.groupBy(group_col, "i").agg(F.sum(F.col("x").cast("double") / F.col("__n")).alias("s"), F.count("*").alias("n"))
    per = sums.groupBy(group_col).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return per.select(group_col, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("consistency"))


def semantic_entropy(clusters: DataFrame, group_col: str, cluster_col: str) -> DataFrame:
    """V8: entropy of cluster sizes over the log of the members; below two members 0."""
    sizes = clusters.groupBy(group_col, cluster_col).agg(F.count("*").alias("__size")).withColumn("__all", F.sum("__size").over(Window.partitionBy(group_col)))
    p = F.col("__size") / F.col("__all")
    return sizes.groupBy(group_col).agg(F.max("__all").alias("n"), F.sum(-p * F.log(p)).alias("__h")).select(
        group_col, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.col("__h") / F.log("n")).alias("entropy"))


def greedy_clusters(vectors: DataFrame, group_col: str, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """V5, V6: in ascending id, join the first cluster whose leader is near enough,
    else found a new one; order-dependent, so one group is one task."""
    def run(pdf):
        pdf = pdf.sort_values(id_col, kind="stable")
        m = _unit(pdf[vec_col].tolist())
        leaders: list[int] = []
        out = []
        for i in range(len(m)):
            sims = m[leaders] @ m[i] if leaders else np.empty(0)
            hit = np.flatnonzero(sims >= threshold)
            if len(hit):
                out.append(leaders[hit[0]])
            else:
                leaders.append(i)
                out.append(i)
        ids = pdf[id_col].to_numpy()
        return pdf[[group_col, id_col]].assign(leader=ids[out])

    kinds = dict(vectors.dtypes)
    return vectors.groupBy(group_col).applyInPandas(run, f"{group_col} {kinds[group_col]}, {id_col} {kinds[id_col]}, leader {kinds[id_col]}")


def semantic_prf(predicted: DataFrame, gold: DataFrame, group_col: str, threshold: float) -> DataFrame:
    """V9: precision, recall and F1 of vectors matched by best cosine per group."""
    met = similar_pairs(predicted, threshold, "id", "v", other=gold, group_col=group_col)

    def share(side: DataFrame, other: DataFrame, col: str, out: str) -> DataFrame:
        mine = side.select(group_col, "id").join(other.select(group_col).distinct(), group_col, "left_semi")
        hit = mine.join(met.select(F.col(col).alias("id")).distinct().withColumn("ok", F.lit(1)), "id", "left")
        return hit.groupBy(group_col).agg((F.count("ok") / F.count("*")).alias(out))

    hit_p, hit_g = share(predicted, gold, "a", "precision"), share(gold, predicted, "b", "recall")
    p, r = F.col("precision"), F.col("recall")
    return hit_p.join(hit_g, group_col).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def kmeans(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int | None = None, seed: int = 42) -> DataFrame:
    """K-means with k = min(max(2, n // 3), 8) unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = k or min(max(2, vectors.count() // 3), 8)
    data = vectors.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data).select(id_col, "cluster")


def hashed_embedding(texts: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """A deterministic stand-in for a text model: hashed word counts, unit length."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import words

    tf = HashingTF(numFeatures=dim, inputCol="w", outputCol="f").transform(texts.select(id_col, words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")))
    v = vector_to_array("f")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return tf.select(id_col, F.transform(v, lambda x: F.when(length == 0, 0.0).otherwise(x / length)).alias("embedding"))


def name_similarity(a, b):
    """1 for equal, .85 for contained, else word Jaccard."""
    la, lb = F.lower(a), F.lower(b)
    wa, wb = F.split(la, " "), F.split(lb, " ")
    j = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    return F.when(la == lb, 1.0).when(F.contains(la, lb) | F.contains(lb, la), 0.85).otherwise(j)

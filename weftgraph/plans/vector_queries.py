"""Vector search, similarity and resolution queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, cosine_unit
from ..operators import graph as G
from ..operators import upserts as U
from ..operators import vectors as V
from ..sources.tables import load
from .registry import query

#: Rows with an id divisible by this are the query set of the searches.
QUERY_STEP = 20

COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("knn_top5", f"""SELECT query_id, item_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COS} AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_top5(spark, sf_dir):
    """V2, V4, O1."""
    e = load(spark, sf_dir, "embeddings")
    return V.knn(e.filter(F.col("vec_id") % QUERY_STEP == 0), e, 5)


@query("knn_threshold", f"""SELECT query_id, item_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COS} AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank = 1 AND score > 0.3""")
def knn_threshold(spark, sf_dir):
    """V3: the best match if it is good enough."""
    e = load(spark, sf_dir, "embeddings")
    return V.knn(e.filter(F.col("vec_id") % QUERY_STEP == 0), e, 1).filter("score > 0.3").select("query_id", "item_id", "score")


@query("similar_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.3")
def similar_pairs(spark, sf_dir):
    """J18, V5."""
    return V.similar_pairs(load(spark, sf_dir, "embeddings"), 0.3)


@query("similar_pairs_top", f"""SELECT a, b, score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r
 FROM embeddings a JOIN embeddings b ON true) WHERE r <= 5 AND score > 0.3 AND a < b""")
def similar_pairs_top(spark, sf_dir):
    """Top five first, threshold afterwards."""
    return V.similar_pairs_top(load(spark, sf_dir, "embeddings"), 0.3)


CROSS = f"""c AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE {COS} >= 0.35),
r AS (SELECT * FROM embeddings WHERE vec_id % 2 = 1 AND vec_id NOT IN (SELECT b FROM c))"""


@query("cross_source_pairs", f"""WITH {CROSS} SELECT a, b, score, 'cross' AS kind FROM c UNION ALL
SELECT a.vec_id, b.vec_id, {COS}, 'within' FROM r a JOIN r b ON a.vec_id < b.vec_id WHERE {COS} >= 0.35""")
def cross_source_pairs(spark, sf_dir):
    """Even and odd ids are the two sources."""
    e = load(spark, sf_dir, "embeddings")
    return V.cross_source_pairs(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), 0.35)


@query("cosine_variants", """SELECT a.vec_id, round(d / (n + 1e-8), 6) AS eps8, round(d / (n + 1e-10), 6) AS eps10, round(greatest(0.0, least(1.0, d / n)), 6) AS clamped FROM (
 SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS n
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def cosine_variants(spark, sf_dir):
    """V1."""
    e = load(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    a, b = F.col("embedding"), F.col("v")
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(a, b, 1e-8), 6).alias("eps8"), F.round(cosine(a, b, 1e-10), 6).alias("eps10"), F.round(cosine_unit(a, b), 6).alias("clamped"))


@query("embedding_consistency", f"SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS consistency FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def embedding_consistency(spark, sf_dir):
    """V7."""
    return V.mean_pairwise(load(spark, sf_dir, "embeddings"), "label").select("label", F.round("consistency", 6).alias("consistency"))


@query("semantic_entropy", """SELECT grp, n, CASE WHEN n < 2 THEN 0.0 ELSE round(-sum(p * ln(p)) / ln(n), 6) END AS entropy FROM (
 SELECT vec_id % 7 AS grp, label, count(*) / sum(count(*)) OVER (PARTITION BY vec_id % 7) AS p, sum(count(*)) OVER (PARTITION BY vec_id % 7) AS n FROM embeddings GROUP BY 1, 2) GROUP BY grp, n""")
def semantic_entropy(spark, sf_dir):
    """V8."""
    e = load(spark, sf_dir, "embeddings").withColumn("grp", F.col("vec_id") % 7)
    return V.semantic_entropy(e, "grp", "label").select("grp", "n", F.round("entropy", 6).alias("entropy"))


@query("semantic_prf", f"""WITH m AS (SELECT a.label, a.vec_id AS p, b.vec_id AS g, {COS} >= 0.2 AS ok FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
p AS (SELECT label, avg(ok::INT) AS precision FROM (SELECT label, p, bool_or(ok) AS ok FROM m GROUP BY 1, 2) GROUP BY 1), g AS (SELECT label, avg(ok::INT) AS recall FROM (SELECT label, g, bool_or(ok) AS ok FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM p JOIN g USING(label)""")
def semantic_prf(spark, sf_dir):
    """V9."""
    e = load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = V.semantic_prf(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "label", 0.2)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("greedy_dedup")
def greedy_dedup(spark, sf_dir):
    """V5, V6."""
    return V.greedy_clusters(load(spark, sf_dir, "embeddings"), "label", 0.3)


@query("kmeans_chunks")
def kmeans_chunks(spark, sf_dir):
    """V11."""
    return V.kmeans(load(spark, sf_dir, "embeddings"))


@query("hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    """V10."""
    return V.hashed_embedding(load(spark, sf_dir, "documents"), "doc_id", "text", 32)


@query("resolution_groups", f"""WITH RECURSIVE c AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.4), b AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
w AS (SELECT DISTINCT a AS id, a AS r FROM b UNION SELECT w.id, b.b FROM w JOIN b ON b.a = w.r)
SELECT id, min(r) AS component FROM w GROUP BY id""")
def resolution_groups(spark, sf_dir):
    """Near pairs closed into groups."""
    p = V.similar_pairs(load(spark, sf_dir, "embeddings"), 0.4)
    return G.components(p.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("knn_onehop", f"""WITH k AS (SELECT query_id, item_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5),
l AS (SELECT i.vec_id AS item_id, o.vec_id AS other FROM embeddings i JOIN embeddings o ON i.label = o.label AND i.vec_id <> o.vec_id AND abs(i.vec_id - o.vec_id) <= 25)
SELECT query_id, k.item_id, score, rank, count(other) AS n_links, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY other), '') AS linked FROM k LEFT JOIN l USING(item_id) GROUP BY 1, 2, 3, 4""")
def knn_onehop(spark, sf_dir):
    """Nearest neighbours with their links."""
    return _onehop(load(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


def _onehop(e, asked):
    near = V.knn(e.filter(asked), e, 5)
    i, o = e.select(F.col("vec_id").alias("item_id"), "label"), e.select(F.col("vec_id").alias("other"), "label")
    links = i.join(near.select("item_id").distinct(), "item_id", "left_semi").join(o, "label").filter((F.col("item_id") != F.col("other")) & (F.abs(F.col("item_id") - F.col("other")) <= 25))
    got = links.groupBy("item_id").agg(F.array_sort(F.collect_list("other")).alias("o"))
    return near.join(got, "item_id", "left").select(
        "query_id", "item_id", "score", "rank", F.coalesce(F.size("o"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.array_join(F.transform("o", lambda x: x.cast("string")), ","), F.lit("")).alias("linked"))


@query("dual_search", f"""WITH s AS (SELECT b.vec_id AS item_id, {COS} AS score, a.vec_id AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (1,2,3)),
p AS (SELECT item_id, score, q AS pass, r FROM s WHERE (q = 1 AND r <= 5) OR (q IN (2,3) AND r <= 3))
SELECT item_id, score, pass FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pass, r) AS n FROM p) WHERE n = 1""")
def dual_search(spark, sf_dir):
    """Primary and follow-up searches, the first pass of an item wins."""
    e = load(spark, sf_dir, "embeddings")
    s = V.knn(e.filter("vec_id in (1, 2, 3)"), e, 5).filter("query_id = 1 or rank <= 3")
    return U.first_writer(s, ["item_id"], [F.col("query_id"), F.col("rank")]).select("item_id", "score", F.col("query_id").alias("pass"))

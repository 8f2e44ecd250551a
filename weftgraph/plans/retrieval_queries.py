"""Retrieval compositions over benchmark questions and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import vectors as V
from ..sources.tables import EDGES_SQL, edges, load, node_id
from .registry import query
from .text_queries import WORDS, _in
from .vector_queries import QUERY_STEP

_KW = f"""k AS (SELECT DISTINCT item_id AS qid, kw FROM (SELECT item_id, unnest(list_slice(list_distinct_ordered, 1, 4)) AS kw FROM (
 SELECT item_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (
 SELECT item_id, list_transform(list_filter({WORDS.format(c='text')}, lambda w: length(w) > 2 AND w NOT IN {_in(X.STOP_QUERY)}), lambda w: trim(w, '''\",.?!')) AS w FROM benchmark WHERE item_id % 20 = 0))) WHERE kw <> '')"""


@query("keyword_documents", f"""WITH {_KW}, h AS (SELECT qid, doc_id, count(*) AS hits FROM k JOIN documents ON contains(lower(text), kw) GROUP BY 1, 2)
SELECT qid, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, doc_id) AS r FROM h) WHERE r <= 20""")
def keyword_documents(spark, sf_dir):
    """Every twentieth benchmark item is a question."""
    q = load(spark, sf_dir, "benchmark").filter(F.col("item_id") % QUERY_STEP == 0).select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return R.keyword_pass(q, load(spark, sf_dir, "documents")).select("qid", "doc_id", "hits")


def _vector_hits(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    near = V.knn(e.filter(F.col("vec_id") % QUERY_STEP == 0), e, 5)
    return near.select(F.col("query_id").alias("qid"), F.concat(F.lit("v"), F.col("item_id")).alias("node"), "score")


def _label_edges(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id")
    return e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("src"), F.concat(F.lit("v"), F.col("vec_id") + 1).alias("dst"), F.lit("NEXT").alias("rel_type"))


_VEC = """h AS (SELECT qid, 'v'||item AS node, score FROM (SELECT a.vec_id AS qid, b.vec_id AS item, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 5)"""
_EXP = """e AS (SELECT 'v'||vec_id AS a, 'v'||(vec_id + 1) AS b FROM embeddings), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
x AS (SELECT DISTINCT qid, u.b AS node FROM h JOIN u ON u.a = h.node EXCEPT SELECT qid, node FROM h)"""


@query("retrieve_expand", f"WITH {_VEC}, {_EXP} SELECT qid, node, 0 AS hop FROM h UNION ALL SELECT qid, node, 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY node) AS r FROM x) WHERE r <= 30")
def retrieve_expand(spark, sf_dir):
    """Nearest vectors and their neighbours in a chain."""
    return R.expand(_vector_hits(spark, sf_dir), _label_edges(spark, sf_dir))


@query("hybrid_retrieval", f"""WITH {_VEC}, {_EXP}, p AS (SELECT qid, node, score, 0 AS pass FROM h UNION ALL SELECT qid, node, 0.0, 1 FROM x)
SELECT qid, node, score, pass FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pass, score DESC, node) AS r FROM p) WHERE r <= 15""")
def hybrid_retrieval(spark, sf_dir):
    """R5, U2."""
    h = _vector_hits(spark, sf_dir)
    return R.hybrid(h, R.expand(h, _label_edges(spark, sf_dir))).select("qid", "node", "score", "pass")


@query("graph_lookup", f"""WITH {EDGES_SQL}, k AS (SELECT c_custkey AS key, 'customer:'||c_custkey AS id, c_nationkey AS community FROM customer),
l AS (SELECT src AS id, rel_type||' -> '||dst AS line FROM edges WHERE rel_type = 'LIVES_IN' UNION ALL SELECT dst, rel_type||' <- '||src FROM edges WHERE rel_type = 'PLACED_BY'),
r AS (SELECT id, string_agg(line, ',' ORDER BY line) AS relations FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS n FROM l) WHERE n <= 15 GROUP BY 1),
o AS (SELECT 'customer:'||o_custkey AS id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) AS episodes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 5 GROUP BY 1),
m AS (SELECT community, id, key, row_number() OVER (PARTITION BY community ORDER BY key) AS n FROM k),
c AS (SELECT k.id, string_agg(m.id, ',' ORDER BY m.n) AS members FROM k JOIN m ON m.community = k.community AND m.id <> k.id AND m.n <= 6
  WHERE m.n <= CASE WHEN EXISTS (SELECT 1 FROM m x WHERE x.id = k.id AND x.n <= 5) THEN 6 ELSE 5 END GROUP BY 1)
SELECT k.id, coalesce(relations, '') AS relations, coalesce(episodes, '') AS episodes, coalesce(members, '') AS members FROM k LEFT JOIN r USING(id) LEFT JOIN o USING(id) LEFT JOIN c USING(id)""")
def graph_lookup(spark, sf_dir):
    """Relations with direction, the five newest episodes and five fellow members of each customer."""
    c = load(spark, sf_dir, "customer").select(node_id("customer", "c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("community"))
    ep = load(spark, sf_dir, "orders").select(node_id("customer", "o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("episode_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ord"))
    links = edges(spark, sf_dir, ["LIVES_IN", "PLACED_BY"]).filter((F.col("rel_type") == "LIVES_IN") | F.col("dst").startswith("customer:"))
    return R.graph_lookup(c, links, ep)


@query("rerank_stub", f"""WITH {_KW}, h AS (SELECT qid, doc_id, count(*) AS hits FROM k JOIN documents ON contains(lower(text), kw) GROUP BY 1, 2),
t AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, doc_id) AS r FROM h) WHERE r <= 10),
s AS (SELECT qid, t.doc_id, len(list_distinct(list_intersect({WORDS.format(c='b.text')}, {WORDS.format(c='d.text')}))) AS n FROM t JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = t.doc_id)
SELECT qid, doc_id, round(1 / (1 + exp(-(n / 5.0 - 1))), 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY round(1 / (1 + exp(-(n / 5.0 - 1))), 6) DESC, doc_id) AS rank FROM s""")
def rerank_stub(spark, sf_dir):
    """Keyword hits reordered by the stand-in scorer."""
    b = load(spark, sf_dir, "benchmark").filter(F.col("item_id") % QUERY_STEP == 0).select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    docs = load(spark, sf_dir, "documents")
    hits = R.keyword_pass(b, docs, limit=10)
    return R.rerank(hits.join(b, "qid").join(docs.select("doc_id", "text"), "doc_id")).select("qid", "doc_id", "rerank_score", "rank")


@query("chunk_sources", """SELECT doc_id AS source_id, 'c'||doc_id AS chunk_id, 'https://docs/'||source AS source_url FROM documents""")
def chunk_sources(spark, sf_dir):
    """Chunks that a search returned, with where they come from."""
    d = load(spark, sf_dir, "documents")
    chunks = d.select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), F.col("doc_id").alias("source_id"), F.concat(F.lit("https://docs/"), F.col("source")).alias("source_url"))
    hits = d.select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"))
    return R.with_source(hits, chunks).select("source_id", "chunk_id", "source_url")


@query("layer_routing", "SELECT conv_id, turn, layer FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'all' WHEN 'user' THEN 'retrieval' ELSE 'generation' END AS kind FROM conversations) c JOIN (VALUES ('retrieval'),('generation')) l(layer) ON kind = 'all' OR kind = layer")
def layer_routing(spark, sf_dir):
    """Rows of type all belong to every layer."""
    kind = F.when(F.col("role") == "system", "all").when(F.col("role") == "user", "retrieval").otherwise("generation")
    layers = F.when(kind == "all", F.array(F.lit("retrieval"), F.lit("generation"))).otherwise(F.array(kind))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(layers).alias("layer"))


@query("elapsed_limit", "SELECT user_id, max(ts) - min(ts) >= INTERVAL 25 DAY AS over FROM events GROUP BY 1")
def elapsed_limit(spark, sf_dir):
    """whether a run has used up its time."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg((F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) >= 25 * 86400).alias("over"))


@query("graph_sample", "SELECT c_custkey, c_name, o_orderkey FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 30) LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def graph_sample(spark, sf_dir):
    """The first entities with one relationship each (a sample by design)."""
    c = load(spark, sf_dir, "customer").orderBy("c_custkey").limit(30).select("c_custkey", "c_name")
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return c.join(o, "c_custkey", "left")


@query("golden_review", "SELECT kind, difficulty, n, CASE WHEN n >= 3 THEN 'approved' ELSE 'pending' END AS review_status FROM (SELECT k.kind, d.difficulty, k.w * d.w AS n FROM (VALUES ('retrieval', 1), ('agentic', 2)) k(kind, w), (VALUES ('easy', 3), ('hard', 1)) d(difficulty, w))")
def golden_review(spark, sf_dir):
    """Case counts by type and difficulty with their review status."""
    k = spark.createDataFrame([("retrieval", 1), ("agentic", 2)], "kind string, a int")
    d = spark.createDataFrame([("easy", 3), ("hard", 1)], "difficulty string, b int")
    n = F.col("a") * F.col("b")
    return k.crossJoin(d).select("kind", "difficulty", n.alias("n"), F.when(n >= 3, "approved").otherwise("pending").alias("review_status"))


@query("ontology_assignment", "SELECT p_type, coalesce(m.t, p_type) AS assigned, count(*) AS n FROM part LEFT JOIN (VALUES ('ECONOMY','Cheap'),('SMALL','Tiny')) m(k, t) ON k = p_type GROUP BY 1, 2")
def ontology_assignment(spark, sf_dir):
    """Open labels through an assignment table, themselves by default."""
    m = spark.createDataFrame([("ECONOMY", "Cheap"), ("SMALL", "Tiny")], "p_type string, t string")
    return load(spark, sf_dir, "part").join(F.broadcast(m), "p_type", "left").groupBy("p_type", F.coalesce("t", "p_type").alias("assigned")).agg(F.count("*").alias("n"))


@query("remapped_edges", "SELECT DISTINCT 'g'||(l_suppkey % 7) AS src, 'p'||l_partkey AS dst, 'SUPPLIES' AS rel_type FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)")
def remapped_edges(spark, sf_dir):
    """One id per entity, edges remapped to merged ids before they are joined."""
    from ..operators import upserts as U

    li = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("SUPPLIES").alias("rel_type"))
    m = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("old"), F.concat(F.lit("g"), F.col("s_suppkey") % 7).alias("primary"))
    return U.transfer_edges(li.distinct(), m)

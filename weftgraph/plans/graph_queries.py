"""Graph pattern, traversal and community queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, load, node_id, nodes
from .registry import query

UND = """und AS (SELECT src AS node, dst AS other, rel_type, true AS is_outgoing FROM edges
  UNION ALL SELECT dst, src, rel_type, false FROM edges WHERE src <> dst)"""


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node string")


@query("one_hop_undirected", f"""WITH {EDGES_SQL}, {UND}, hit AS (SELECT * FROM und WHERE node IN ('customer:1','nation:3','part:7'))
SELECT node, other, rel_type, is_outgoing FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rel_type, other, is_outgoing) AS r FROM hit) WHERE r <= 20""")
def one_hop_undirected(spark, sf_dir):
    """J1."""
    seeds = ["customer:1", "nation:3", "part:7"]
    return G.one_hop(_seeds(spark, *seeds), edges(spark, sf_dir, touching=seeds)).select("node", "other", "rel_type", "is_outgoing")


@query("neighbours_distinct", f"""WITH {EDGES_SQL}, {UND}, hit AS (SELECT DISTINCT node, other, rel_type FROM und WHERE node IN ('supplier:1','part:5'))
SELECT node, other, rel_type FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rel_type, other) AS r FROM hit) WHERE r <= 30""")
def neighbours_distinct(spark, sf_dir):
    """J2."""
    seeds = ["supplier:1", "part:5"]
    return G.neighbours(_seeds(spark, *seeds), edges(spark, sf_dir, touching=seeds)).select("node", "other", "rel_type")


@query("one_hop_collect", f"""WITH {EDGES_SQL}, {NODES_SQL}, heads AS (SELECT id AS node FROM nodes WHERE label IN ('nation','region','supplier'))
SELECT h.node, count(e.dst) AS n_links, coalesce(string_agg(e.rel_type||'>'||e.dst, ',' ORDER BY e.rel_type, e.dst), '') AS links
FROM heads h LEFT JOIN edges e ON e.src = h.node GROUP BY h.node""")
def one_hop_collect(spark, sf_dir):
    """J3."""
    heads = nodes(spark, sf_dir).filter(F.col("label").isin("nation", "region", "supplier")).select(F.col("id").alias("node"))
    e = edges(spark, sf_dir, ["IN_REGION", "BASED_IN"])
    out = G.outgoing_collected(heads, e)
    real = F.filter("links", lambda x: x["dst"].isNotNull())
    return out.select("node", F.size(real).cast("long").alias("n_links"), F.array_join(F.transform(real, lambda x: F.concat(x["rel_type"], F.lit(">"), x["dst"])), ",").alias("links"))


@query("in_out_collect", f"""WITH {EDGES_SQL}, {NODES_SQL}, heads AS (SELECT id AS node FROM nodes WHERE label = 'nation'),
o AS (SELECT src AS node, string_agg(DISTINCT dst, ',' ORDER BY dst) AS outgoing FROM edges GROUP BY src),
i AS (SELECT dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS incoming FROM edges GROUP BY dst)
SELECT h.node, coalesce(outgoing,'') AS outgoing, coalesce(incoming,'') AS incoming FROM heads h LEFT JOIN o USING(node) LEFT JOIN i USING(node)""")
def in_out_collect(spark, sf_dir):
    """J4."""
    heads = nodes(spark, sf_dir).filter(F.col("label") == "nation").select(F.col("id").alias("node"))
    out = G.in_out_collected(heads, edges(spark, sf_dir, ["IN_REGION", "LIVES_IN", "BASED_IN"]))
    return out.select("node", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"))


def _pattern_sql(where: str, limit: int = 20) -> str:
    return f"WITH {EDGES_SQL} SELECT src, dst, rel_type FROM edges WHERE {where} ORDER BY rel_type, src, dst LIMIT {limit}"


@query("pattern_out", _pattern_sql("src = 'customer:4' AND rel_type = 'LIVES_IN'"))
def pattern_out(spark, sf_dir):
    """J5, J9."""
    return G.pattern("customer:4 -[LIVES_IN]-> ?", edges(spark, sf_dir, touching=["customer:4"])).select("src", "dst", "rel_type")


@query("pattern_in", _pattern_sql("dst = 'nation:7' AND rel_type = 'LIVES_IN'"))
def pattern_in(spark, sf_dir):
    """J6, J9."""
    return G.pattern("? -[LIVES_IN]-> nation:7", edges(spark, sf_dir, touching=["nation:7"])).select("src", "dst", "rel_type")


@query("pattern_between", _pattern_sql("src = 'part:1' AND dst LIKE 'supplier:%'", 10).replace("dst LIKE 'supplier:%'", "dst = 'supplier:3'"))
def pattern_between(spark, sf_dir):
    """J7, J9."""
    return G.pattern("part:1 -[?]-> supplier:3", edges(spark, sf_dir, touching=["part:1"]), limit=10).select("src", "dst", "rel_type")


@query("khop_paths", f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT * FROM edges WHERE rel_type IN ('PLACED_BY','LIVES_IN','IN_REGION')),
w AS (SELECT src AS start, dst AS node, 1 AS hops, rel_type AS chain FROM e WHERE src LIKE 'customer:%' OR src LIKE 'orders:1_'
  UNION ALL SELECT w.start, e.dst, hops + 1, chain||'>'||e.rel_type FROM w JOIN e ON e.src = w.node WHERE hops < 3)
SELECT start, node, hops, chain FROM w""")
def khop_paths(spark, sf_dir):
    """J8."""
    e = edges(spark, sf_dir, ["PLACED_BY", "LIVES_IN", "IN_REGION"])
    seeds = e.select(F.col("src").alias("node")).distinct().filter(F.col("node").startswith("customer:") | F.col("node").like("orders:1_"))
    return G.paths(seeds, e, 3)


@query("two_hop_sample", f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type IN ('LIVES_IN','IN_REGION','BASED_IN')),
b AS (SELECT src AS node, dst AS next FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT node FROM b WHERE node LIKE 'supplier:%'),
l1 AS (SELECT DISTINCT b.next AS node FROM s JOIN b USING(node) WHERE b.next NOT IN (SELECT node FROM s)),
l2 AS (SELECT DISTINCT b.next AS node FROM l1 JOIN b USING(node) WHERE b.next NOT IN (SELECT node FROM s UNION SELECT node FROM l1))
SELECT node, 0 AS level FROM s UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def two_hop_sample(spark, sf_dir):
    """J10, J11."""
    e = edges(spark, sf_dir, ["LIVES_IN", "IN_REGION", "BASED_IN"])
    seeds = load(spark, sf_dir, "supplier").select(node_id("supplier", "s_suppkey").alias("node"))
    return G.within_hops(seeds, e, 2)


@query("comembership", """SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS grp FROM supplier a JOIN supplier b USING(s_nationkey) WHERE a.s_suppkey <> b.s_suppkey""")
def comembership(spark, sf_dir):
    """J12."""
    return G.comembers(load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")).select("a", "b", "grp")


@query("unprocessed_docs", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed_docs(spark, sf_dir):
    """J13, S15, U5."""
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("has_edges", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def has_edges(spark, sf_dir):
    """J15."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("context_children", """SELECT n_nationkey, kind, id FROM (
  SELECT n_nationkey, kind, id, row_number() OVER (PARTITION BY n_nationkey, kind ORDER BY id) AS r FROM (
    SELECT c_nationkey AS n_nationkey, 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier)) WHERE r <= 20""")
def context_children(spark, sf_dir):
    """Up to twenty incoming neighbours of each type."""
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return G.top_per_group(c.unionByName(s), ["n_nationkey", "kind"], [F.col("id")], 20)


@query("set_pairs", "SELECT a.n_regionkey AS grp, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def set_pairs(spark, sf_dir):
    """J27."""
    n = load(spark, sf_dir, "nation")
    return G.comembers(n.select("n_regionkey", "n_nationkey")).filter("a < b").select("grp", "a", "b")


@query("typed_union", f"""WITH {EDGES_SQL} SELECT DISTINCT e.src, e.dst, e.rel_type, s.s_name AS name FROM edges e LEFT JOIN supplier s ON e.src = 'supplier:'||s.s_suppkey
WHERE e.rel_type IN ('IN_REGION','BASED_IN')""")
def typed_union(spark, sf_dir):
    """Allow-listed edge types with an optional name."""
    e = edges(spark, sf_dir).filter(F.col("rel_type").isin("IN_REGION", "BASED_IN"))
    s = load(spark, sf_dir, "supplier").select(node_id("supplier", "s_suppkey").alias("src"), F.col("s_name").alias("name"))
    return e.join(s, "src", "left").distinct().select("src", "dst", "rel_type", "name")


@query("excluded_types", f"""WITH {EDGES_SQL} SELECT rel_type, count(*) AS n, count(DISTINCT src) AS sources FROM edges WHERE rel_type NOT IN ('CONTAINS','SUPPLIED_BY') GROUP BY 1""")
def excluded_types(spark, sf_dir):
    """Every edge but those of the excluded types."""
    e = edges(spark, sf_dir).filter(~F.col("rel_type").isin("CONTAINS", "SUPPLIED_BY"))
    return e.groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query("full_scan", f"WITH {NODES_SQL} SELECT id, label, name FROM nodes")
def full_scan(spark, sf_dir):
    """Every node of every label."""
    return nodes(spark, sf_dir)


@query("traversal_counts", f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type IN ('LIVES_IN','IN_REGION','BASED_IN')),
one AS (SELECT src, dst FROM e), two AS (SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src)
SELECT src AS node, count(DISTINCT dst) AS ancestors FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY src""")
def traversal_counts(spark, sf_dir):
    """Distinct ancestors within two steps."""
    e = edges(spark, sf_dir, ["LIVES_IN", "IN_REGION", "BASED_IN"]).select("src", "dst").distinct()
    two = e.toDF("src", "mid").join(e.toDF("mid", "dst"), "mid").select("src", "dst")
    return e.union(two).groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("ancestors"))


@query("degree_sparse", f"""WITH {EDGES_SQL}, {NODES_SQL}, d AS (SELECT id, label, name,
  (SELECT count(*) FROM edges WHERE src = id) + (SELECT count(*) FROM edges WHERE dst = id) AS degree FROM nodes WHERE label IN ('nation','region'))
SELECT id, label, degree, round(1 - degree / 3.0, 6) AS importance FROM d WHERE degree < 3""".replace("edges WHERE", "edges2 WHERE").replace(", d AS", ", edges2 AS (SELECT * FROM edges WHERE rel_type = 'IN_REGION'), d AS"))
def degree_sparse(spark, sf_dir):
    """A5, F25."""
    n = nodes(spark, sf_dir).filter(F.col("label").isin("nation", "region"))
    d = G.degrees(n, edges(spark, sf_dir, ["IN_REGION"]))
    from ..functions.scores import sparse_importance

    return d.filter("degree < 3").select("id", "label", "degree", F.round(sparse_importance(F.col("degree")), 6).alias("importance"))


@query("in_out_degree", f"""WITH {EDGES_SQL}, {NODES_SQL}, o AS (SELECT src AS id, count(*) AS c FROM edges GROUP BY src), i AS (SELECT dst AS id, count(*) AS c FROM edges GROUP BY dst)
SELECT id, label, coalesce(o.c,0) AS out_degree, coalesce(i.c,0) AS in_degree, coalesce(o.c,0)+coalesce(i.c,0) AS degree FROM nodes LEFT JOIN o USING(id) LEFT JOIN i USING(id)""")
def in_out_degree(spark, sf_dir):
    """A6."""
    return G.degrees(nodes(spark, sf_dir), edges(spark, sf_dir)).select("id", "label", "out_degree", "in_degree", "degree")


@query("node_metrics", """WITH c AS (SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1)
SELECT n_nationkey, coalesce(c.n,0) AS children, CAST(1 AS BIGINT) AS parents, coalesce(s.n,0) AS instances,
 coalesce(c.n,0) - 0.5 + CASE WHEN coalesce(s.n,0) > 0 THEN 10.0 ELSE 0.0 END AS abstraction, (coalesce(s.n,0) > 0 OR coalesce(c.n,0) >= 1 OR coalesce(c.n,0) - 0.5 >= 5) AS root_like
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def node_metrics(spark, sf_dir):
    """Three counts, each aggregated before its join."""
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("children"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("instances"))
    zero = F.lit(0).cast("long")
    n = load(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select(
        "n_nationkey", F.coalesce("children", zero).alias("children"), F.lit(1).cast("long").alias("parents"), F.coalesce("instances", zero).alias("instances"))
    a = (F.col("children"), F.col("parents"), F.col("instances"))
    return n.withColumn("abstraction", G.abstraction(*a)).withColumn("root_like", G.is_root_like(*a))


@query("connectivity_score", f"""WITH {EDGES_SQL}, d AS (SELECT src AS id, count(*) AS direct, count(DISTINCT dst) AS roots FROM edges WHERE dst LIKE 'nation:%' GROUP BY src),
s AS (SELECT src AS id, count(*) AS subs FROM edges WHERE rel_type = 'LIVES_IN' GROUP BY src)
SELECT id, 3.0*direct + 2.0*roots + 1.5*coalesce(subs,0) AS connectivity FROM d LEFT JOIN s USING(id)""")
def connectivity_score(spark, sf_dir):
    """G4."""
    roots = load(spark, sf_dir, "nation").select(node_id("nation", "n_nationkey").alias("id"))
    return G.root_connectivity(edges(spark, sf_dir, ["LIVES_IN", "BASED_IN"]), roots, "LIVES_IN")


ENTITY = """pairs AS (SELECT least(src,dst) AS u, greatest(src,dst) AS v, sum(CASE WHEN w IS NULL OR w = 0 THEN 1.0 ELSE w END) AS weight
 FROM (SELECT 's'||l_suppkey AS src, 'p'||l_partkey AS dst, nullif(l_quantity, 50) AS w FROM lineitem) WHERE src <> dst GROUP BY 1, 2)"""


def _entity_pairs(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    e = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.nullif("l_quantity", F.lit(50.0)).alias("w"))
    return G.weighted_pairs(e, "w")


@query("entity_graph_edges", f"WITH {ENTITY} SELECT u, v, weight FROM pairs")
def entity_graph_edges(spark, sf_dir):
    """A10, B5."""
    return _entity_pairs(spark, sf_dir)


@query("modularity_by_key", f"""WITH {ENTITY}, b AS (SELECT u, v, weight FROM pairs UNION ALL SELECT v, u, weight FROM pairs),
n AS (SELECT CAST(substr(u,2) AS BIGINT) % 5 AS cu, CAST(substr(v,2) AS BIGINT) % 5 AS cv, weight FROM b),
c AS (SELECT cu, sum(CASE WHEN cu = cv THEN weight ELSE 0 END) AS inside, sum(weight) AS s FROM n GROUP BY cu), t AS (SELECT sum(s) AS m2 FROM c)
SELECT round(sum(inside / m2 - (s / m2) * (s / m2)), 6) AS modularity FROM c, t""")
def modularity_by_key(spark, sf_dir):
    """Modularity of a given partition."""
    p = G.kept(_entity_pairs(spark, sf_dir))
    part = p.select(F.col("u").alias("id")).union(p.select("v")).distinct().withColumn("community", F.substring("id", 2, 20).cast("long") % 5)
    return G.modularity(p, part).select(F.round("modularity", 6).alias("modularity"))


@query("communities_lpa")
def communities_lpa(spark, sf_dir):
    """Found communities with size and best connected members."""
    p = _entity_pairs(spark, sf_dir)
    labels = G.label_propagation(p, rounds=5)
    strength = p.select(F.col("u").alias("id"), "weight").union(p.select("v", "weight")).groupBy("id").agg(F.sum("weight").alias("w"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col("id")))), 1, 5)
    return labels.join(strength, "id").groupBy("community").agg(F.count("*").alias("members"), top.alias("t")).select(
        "community", "members", F.array_join(F.transform("t", lambda x: x["id"]), ",").alias("representatives"))


@query("communities_louvain")
def communities_louvain(spark, sf_dir):
    """Communities by local moves of modularity, of at least three members."""
    found = G.louvain(_entity_pairs(spark, sf_dir), levels=2, rounds=3)
    return G.of_size(found, 3).select("id", "community")


@query("community_stats", "SELECT count(*) AS communities, sum(n) AS members, avg(n) AS avg_size, max(n) AS max_size, min(n) AS min_size FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def community_stats(spark, sf_dir):
    """A11, B3."""
    s = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("communities"), F.sum("n").alias("members"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))


BFS = f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type IN ('PLACED_BY','LIVES_IN','IN_REGION')),
w AS (SELECT src AS seed, src AS node, 0 AS level FROM (SELECT DISTINCT src FROM e WHERE src LIKE 'orders:2_')
  UNION SELECT w.seed, e.dst, level + 1 FROM w JOIN e ON e.src = w.node WHERE level < 4)"""


@query("bfs_levels", BFS + " SELECT seed, node, min(level) AS level FROM w GROUP BY 1, 2")
def bfs_levels(spark, sf_dir):
    """G1, G5."""
    e = edges(spark, sf_dir, ["PLACED_BY", "LIVES_IN", "IN_REGION"])
    seeds = e.select(F.col("src").alias("node")).distinct().filter(F.col("node").like("orders:2_"))
    return G.bfs_out(seeds, e, 4)


@query("bfs_capped")
def bfs_capped(spark, sf_dir):
    """Undirected levels with a cap per level."""
    return G.within_hops(_seeds(spark, "region:0"), edges(spark, sf_dir, ["LIVES_IN", "IN_REGION", "BASED_IN"]), 3, cap=50)


@query("shortest_pairs", """WITH e AS (SELECT DISTINCT 'n'||n_nationkey AS a, 'r'||n_regionkey AS b FROM nation),
p AS (SELECT x.n_nationkey AS i, y.n_nationkey AS j, x.n_regionkey = y.n_regionkey AS same FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey)
SELECT 'nation:'||i AS a, 'nation:'||j AS b, CASE WHEN same THEN 2 END AS distance FROM p""")
def shortest_pairs(spark, sf_dir):
    """G7."""
    n = load(spark, sf_dir, "nation").select(node_id("nation", "n_nationkey").alias("id"), "n_nationkey")
    p = n.toDF("a", "i").join(n.toDF("b", "j"), F.col("i") < F.col("j")).select("a", "b")
    return G.shortest_pairs(p, edges(spark, sf_dir, ["IN_REGION"]), 4).select("a", "b", "distance")


@query("connectivity_ratio", """WITH s AS (SELECT n_nationkey AS id, n_nationkey % 4 AS set_id, n_regionkey AS r FROM nation),
p AS (SELECT x.set_id, count(*) AS pairs, count(CASE WHEN x.r = y.r THEN 1 END) AS connected FROM s x JOIN s y ON x.set_id = y.set_id AND x.id < y.id GROUP BY 1)
SELECT set_id, pairs, connected, round(connected / pairs, 6) AS ratio FROM p""")
def connectivity_ratio(spark, sf_dir):
    """E2."""
    s = load(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).alias("set_id"), node_id("nation", "n_nationkey").alias("node"))
    return G.connectivity_ratio(s, edges(spark, sf_dir, ["IN_REGION"]), 2).withColumn("ratio", F.round("ratio", 6))


@query("components_by_part", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity >= 50),
b AS (SELECT 's'||s AS a, 'p'||p AS b FROM e UNION SELECT 'p'||p, 's'||s FROM e),
w AS (SELECT DISTINCT a AS id, a AS r FROM b UNION SELECT w.id, b.b FROM w JOIN b ON b.a = w.r)
SELECT count(DISTINCT component) AS components, count(*) AS members FROM (SELECT id, min(r) AS component FROM w GROUP BY id)""")
def components_by_part(spark, sf_dir):
    """Closure of match groups."""
    e = load(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return G.components(e).agg(F.countDistinct("component").alias("components"), F.count("*").alias("members"))


@query("display_subgraph", f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst, rel_type FROM edges WHERE rel_type = 'BASED_IN'),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id OR dst = id) AS deg FROM n)
SELECT id, deg, 20 + 10.0 * deg / (SELECT max(deg) FROM d) AS size FROM d""")
def display_subgraph(spark, sf_dir):
    """Nodes of a subgraph with display sizes."""
    e = edges(spark, sf_dir, ["BASED_IN"]).dropDuplicates()
    d = G.undirected(e).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("deg"))
    top = d.agg(F.max("deg").alias("m"))
    return d.join(F.broadcast(top)).select("id", "deg", (20 + 10.0 * F.col("deg") / F.col("m")).alias("size"))

"""Aggregation, window, ordering, set and upsert queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import upserts as U
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, load, nodes
from .registry import query


@query("graph_stats", f"WITH {NODES_SQL}, l AS (SELECT * FROM (VALUES ('region'),('nation'),('customer'),('supplier'),('part'),('webpage')) t(label)) SELECT l.label, count(n.id) AS n FROM l LEFT JOIN nodes n USING(label) GROUP BY 1")
def graph_stats(spark, sf_dir):
    """A1: counts per label, zero for empty labels."""
    labels = spark.createDataFrame([(x,) for x in ("region", "nation", "customer", "supplier", "part", "webpage")], "label string")
    return labels.join(nodes(spark, sf_dir), "label", "left").groupBy("label").agg(F.count("id").alias("n"))


@query("edge_type_counts", f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY 1")
def edge_type_counts(spark, sf_dir):
    """A2, A3, D17."""
    return edges(spark, sf_dir).groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query("group_counts", "SELECT coalesce(lang,'unknown') AS lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def group_counts(spark, sf_dir):
    """A2."""
    return load(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang"), "source").agg(F.count("*").alias("n"))


@query("word_document_counts", r"SELECT w AS word, count(DISTINCT item_id) AS items FROM (SELECT item_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1")
def word_document_counts(spark, sf_dir):
    """A4."""
    from ..functions.text import words

    return load(spark, sf_dir, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.countDistinct("item_id").alias("items"))


@query("graph_summary", f"""WITH {NODES_SQL}, {EDGES_SQL}, u AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT round(avg(length(name)), 6) FROM nodes) AS avg_name, (SELECT round(avg(length(name)), 6) FROM nodes JOIN u USING(id)) AS avg_name_by_degree""")
def graph_summary(spark, sf_dir):
    """The plain mean and the one that weighs by degree."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count("*").alias("d"))
    by = n.join(ends, "id").agg(F.round(F.sum(F.length("name") * F.col("d")) / F.sum("d"), 6).alias("avg_name_by_degree"))
    return n.agg(F.count("*").alias("n_nodes"), F.round(F.avg(F.length("name")), 6).alias("avg_name")).join(e.agg(F.count("*").alias("n_edges"))).join(by).select(
        "n_nodes", "n_edges", "avg_name", "avg_name_by_degree")


@query("types_slice", "SELECT p_brand, string_agg(t, ',' ORDER BY t) AS types FROM (SELECT p_brand, p_type AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS r FROM (SELECT DISTINCT p_brand, p_type FROM part)) WHERE r <= 20 GROUP BY 1")
def types_slice(spark, sf_dir):
    """A9."""
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 20), ",").alias("types"))


@query("label_stats", "SELECT 'brand' AS category, p_brand AS label, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2")
def label_stats(spark, sf_dir):
    """A12."""
    a = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")).withColumn("category", F.lit("brand"))
    b = load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n")).withColumn("category", F.lit("segment"))
    return a.unionByName(b).select("category", "label", "n")


@query("off_ontology", "SELECT event_type AS open_type, count(*) AS n FROM events WHERE event_type NOT IN ('click','view') GROUP BY 1")
def off_ontology(spark, sf_dir):
    """Types outside the ontology."""
    known = spark.createDataFrame([("click",), ("view",)], "open_type string")
    return load(spark, sf_dir, "events").withColumnRenamed("event_type", "open_type").join(known, "open_type", "left_anti").groupBy("open_type").agg(F.count("*").alias("n"))


@query("profile_summary", """SELECT event_type AS kind, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(100 * sum(value) / sum(sum(value)) OVER (), 4) AS share FROM events GROUP BY 1""")
def profile_summary(spark, sf_dir):
    """A14, D26."""
    p = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("calls"), F.sum("value").alias("t"), F.avg("value").alias("m"))
    all_ = F.sum("t").over(Window.partitionBy())
    return p.select("kind", "calls", F.round("t", 4).alias("total"), F.round("m", 4).alias("mean"), F.when(all_ == 0, 0.0).otherwise(F.round(100 * F.col("t") / all_, 4)).alias("share"))


@query("bottlenecks", "SELECT event_id, event_type FROM (SELECT event_id, event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) WHERE value > 2 * m")
def bottlenecks(spark, sf_dir):
    """A15, W4."""
    m = F.avg("value").over(Window.partitionBy("event_type"))
    return load(spark, sf_dir, "events").withColumn("m", m).filter("value > 2 * m").select("event_id", "event_type")


@query("model_comparison", """SELECT l_shipmode AS model, n, success, avg_nodes, avg_latency, CASE WHEN success < 0.9 THEN 'low success' ELSE '' END || CASE WHEN avg_latency > 30000 THEN ';slow' ELSE '' END AS issues FROM (
 SELECT l_returnflag AS l_shipmode, count(*) AS n, round(avg((l_linestatus = 'F')::INT), 6) AS success, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 4) AS avg_nodes, round(avg(l_extendedprice), 2) AS avg_latency FROM lineitem GROUP BY 1)""")
def model_comparison(spark, sf_dir):
    """A16, A17."""
    ok = F.col("l_linestatus") == "F"
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("success"), F.round(F.avg(F.when(ok, F.col("l_quantity"))), 4).alias("avg_nodes"), F.round(F.avg("l_extendedprice"), 2).alias("avg_latency"))
    return g.withColumn("issues", F.concat(F.when(F.col("success") < 0.9, "low success").otherwise(""), F.when(F.col("avg_latency") > 30000, ";slow").otherwise("")))


METRICS = """m AS (SELECT event_type AS metric, CASE WHEN user_id % 2 = 0 THEN 'retrieval' ELSE 'agentic' END AS layer, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 100 END AS score, event_id % 10 = 0 AS failed, value > 20 AS passed, ts FROM events)"""


def _metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    bad = F.col("event_id") % 10 == 0
    return e.select(F.col("event_type").alias("metric"), F.when(F.col("user_id") % 2 == 0, "retrieval").otherwise("agentic").alias("layer"),
                    F.when(~bad, F.col("value") / 100).alias("score"), bad.alias("failed"), (F.col("value") > 20).alias("passed"), "ts")


@query("layer_rollup", f"""WITH {METRICS}, a AS (SELECT layer, metric, avg(score) FILTER (NOT failed) AS s, bool_and(passed) AS p FROM m GROUP BY 1, 2)
SELECT layer, round(avg(s), 6) AS score, bool_and(p) AS passed, count(*) AS metrics FROM a GROUP BY 1""")
def layer_rollup(spark, sf_dir):
    """A18, E15."""
    a = _metrics(spark, sf_dir).groupBy("layer", "metric").agg(F.avg(F.when(~F.col("failed"), F.col("score"))).alias("s"), F.bool_and("passed").alias("p"))
    return a.groupBy("layer").agg(F.round(F.avg("s"), 6).alias("score"), F.bool_and("p").alias("passed"), F.count("*").alias("metrics"))


@query("weighted_overall", f"""WITH {METRICS}, a AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY metric) AS k, avg(score) AS s FROM m GROUP BY layer, metric)
SELECT layer, round(sum(s * CASE k WHEN 1 THEN .3 WHEN 2 THEN .25 WHEN 3 THEN .2 WHEN 4 THEN .1 ELSE .15 END), 6) AS overall FROM a GROUP BY 1""")
def weighted_overall(spark, sf_dir):
    """A19."""
    a = _metrics(spark, sf_dir).groupBy("layer", "metric").agg(F.avg("score").alias("s")).withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("metric")))
    weights = F.element_at(F.array(*[F.lit(x) for x in (0.3, 0.25, 0.2, 0.1, 0.15)]), F.col("k"))
    return a.groupBy("layer").agg(F.round(F.sum(F.col("s") * weights), 6).alias("overall"))


@query("rejection_confusion", """WITH c AS (SELECT count_if(quality=0 AND toxic=1) AS tp, count_if(quality=1 AND toxic=1) AS fp, count_if(quality=1 AND toxic=0) AS tn, count_if(quality=0 AND toxic=0) AS fn FROM labels)
SELECT tp, fp, tn, fn, round(CASE WHEN tp+fn=0 THEN 1.0 ELSE tp/(tp+fn) END, 6) AS sensitivity, round(CASE WHEN tn+fp=0 THEN 1.0 ELSE tn/(tn+fp) END, 6) AS specificity, round(CASE WHEN tp+fp=0 THEN 1.0 ELSE tp/(tp+fp) END, 6) AS precision, round(CASE WHEN tp+fp+tn+fn=0 THEN 1.0 ELSE (tp+tn)/(tp+fp+tn+fn) END, 6) AS accuracy, round(CASE WHEN 2*tp+fp+fn=0 THEN 1.0 ELSE 2*tp/(2*tp+fp+fn) END, 6) AS f1 FROM c""")
def rejection_confusion(spark, sf_dir):
    """Toxic is the prediction, low quality the truth."""
    q, t = F.col("quality"), F.col("toxic")
    c = load(spark, sf_dir, "labels").agg(F.count_if((q == 0) & (t == 1)).alias("tp"), F.count_if((q == 1) & (t == 1)).alias("fp"), F.count_if((q == 1) & (t == 0)).alias("tn"), F.count_if((q == 0) & (t == 0)).alias("fn"))
    def guarded(a, b):
        return F.round(F.when(b == 0, 1.0).otherwise(a / b), 6)

    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", guarded(tp, tp + fn).alias("sensitivity"), guarded(tn, tn + fp).alias("specificity"), guarded(tp, tp + fp).alias("precision"), guarded(tp + tn, tp + fp + tn + fn).alias("accuracy"), guarded(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("category_breakdown", "SELECT c_mktsegment AS category, count(*) AS n, round(avg(c_acctbal), 4) AS avg_score, round(avg((c_acctbal > 0)::INT), 6) AS completeness FROM customer GROUP BY 1")
def category_breakdown(spark, sf_dir):
    """A21."""
    return load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_score"), F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 6).alias("completeness"))


@query("ablation_best", "SELECT arg_max(cfg, (s, cfg)) AS best, round(max(s), 4) AS score, count(*) AS configs FROM (SELECT p_brand AS cfg, avg(p_retailprice) AS s FROM part GROUP BY 1)")
def ablation_best(spark, sf_dir):
    """A22."""
    s = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cfg")).agg(F.avg("p_retailprice").alias("s"))
    return s.agg(F.max_by("cfg", F.struct("s", "cfg")).alias("best"), F.round(F.max("s"), 4).alias("score"), F.count("*").alias("configs"))


@query("ablation_delta", "WITH s AS (SELECT p_size AS cfg, avg(p_retailprice) AS v FROM part GROUP BY 1) SELECT cfg, round(v, 4) AS score, round(v - (SELECT v FROM s WHERE cfg = (SELECT min(cfg) FROM s)), 4) AS delta FROM s")
def ablation_delta(spark, sf_dir):
    """Difference to the baseline configuration."""
    s = load(spark, sf_dir, "part").groupBy(F.col("p_size").alias("cfg")).agg(F.avg("p_retailprice").alias("v"))
    base = s.agg(F.min_by("v", "cfg").alias("b"))
    return s.join(base).select("cfg", F.round("v", 4).alias("score"), F.round(F.col("v") - F.col("b"), 4).alias("delta"))


@query("timing_stats", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def timing_stats(spark, sf_dir):
    """A23."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("group_sets_stats", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def group_sets_stats(spark, sf_dir):
    """A25, D8."""
    o = load(spark, sf_dir, "orders")
    return o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("dataset_rollup", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY ROLLUP (lang, source)")
def dataset_rollup(spark, sf_dir):
    """A26."""
    return load(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("metric_series", "SELECT event_type AS metric, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS series FROM events GROUP BY 1")
def metric_series(spark, sf_dir):
    """A27."""
    e = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return e.select("metric", F.array_join(F.transform("s", lambda x: x["event_id"].cast("string")), ",").alias("series"))


@query("seed_totals", "SELECT sum(n_chars) AS chars, count(*) AS docs, count(DISTINCT source) AS sources FROM documents")
def seed_totals(spark, sf_dir):
    """A28."""
    return load(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("docs"), F.countDistinct("source").alias("sources"))


@query("topic_rank", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS priority FROM part ORDER BY priority LIMIT 50")
def topic_rank(spark, sf_dir):
    """Renumbered after the top rows are known, so one task sees fifty rows."""
    top = load(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(50)
    return top.withColumn("priority", F.row_number().over(Window.orderBy(F.col("p_retailprice").desc(), "p_partkey"))).select("p_partkey", "priority")


@query("first_per_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def first_per_source(spark, sf_dir):
    """Aggregated before the shuffle, so no source is gathered."""
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id"))).alias("doc_id"))


@query("redundant_steps", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen_before FROM conversations")
def redundant_steps(spark, sf_dir):
    """W5."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.count("*").over(w) > 0).alias("seen_before"))


@query("running_context", "SELECT conv_id, turn, left(coalesce(string_agg(left(text, 200), chr(10) ORDER BY turn) FILTER (turn < t), ''), 500) AS context FROM (SELECT c.conv_id, c.turn AS t, c.turn AS turn_, p.turn, p.text FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn) GROUP BY conv_id, t".replace("SELECT conv_id, turn, left(", "SELECT conv_id, t AS turn, left(").replace(" FILTER (turn < t)", ""))
def running_context(spark, sf_dir):
    """W7."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = load(spark, sf_dir, "conversations").withColumn("before", F.collect_list(F.substring("text", 1, 200)).over(w))
    return c.select("conv_id", "turn", F.substring(F.array_join("before", "\n"), 1, 500).alias("context"))


@query("shortest_names", "SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%1%' ORDER BY length(s_name), s_name, s_suppkey LIMIT 10")
def shortest_names(spark, sf_dir):
    """O2, P2."""
    return load(spark, sf_dir, "supplier").filter(F.contains(F.lower("s_name"), F.lit("1"))).orderBy(F.length("s_name"), "s_name", "s_suppkey").limit(10).select("s_suppkey", "s_name")


@query("best_leaves", f"WITH {EDGES_SQL} SELECT dst AS id, count(*) AS links FROM edges WHERE rel_type = 'CONTAINS' GROUP BY 1 ORDER BY links DESC, id LIMIT 25")
def best_leaves(spark, sf_dir):
    """O3."""
    return edges(spark, sf_dir, ["CONTAINS"]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links")).orderBy(F.col("links").desc(), "id").limit(25)


@query("two_key_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 30")
def two_key_sort(spark, sf_dir):
    """O5."""
    return load(spark, sf_dir, "orders").orderBy(F.col("o_orderpriority").desc(), F.col("o_totalprice").desc(), "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("random_sample", "SELECT doc_id, source FROM documents ORDER BY md5('7:'||doc_id), doc_id LIMIT 25")
def random_sample(spark, sf_dir):
    """A sampling operator: the least digests of seed and id."""
    return load(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(25).select("doc_id", "source")


@query("budget_split", """WITH p AS (SELECT * FROM (VALUES (1,'single',0.4),(2,'multi',0.35),(3,'compare',0.15),(4,'reject',0.1)) t(ord,kind,prob)), f AS (SELECT *, CAST(floor(103 * prob) AS BIGINT) AS base FROM p)
SELECT kind, base + CASE WHEN ord <= 103 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS n FROM f""")
def budget_split(spark, sf_dir):
    """Whole shares, the remainder to the first kinds."""
    p = spark.createDataFrame([(1, "single", 0.4), (2, "multi", 0.35), (3, "compare", 0.15), (4, "reject", 0.1)], "ord int, kind string, prob double")
    f = p.withColumn("base", F.floor(103 * F.col("prob")))
    rest = 103 - F.sum("base").over(Window.partitionBy())
    return f.select("kind", (F.col("base") + (F.col("ord") <= rest).cast("int")).alias("n"))


@query("filtered_take", "SELECT page_id, url FROM (SELECT page_id, url FROM pages ORDER BY page_id LIMIT 60) WHERE url LIKE 'https%' ORDER BY page_id LIMIT 20")
def filtered_take(spark, sf_dir):
    """Ask for three times as many, keep the first trusted ones."""
    return load(spark, sf_dir, "pages").orderBy("page_id").limit(60).filter(F.col("url").startswith("https")).orderBy("page_id").limit(20).select("page_id", "url")


@query("gap_report", """WITH o AS (SELECT c_custkey AS id, count(o_orderkey) AS deg FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
g AS (SELECT 'sparse' AS kind, id, round(1 - deg / 3.0, 6) AS importance FROM o WHERE deg < 3 UNION ALL
 SELECT 'incomplete', doc_id, round(greatest(0.7 - n_chars / 100.0, 0.3), 6) FROM documents WHERE n_chars < 50)
SELECT kind, id, importance FROM g WHERE importance >= 0.3 ORDER BY importance DESC, kind, id LIMIT 20""")
def gap_report(spark, sf_dir):
    """U1, O9, R11, F25, P9."""
    from ..functions.scores import incomplete_importance, sparse_importance

    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("d"))
    deg = F.coalesce("d", F.lit(0))
    a = c.join(o, "c_custkey", "left").filter(deg < 3).select(F.lit("sparse").alias("kind"), F.col("c_custkey").alias("id"), F.round(sparse_importance(deg), 6).alias("importance"))
    b = load(spark, sf_dir, "documents").filter("n_chars < 50").select(F.lit("incomplete").alias("kind"), F.col("doc_id").alias("id"), F.round(incomplete_importance(F.col("n_chars")), 6).alias("importance"))
    return a.unionByName(b).filter("importance >= 0.3").orderBy(F.col("importance").desc(), "kind", "id").limit(20)


@query("ordered_dedupe", "SELECT name, pass, id FROM (SELECT lower(name) AS name, pass, id, row_number() OVER (PARTITION BY lower(name) ORDER BY pass, id) AS r FROM (SELECT p_brand AS name, 1 AS pass, p_partkey AS id FROM part WHERE p_size > 20 UNION ALL SELECT p_brand, 2, p_partkey FROM part)) WHERE r = 1")
def ordered_dedupe(spark, sf_dir):
    """The first pass of a name wins."""
    p = load(spark, sf_dir, "part")
    rows = p.filter("p_size > 20").select(F.lower("p_brand").alias("name"), F.lit(1).alias("pass"), F.col("p_partkey").alias("id")).unionByName(p.select(F.lower("p_brand").alias("name"), F.lit(2).alias("pass"), F.col("p_partkey").alias("id")))
    return rows.groupBy("name").agg(F.min(F.struct("pass", "id")).alias("m")).select("name", "m.pass", "m.id")


@query("set_difference", "SELECT c_custkey AS id, 'missing' AS side FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT * FROM (SELECT c_custkey AS id, 'both' AS side FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders))")
def set_difference(spark, sf_dir):
    """U3."""
    c, o = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").select("o_custkey")
    return c.exceptAll(o.distinct()).distinct().select(F.col("c_custkey").alias("id"), F.lit("missing").alias("side")).unionByName(c.intersect(o).select(F.col("c_custkey").alias("id"), F.lit("both").alias("side")))


@query("provenance_union", "SELECT l_partkey, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT l_partkey, 's'||l_suppkey AS k FROM lineitem UNION SELECT l_partkey, 'f'||l_returnflag FROM lineitem) GROUP BY 1")
def provenance_union(spark, sf_dir):
    """U4."""
    g = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey"))).alias("a"), F.collect_set(F.concat(F.lit("f"), F.col("l_returnflag"))).alias("b"))
    return g.select("l_partkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("keys"))


@query("hallucinated_citations", "SELECT e.event_id, lower(e.event_type) AS cited FROM events e WHERE lower(e.event_type) NOT IN ('click','view','purchase')")
def hallucinated_citations(spark, sf_dir):
    """Cited but not available, repeats kept."""
    have = spark.createDataFrame([("click",), ("view",), ("purchase",)], "cited string")
    return load(spark, sf_dir, "events").select("event_id", F.lower("event_type").alias("cited")).join(have, "cited", "left_anti").select("event_id", "cited")


@query("upsert_coalesce", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE coalesce(l.lang, d.lang) END AS lang, d.source FROM (SELECT doc_id, lang, source FROM documents WHERE doc_id % 2 = 0) d
FULL JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' END AS lang FROM labels) l ON l.doc_id = d.doc_id""")
def upsert_coalesce(spark, sf_dir):
    """K1, K10, D22."""
    old = load(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "lang", "source")
    new = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").alias("lang"))
    return U.upsert(old, new, "doc_id", {"lang": "coalesce"})


@query("upsert_name_only", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang WHEN d.doc_id IS NULL THEN l.lang ELSE l.lang END AS lang FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) d FULL JOIN (SELECT doc_id, 'q'||quality AS lang FROM labels) l ON l.doc_id = d.doc_id")
def upsert_name_only(spark, sf_dir):
    """The new name always wins."""
    old = load(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "lang")
    return U.upsert(old, load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("lang")), "doc_id", {"lang": "new"})


@query("upsert_edges", """SELECT DISTINCT 'customer:'||o_custkey AS src, 'orders:'||o_orderkey AS dst, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FILLED' ELSE 'RELATED_TO' END AS rel_type FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def upsert_edges(spark, sf_dir):
    """K2, K4."""
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey")).alias("src"), F.concat(F.lit("orders:"), F.col("o_orderkey")).alias("dst"), F.col("o_orderstatus").alias("rel_type"))
    ids = load(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("id")).unionByName(o.select(F.col("dst").alias("id")))
    return U.upsert_edges(o.limit(0), o, ids, {"O": "OPEN", "F": "FILLED"})


@query("upsert_max_conf", """SELECT user_id AS entity_id, arg_min(event_type, (ts, event_type)) AS name, max(value) AS confidence, string_agg(DISTINCT CAST(event_id % 10 AS VARCHAR), ',' ORDER BY CAST(event_id % 10 AS VARCHAR)) AS chunks FROM events GROUP BY 1""")
def upsert_max_conf(spark, sf_dir):
    """K3."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("name"), F.col("value").alias("confidence"), (F.col("event_id") % 10).cast("string").alias("chunk_id"))
    return U.entity_merge_max(e).select("entity_id", "name", "confidence", F.array_join("source_chunk_ids", ",").alias("chunks"))


@query("history_accumulate", "SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS description, count(*) AS extraction_count, count(DISTINCT role) AS labels FROM conversations GROUP BY 1")
def history_accumulate(spark, sf_dir):
    """K5, K6."""
    c = load(spark, sf_dir, "conversations")
    return U.accumulate(c, ["conv_id"], "text", "role", "turn").select("conv_id", "description", "extraction_count", F.size("label_history").cast("long").alias("labels"))


@query("label_counter", "SELECT event_type AS label, CAST(user_id % 3 AS BIGINT) AS category, count(*) AS uses, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def label_counter(spark, sf_dir):
    """K8, K7."""
    e = load(spark, sf_dir, "events").withColumns({"label": F.col("event_type"), "category": F.col("user_id") % 3})
    return U.label_counts(e, "label", "category", "ts")


@query("detach_delete", f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n FROM edges WHERE src <> 'nation:3' AND dst <> 'nation:3' GROUP BY 1")
def detach_delete(spark, sf_dir):
    """K14."""
    gone = spark.createDataFrame([("nation:3",)], "id string")
    return U.detach_delete(nodes(spark, sf_dir), edges(spark, sf_dir), gone)[1].groupBy("rel_type").agg(F.count("*").alias("n"))


@query("transfer_edges", f"WITH {EDGES_SQL} SELECT DISTINCT CASE WHEN src LIKE 'supplier:%' AND CAST(substr(src, 10) AS BIGINT) % 2 = 0 THEN 'supplier:1' ELSE src END AS src, dst, rel_type FROM edges WHERE rel_type = 'BASED_IN'")
def transfer_edges(spark, sf_dir):
    """J28, B8."""
    s = load(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("old"), F.lit("supplier:1").alias("primary"))
    return U.transfer_edges(edges(spark, sf_dir, ["BASED_IN"]), s)


@query("resolve_names", "SELECT 'e'||a.k AS src, 'e'||b.k AS dst, 'SAME' AS rel_type FROM (SELECT lower(p_brand) AS n, max(p_partkey) AS k FROM part GROUP BY 1) a JOIN (SELECT lower(p_brand) AS n, max(p_partkey) AS k FROM part GROUP BY 1) b ON a.n < b.n")
def resolve_names(spark, sf_dir):
    """J25."""
    p = load(spark, sf_dir, "part")
    ent = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("e"), F.col("p_partkey")).alias("entity_id"), F.col("p_partkey").alias("pos"))
    b = p.select(F.upper("p_brand").alias("source")).distinct()
    e = b.join(b.toDF("target"), F.lower("source") < F.lower("target")).withColumn("rel_type", F.lit("SAME"))
    return U.resolve_names(e, ent)


@query("merge_members", """SELECT c_nationkey AS grp, arg_min(c_name, c_custkey) AS name, round(max(c_acctbal), 2) AS confidence, count(DISTINCT c_mktsegment) AS urls FROM customer GROUP BY 1""")
def merge_members(spark, sf_dir):
    """F24."""
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.round("c_acctbal", 2).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_from"), F.col("c_mktsegment").alias("url"))
    return U.merge_members(c).select("grp", "name", "confidence", F.size("urls").cast("long").alias("urls"))


@query("config_grid", "SELECT a.v AS vec, b.h AS hops FROM (VALUES (3),(5),(8)) a(v), (VALUES (1),(2),(4),(5),(6),(8)) b(h)")
def config_grid(spark, sf_dir):
    """Two small constant tables."""
    return spark.createDataFrame([(3,), (5,), (8,)], "vec int").crossJoin(spark.createDataFrame([(h,) for h in (1, 2, 4, 5, 6, 8)], "hops int"))


@query("ordered_questions", "SELECT t.ord, b.item_id, coalesce(left(b.text, 20), '') AS question FROM (VALUES (1, 7),(2, 3),(3, 11),(4, 999999)) t(ord, id) JOIN benchmark b ON b.item_id = t.id")
def ordered_questions(spark, sf_dir):
    """Rows by id in the requested order."""
    want = spark.createDataFrame([(1, 7), (2, 3), (3, 11), (4, 999999)], "ord int, item_id long")
    return load(spark, sf_dir, "benchmark").join(want, "item_id").select("ord", "item_id", F.coalesce(F.substring("text", 1, 20), F.lit("")).alias("question")).orderBy("ord")


@query("diversity", "SELECT source, round(count(DISTINCT text) / count(*), 6) AS diversity FROM documents GROUP BY 1")
def diversity(spark, sf_dir):
    """E17."""
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.countDistinct("text") / F.count("*"), 6).alias("diversity"))


@query("raw_query", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey = 4 GROUP BY 1 LIMIT 100")
def raw_query(spark, sf_dir):
    """A parametrised SQL text over the tables."""
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_nationkey = :nation GROUP BY 1 LIMIT 100", args={"nation": 4}, customer=load(spark, sf_dir, "customer"))


@query("prediction_join", "SELECT CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS gold, d.lang AS predicted, count(*) AS n FROM labels l JOIN documents d USING(doc_id) GROUP BY 1, 2")
def prediction_join(spark, sf_dir):
    """J24."""
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id").groupBy(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), F.col("lang").alias("predicted")).agg(F.count("*").alias("n"))


@query("entity_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) = lower('SUPPLIER#000000004') OR CAST(s_suppkey AS VARCHAR) = '7'")
def entity_lookup(spark, sf_dir):
    """P1, S2."""
    return load(spark, sf_dir, "supplier").filter((F.lower("s_name") == "supplier#000000004") | (F.col("s_suppkey").cast("string") == "7")).select("s_suppkey", "s_name")

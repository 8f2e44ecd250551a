"""Sources and sinks as queries: what is written to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import upserts as U
from ..sources import config as C
from ..sources import sinks as K
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, load, nodes
from .registry import query
from .text_queries import CHUNKS


@query("seed_file", "SELECT 'Q'||n_nationkey AS qid, n_name AS name, CAST(n_regionkey AS VARCHAR) AS category FROM nation WHERE n_regionkey = 1")
def seed_file(spark, sf_dir):
    """One category of a seeds file."""
    path = K.new_path(spark, "seeds")
    one = F.struct(F.concat(F.lit("Q"), F.col("n_nationkey")).alias("qid"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("category"))
    load(spark, sf_dir, "nation").agg(F.collect_list(one).alias("seeds")).write.json(path)
    return C.seeds(spark, path, "1")


@query("named_records", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, NULL AS note FROM nation")
def named_records(spark, sf_dir):
    """Positional rows with names."""
    rows = load(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("string"), "n_name").alias("row"))
    return C.named_records(rows, ["id", "name", "note"])


@query("sitemap_urls", "SELECT page_id, url, '2026-01-'||lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod FROM pages")
def sitemap_urls(spark, sf_dir):
    """An index of sitemaps, followed down to their entries."""
    K.shared_folder(spark)
    p = load(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("2026-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("lastmod"))
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("#"), F.col("page_id"), F.lit("</loc><lastmod>"), F.col("lastmod"), F.lit("</lastmod></url>"))
    maps = p.groupBy(F.floor(F.col("page_id") / 40).alias("m")).agg(F.array_join(F.collect_list(entry), "").alias("x"))
    leaves = maps.select(F.concat(F.lit("map:"), F.col("m")).alias("url"), F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("x"), F.lit("</urlset>")).alias("xml"))
    named = leaves.agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))), "").alias("x"))
    root = named.select(F.lit("root").alias("url"), F.concat(F.lit("<sitemapindex>"), F.col("x"), F.lit("<sitemap><loc>root</loc></sitemap></sitemapindex>")).alias("xml"))
    found = C.expand_sitemaps(spark.createDataFrame([("root",)], "url string"), root.unionByName(leaves))
    return found.select(F.regexp_extract("url", r"#(\d+)$", 1).cast("long").alias("page_id"), F.regexp_replace("url", r"#\d+$", "").alias("url"), "lastmod")


@query("ontology_rows", "SELECT * FROM (VALUES ('type','Person','a human'),('type','Turbine','a machine'),('relation','OWNS','has')) t(kind, label, description)")
def ontology_rows(spark, sf_dir):
    """S13."""
    return C.ontology(spark, {"Person": "a human", "Turbine": "a machine"}, "type").unionByName(C.ontology(spark, {"OWNS": "has"}, "relation"))


@query("golden_cases", """WITH o AS (SELECT doc_id AS case_id, CASE quality WHEN 1 THEN 'retrieval' ELSE 'agentic' END AS type, 'pending' AS review_status, toxic FROM labels),
n AS (SELECT case_id, type, 'approved' AS review_status, toxic FROM o WHERE case_id % 3 = 0)
SELECT case_id, type, review_status FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE case_id NOT IN (SELECT case_id FROM n)) WHERE type = 'retrieval' AND review_status = 'approved' AND toxic = 0""")
def golden_cases(spark, sf_dir):
    """Two datasets merged, then filtered by type, status and tags."""
    old = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "retrieval").otherwise("agentic").alias("type"), F.lit("pending").alias("review_status"),
        F.lit("easy").alias("difficulty"), F.array(F.when(F.col("toxic") == 0, "clean").otherwise("toxic")).alias("tags"))
    new = old.filter(F.col("case_id") % 3 == 0).withColumn("review_status", F.lit("approved"))
    return C.golden(C.merge_golden(old, new), "retrieval", "approved", tags=["clean"]).select("case_id", "type", "review_status")


def _chunks(spark, sf_dir):
    c = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 1000, 100)).alias("chunk_index", "content"))
    chunk_id = X.short_hash(F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.substring("content", 1, 100))
    return c.withColumn("chunk_id", chunk_id)


_IDS = f"{CHUNKS}, k AS (SELECT doc_id, chunk_index, content, substr(sha256(doc_id||':'||chunk_index||':'||left(content, 100)), 1, 16) AS chunk_id FROM c)"


@query("chunk_links", f"WITH {_IDS} SELECT 'HAS_CHUNK' AS rel_type, 'doc:'||doc_id AS src, chunk_id AS dst, chunk_index AS position FROM k UNION ALL SELECT 'CHILD_OF', k.chunk_id, r.chunk_id, NULL FROM k JOIN k r ON r.doc_id = k.doc_id AND r.chunk_index = 0 WHERE k.chunk_index > 0")
def chunk_links(spark, sf_dir):
    """K9: edges from sources to chunks and from chunks to their first."""
    k = _chunks(spark, sf_dir)
    root = k.filter("chunk_index = 0").select("doc_id", F.col("chunk_id").alias("root"))
    rows = k.join(root, "doc_id").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_id"), "chunk_id", "chunk_index", F.when(F.col("chunk_index") > 0, F.col("root")).alias("parent_chunk_id"))
    has, child = U.chunk_edges(rows)
    return has.select(F.lit("HAS_CHUNK").alias("rel_type"), "src", "dst", "position").unionByName(
        child.select(F.lit("CHILD_OF").alias("rel_type"), "src", "dst", F.lit(None).cast("int").alias("position")))


@query("episode_rows", f"WITH {_IDS} SELECT 'ep_'||chunk_id AS episode_id, left(content, 500) AS content, chunk_id AS source_chunk_id FROM k")
def episode_rows(spark, sf_dir):
    """Episodes with their DERIVED_FROM chunk (content cut to 500 characters, as chunks are short)."""
    return K.episodes(_chunks(spark, sf_dir), 500)


@query("graph_written", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 2")
def graph_written(spark, sf_dir):
    """Nodes by label and edges by type, written and counted from their partitions."""
    path = K.new_path(spark, "graph")
    K.write_graph(nodes(spark, sf_dir), edges(spark, sf_dir), path)
    n = spark.read.parquet(f"{path}/nodes").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"))
    e = spark.read.parquet(f"{path}/edges").groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n"))
    return n.select(F.lit("node").alias("kind"), "name", "n").unionByName(e.select(F.lit("edge").alias("kind"), "name", "n"))


@query("exported_messages", """SELECT doc_id, 'Extract a graph.' AS instruction, text AS input, 'doc '||doc_id AS output, 'system,human,gpt' AS senders FROM documents""")
def exported_messages(spark, sf_dir):
    """Samples in the two export forms, written as JSON lines and read back."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    m = load(spark, sf_dir, "documents").select("doc_id", F.array(
        one("system", F.lit("Extract a graph.")), one("user", F.col("text")), one("assistant", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))).alias("messages"))
    a, b = K.new_path(spark, "alpaca"), K.new_path(spark, "sharegpt")
    K.write_json_lines(K.alpaca(m), a)
    K.write_json_lines(K.sharegpt(m), b)
    rows = C.json_lines(spark, a, "doc_id long, instruction string, input string, output string")
    sent = C.json_lines(spark, b, "doc_id long, conversations array<struct<from string, value string>>")
    return rows.join(sent.select("doc_id", F.array_join(F.transform("conversations", lambda x: x["from"]), ",").alias("senders")), "doc_id")


@query("written_splits", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split, lang AS domain, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1, 2")
def written_splits(spark, sf_dir):
    """Rows by split and domain, written and counted."""
    path = K.new_path(spark, "splits")
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"), F.when(F.col("doc_id") % 10 == 0, "eval").otherwise("train").alias("split"))
    K.write_splits(d, path)
    back = spark.read.schema("doc_id long, text string, split string, domain string").json(path)
    return back.groupBy("split", "domain").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("report_text", """WITH r AS (SELECT r_name AS name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT '<testsuite name="regions" tests="'||count(*)||'" failures="'||count_if(n < 5)||'">'||chr(10)||string_agg('<testcase name="'||name||'" time="0.000">'||CASE WHEN n < 5 THEN '<failure>few &lt; 5</failure>' ELSE '' END||'</testcase>', chr(10) ORDER BY name)||chr(10)||'</testsuite>' AS junit,
 '| name | n |'||chr(10)||'| --- | --- |'||chr(10)||string_agg('| '||name||' | '||n||' |', chr(10) ORDER BY name) AS markdown FROM r""")
def report_text(spark, sf_dir):
    """Reports of a small result (a row per region)."""
    n = load(spark, sf_dir, "region").join(load(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = n.groupBy(F.col("r_name").alias("name")).agg(F.count("n_nationkey").alias("n")).orderBy("name").collect()
    xml = K.junit_xml([{"name": r["name"], "passed": r["n"] >= 5, "message": "few < 5"} for r in rows], "regions")
    return spark.createDataFrame([(xml, K.markdown_table(["name", "n"], [tuple(r) for r in rows]))], "junit string, markdown string")

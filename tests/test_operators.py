"""Hand-built goldens and properties of single operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scores as S
from weftgraph.functions import text as X
from weftgraph.functions.splitters import split_text
from weftgraph.operators import graph as G
from weftgraph.operators import temporal as T
from weftgraph.operators import upserts as U
from weftgraph.operators import vectors as V
from weftgraph.sources import config, html, sinks
from weftgraph.streaming import events


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def graph(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, dst string, rel_type string")


def test_bfs_visits_root_and_children(spark):
    e = graph(spark, ("a", "b", "R"), ("a", "c", "R"), ("b", "a", "R"))
    got = G.bfs_out(spark.createDataFrame([("a",)], "node string"), e, 1)
    assert sorted((r["node"], r["level"]) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 1)]


def test_weighted_pairs_count_null_and_zero_as_one(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "a", None), ("a", "b", 0.0), ("a", "a", 9.0)], "src string, dst string, w double")
    assert [tuple(r) for r in G.weighted_pairs(e, "w").collect()] == [("a", "b", 2.5)]


def test_self_loop_is_seen_once(spark):
    e = graph(spark, ("a", "a", "R"), ("a", "b", "R"))
    assert G.undirected(e).filter("node = 'a'").count() == 2
    d = G.degrees(spark.createDataFrame([("a",)], "id string"), e).first()
    assert (d["out_degree"], d["in_degree"], d["degree"]) == (2, 1, 3)


def test_paths_repeat_no_edge(spark):
    e = graph(spark, ("a", "b", "R"), ("b", "a", "S"))
    got = G.paths(spark.createDataFrame([("a",)], "node string"), e, 5).collect()
    assert sorted((r["hops"], r["node"], r["chain"]) for r in got) == [(1, "b", "R"), (2, "a", "R>S")]


@pytest.mark.parametrize("text", ["", "a -> b", "a -[R]- b", "? -[*2]-> ?"])
def test_pattern_rejects(spark, text):
    with pytest.raises(ValueError):
        G.pattern(text, graph(spark, ("a", "b", "R")))


def test_patterns(spark):
    e = graph(spark, ("a", "b", "R"), ("a", "c", "S"), ("c", "b", "R"))
    rows = lambda t: sorted(tuple(r) for r in G.pattern(t, e).collect())
    assert rows("a -[R]-> ?") == [("a", "b", "R")] and rows("? -[R]-> b") == [("a", "b", "R"), ("c", "b", "R")] and rows("a -[?]-> c") == [("a", "c", "S")]
    assert sorted(r["node"] for r in G.pattern("a -[*2]-> ?", e).collect()) == ["b", "b", "c"]


def test_abstraction_and_connectivity(spark):
    assert value(spark, G.abstraction(F.lit(4), F.lit(2), F.lit(1))) == 13
    assert value(spark, G.is_root_like(F.lit(4), F.lit(2), F.lit(1)))
    e = graph(spark, ("x", "root", "SUB"))
    assert G.root_connectivity(e, spark.createDataFrame([("root",)], "id string"), "SUB").first()["connectivity"] == 6.5


def test_modularity_bounds_and_components(spark):
    p = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0)], "u string, v string, weight double")
    part = spark.createDataFrame([(x, "1" if x in "abc" else "2") for x in "abcde"], "id string, community string")
    m = G.modularity(p, part).first()["modularity"]
    assert -0.5 <= m <= 1 and math.isclose(m, 6 / 8 - (6 / 8) ** 2 + 2 / 8 - (2 / 8) ** 2)
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y")], "src string, dst string")
    got = {r["id"]: r["component"] for r in G.components(chain).collect()}
    assert set(got.values()) == {"n00", "x"} and len(got) == 33
    assert {r["community"] for r in G.label_propagation(p, 4).collect()} <= set("abcde")


def chain_ids(shape, n):
    """The nodes of a path over the ids 0 to n - 1: in random order, or falling and rising again."""
    ids = list(range(n - 1, 0, -2)) + list(range(n % 2, n, 2))
    if shape == "shuffled":
        random.Random(1).shuffle(ids)
    return list(dict.fromkeys(ids))


@pytest.mark.parametrize("shape", ["shuffled", "v"])
def test_long_chains_are_one_component(spark, shape):
    ids = chain_ids(shape, 1000)
    e = spark.createDataFrame([*zip(ids, ids[1:]), (2000, 2000), (3001, 3000), (4000, None)], "src long, dst long")
    got = {r["id"]: r["component"] for r in G.components(e).collect()}
    assert got == {i: min(ids) for i in ids} | {2000: 2000, 3000: 3000, 3001: 3000, 4000: 4000}
    with pytest.raises(RuntimeError):
        G.components(e, max_rounds=2)


def facts(spark):
    rows = [(1, "1", "2", "active"), (2, None, None, "active"), (3, "1", None, "obsolete"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "entity_id long, f string, t string, fact_status string")
    ts = lambda c: F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col(c)))
    null = F.lit(None).cast("timestamp")
    return df.select("entity_id", F.concat(F.lit("e"), F.col("entity_id")).alias("name"), F.lit("T").alias("ontology_type"), F.lit("d").alias("description"), F.lit(0.5).alias("confidence"),
                     ts("f").alias("valid_from"), ts("t").alias("valid_to"), F.to_timestamp(F.lit("2024-01-01")).alias("created_at"), null.alias("obsoleted_at"), null.alias("modified_at"), "fact_status")


def test_valid_at_boundaries(spark):
    at = lambda d: F.to_timestamp(F.lit(f"2024-01-0{d}"))
    ids = lambda df: sorted(r["entity_id"] for r in df.collect())
    f = facts(spark)
    assert ids(T.valid_at(f, at(1))) == [1, 2] and ids(T.valid_at(f, at(2))) == [2]
    assert 1 in ids(T.in_range(f, at(2), at(3))) and ids(T.bitemporal(f, at(1), at(1))) == [1, 2, 3, 4]
    assert set(ids(T.bitemporal(f, at(1), at(1)))) <= set(ids(T.facts_known_at(f, at(1))))


def test_versioning(spark):
    at = F.to_timestamp(F.lit("2024-02-01"))
    f = facts(spark)
    u = spark.createDataFrame([(1, 11, "new"), (9, 19, "none")], "entity_id long, new_id long, name string")
    table, edges = T.new_versions(f, u, at)
    rows = {r["entity_id"]: r for r in table.collect()}
    assert len(rows) == 5 and rows[1]["fact_status"] == "superseded" and rows[11]["name"] == "new" and rows[11]["valid_to"] is None
    assert [(r["new_id"], r["old_id"]) for r in edges.collect()] == [(11, 1)]
    gone = T.mark_obsolete(f, spark.createDataFrame([(2,), (2,)], "entity_id long"), at)
    assert gone.count() == 4 and gone.filter("entity_id = 2").first()["fact_status"] == "obsolete"
    back = T.restore(gone, spark.createDataFrame([(2,), (1,)], "entity_id long"), at).collect()
    assert {r["entity_id"]: r["fact_status"] for r in back}[2] == "active"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "id long, name string, conf double")
    new = spark.createDataFrame([(2, "B", 0.4), (3, "c", 0.1)], "id long, name string, conf double")
    rules = {"name": "new", "conf": "max"}
    once = U.upsert(old, new, "id", rules)
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, "B", 0.5), (3, "c", 0.1)] == sorted(map(tuple, U.upsert(once, new, "id", rules).collect()))


def test_merge_members(spark):
    rows = [(1, 0, "A", "x", 0.5, None, "u1"), (1, 1, "B", "y", 0.9, None, "u2"), (1, 2, "A", "x", 0.1, None, "u1")]
    m = U.merge_members(spark.createDataFrame(rows, "grp int, pos int, name string, description string, confidence double, valid_from timestamp, url string")).first()
    assert (m["name"], m["aliases"], m["description"], m["confidence"], m["urls"]) == ("A", ["B"], "x y", 0.9, ["u1", "u2"])


def test_ranking_entropy_and_loops(spark):
    assert math.isclose(value(spark, S.article_rank(F.lit(50), F.lit(25), F.lit("eleven char"), F.lit("https://en.wikipedia.org/wiki/X"))), 0.65)
    c = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), ("h", 1)], "g string, c int")
    got = {r["g"]: r["entropy"] for r in V.semantic_entropy(c, "g", "c").collect()}
    assert math.isclose(got["g"], 0.5794, abs_tol=1e-4) and got["h"] == 0
    assert math.isclose(value(spark, S.loop_efficiency(F.lit(2), F.lit(4), F.lit(1))), 0.4)


def test_url_entry(spark):
    e = X.url_entry(F.lit("https://www.x.com/a/b/c/"))
    got = {k: value(spark, c) for k, c in e.items()}
    assert got == {"domain": "x.com", "division": "a", "category": "b", "subcategory": "c", "depth": 3, "parent_url": "https://www.x.com/a/b/"}
    assert value(spark, X.wiki_title(F.lit("https://en.wikipedia.org/wiki/Caf%C3%A9_C%2B%2B"))) == "Café C++"
    assert value(spark, X.wiki_title(F.lit("https://en.wikipedia.org/wiki/A+B"))) == "A+B"


@pytest.mark.parametrize(("given", "want"), [("o-neil's_thing", "O-Neil'S Thing"), ("  a   b ", "A B"), ("ÉCOLE x2y", "École X2Y")])
def test_title_case_is_like_python(spark, given, want):
    assert want == " ".join(given.replace("_", " ").split()).title() == value(spark, X.title_case(F.lit(given)))


def test_text_builders(spark):
    assert value(spark, X.clean_text(F.lit("a\n\n\n\nb  c\nCookie Settings here\nd "))) == "a\n\nb c\nd"
    assert value(spark, X.cut_at_sentence(F.lit("One two. Three four. Five six."), 21)) == "One two. Three four."
    assert value(spark, X.cut_at_sentence(F.lit("x" * 30), 10)) == "x" * 10 + "..."
    assert value(spark, X.count_of(F.lit("aXaXXa"), "X")) == 3 and value(spark, X.relation_type(F.lit("is part-of é"))) == "IS_PART_OF_É"
    assert value(spark, X.looks_like_query(F.lit("MATCH (n) RETURN n"))) and not value(spark, X.looks_like_query(F.lit("MATCH (n RETURN n")))
    text = "".join(chr(97 + i % 26) for i in range(2500))
    chunks = value(spark, X.fixed_chunks(F.lit(text), 1000, 100))
    assert chunks[0] + "".join(c[100:] for c in chunks[1:]) == text


def test_recursive_split():
    text = "\n\n".join(" ".join(f"word{i}" for i in range(k)) for k in (5, 300, 40))
    parts = split_text(text, 200, 30)
    assert all(len(p) <= 200 for p in parts) and set(" ".join(parts).split()) == set(text.split()) and split_text("", 10, 2) == []


def test_metrics(spark):
    assert value(spark, S.efficiency(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    empty = F.array().cast("array<string>")
    assert value(spark, S.efficiency(empty, empty)) == 1 and value(spark, S.efficiency(F.array(F.lit("a")), empty)) == 0
    assert value(spark, S.faithfulness(F.lit("the of"), F.lit("x"))) == 0.5 and value(spark, S.groundedness(F.lit("alpha beta"), F.lit("alpha gamma"))) == 0.75
    assert value(spark, S.is_rejection(F.lit("I cannot answer"), F.lit(0.4))) and not value(spark, S.is_rejection(F.lit("fine"), F.lit(0.4)))
    assert value(spark, S.url_validity(F.lit("http://ok.org/x"), F.lit("ok.org"))) == "valid" and value(spark, S.url_validity(F.lit("ftp://x"), F.lit("x"))) == "invalid"
    assert value(spark, S.citation_status(F.lit(False), F.lit(0.6))) == "partial"


def test_vectors(spark):
    rows = [(i, [float(i == j) for j in range(4)], 0) for i in range(4)] + [(9, [1.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [(r["a"], r["b"], r["score"]) for r in V.similar_pairs(df, 0.9).collect()] == [(0, 9, 1.0)]
    top = V.knn(df.filter("vec_id = 0"), df, 1, skip_self=False).first()
    assert (top["item_id"], top["score"]) == (0, 1.0)
    assert V.knn(df.limit(0), df, 3).count() == 0
    groups = {r["vec_id"]: r["leader"] for r in V.greedy_clusters(df, "label", 0.9).collect()}
    assert groups[9] == 0 and len(set(groups.values())) == 4
    assert V.kmeans(df, k=2).count() == 5


def test_trust(spark):
    hosts = spark.createDataFrame([("www.arxiv.org",), ("nasa.gov",), ("bad.arxiv.org",), ("x.com",)], "host string")
    got = {r["host"]: (r["trusted"], r["level"]) for r in config.trust_match(hosts, config.trust_table(spark), spark.createDataFrame([("bad.arxiv.org",)], "pattern string")).collect()}
    assert got == {"www.arxiv.org": (True, "high"), "nasa.gov": (True, "high"), "bad.arxiv.org": (False, None), "x.com": (False, None)}
    assert config.trust_at_least(config.trust_table(spark), "high").count() == 11


def test_sitemaps_and_files(spark, tmp_path):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/b</loc><lastmod>2024</lastmod></url><url><loc>https://a/c</loc><lastmod>2023</lastmod></url></urlset>'
    df = spark.createDataFrame([(xml,), ('<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>',)], "xml string")
    assert sorted(tuple(r) for r in config.sitemap(df).collect()) == [("https://a/b", "2024"), ("https://a/c", "2023")]
    assert [r["url"] for r in config.sitemap_index(df).collect()] == ["https://a/s.xml"]
    (tmp_path / "seeds.json").write_text('{"name": "n", "seeds": [{"qid": "Q1", "name": "a", "category": "x"}, {"qid": "Q2", "name": "b", "category": "y"}]}')
    assert [r["qid"] for r in config.seeds(spark, str(tmp_path / "seeds.json"), "y").collect()] == ["Q2"]
    (tmp_path / "c.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    lines = config.json_lines(spark, str(tmp_path / "c.jsonl"), "id long")
    assert lines.count() == 2 and config.uncached(spark.range(4), lines, "id").count() == 2


def test_html_content():
    page = "<html><header>no</header><main><p>" + "kept words " * 20 + "</p><script>no</script></main><footer>no</footer>"
    assert html.content(page) == ("kept words " * 20).strip() and html.content("<p>short</p>") == "short" and html.content(None) == ""


def test_reports():
    out = sinks.junit_xml([{"name": "a<b", "passed": True}, {"name": "c", "passed": False, "message": "x & y"}])
    assert 'failures="1"' in out and "x &amp; y" in out
    assert sinks.markdown_table(["a"], [("x|y",)]).endswith("| x\\|y |")


def test_stream_gives_the_batch_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 5} 0{i % 9}:00:00", i % 3, "click" if i % 2 else "view", float(i), "{}") for i in range(60)],
                               "event_id long, t string, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read(spark, str(tmp_path / "in"), 4)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.windowed(df).collect()))
    for _ in range(2):
        events.ingest_once(events.read(spark, str(tmp_path / "in")), "event_id", str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_saved_replies_as_sources(spark, tmp_path):
    from weftgraph.sources import external

    external.register(spark)
    (tmp_path / "a.jsonl").write_text('{"title": "T", "url": "u", "content": "%s"}\n{"title": "V"}\n' % ("x" * 60000))
    rows = spark.read.format("articles").option("path", str(tmp_path)).load().collect()
    assert [(r["title"], len(r["content"] or "")) for r in rows] == [("T", 50000), ("V", 0)]
    assert spark.read.format("bindings").option("path", str(tmp_path / "none")).load().count() == 0


def test_whole_texts_reach_the_operators(spark, tmp_path):
    from weftgraph.plans.catalogue import QUERIES

    far = "plain words " * 30 + "no data found, unable to determine"
    spark.createDataFrame([(2, far)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, 0, "a" * 30 + " end"), (1, 1, "b" * 60 + "a" * 30 + " end"), (1, 2, "a" * 25 + " other")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).first()
    assert run("chat_messages")["user_text"] == far
    assert run("rejection_detect")["strength"] >= 0.4
    assert run("context_overlap")["precision"] == round(2 / 3, 6)


def test_searches_cover_the_query_set(spark, sf_dir):
    from weftgraph.plans.catalogue import QUERIES

    v = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {}
    for q in v:
        if q % 20 == 0:
            want[q] = sorted(((-round(cos(v[q], v[i]), 6), i) for i in v if i != q))[:5]
    got = {}
    for r in QUERIES["knn_top5"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert {r["query_id"] for r in QUERIES["knn_onehop"](spark, sf_dir).collect()} == set(want)

"""Text, chunk, URL, page and keyword queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators.graph import top_per_group
from ..functions.vectors import sigmoid
from ..operators.retrieval import missing_pairs, print_traces, render_chat
from ..operators.vectors import name_similarity
from ..sources.config import ontology
from ..sources.tables import load
from .registry import query

WORDS = r"list_filter(string_split_regex(lower({c}), '\s+'), lambda w: w <> '')"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("url_hierarchy", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, replace(host, 'www.', '') AS domain, coalesce(parts[1], '') AS division, parts[2] AS category, len(parts) AS depth FROM p""")
def url_hierarchy(spark, sf_dir):
    """F9, G10, P15, D14."""
    e = X.url_entry(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", *[e[c].alias(c) for c in ("domain", "division", "category", "depth")])


@query("url_depth_stats", r"""SELECT division, count(*) AS urls, count(DISTINCT category) AS categories, max(depth) AS depth FROM (SELECT coalesce(parts[1], '') AS division, parts[2] AS category, len(parts) AS depth FROM
 (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)) GROUP BY 1""")
def url_depth_stats(spark, sf_dir):
    """A24."""
    e = X.url_entry(F.col("url"))
    return load(spark, sf_dir, "pages").select(*[e[c].alias(c) for c in ("division", "category", "depth")]).groupBy("division").agg(F.count("*").alias("urls"), F.countDistinct("category").alias("categories"), F.max("depth").alias("depth"))


@query("unlinked_parents", r"""WITH p AS (SELECT page_id, lang, n FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS n FROM pages)),
j AS (SELECT a.page_id AS child, b.page_id AS parent FROM p a JOIN p b ON a.lang = b.lang AND a.n = b.n + 1)
SELECT child, parent FROM j WHERE child NOT IN (SELECT doc_id FROM labels)""")
def unlinked_parents(spark, sf_dir):
    """Candidate parents of pages that are not linked yet."""
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]+)/", 1).alias("lang"), F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("long").alias("n"))
    a, b = p.toDF("child", "lang", "n"), p.select(F.col("page_id").alias("parent"), "lang", (F.col("n") + 1).alias("n"))
    linked = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("child"))
    return a.join(b, ["lang", "n"]).select("child", "parent").join(linked, "child", "left_anti")


TRUST = [(1, ".gov", "suffix", "high"), (2, "example.com", "exact", "medium"), (3, "th", "contains", "low")]


@query("trust_level", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS d FROM pages)
SELECT page_id, CASE WHEN d LIKE '%.blocked.net' OR d LIKE '%.example.net' THEN 'blocked' WHEN d LIKE '%.gov' THEN 'high' WHEN d = 'example.com' OR d LIKE '%.example.com' THEN 'medium' WHEN contains(d, 'th') THEN 'low' ELSE 'unknown' END AS level FROM p""")
def trust_level(spark, sf_dir):
    """Blocked hosts first, then the first matching rule."""
    rules = spark.createDataFrame(TRUST, "ord int, pattern string, kind string, level string")
    blocked = spark.createDataFrame([("blocked.net",), ("example.net",)], "b string")
    p = load(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url")).alias("d"))
    ends = F.col("d").endswith(F.concat(F.lit("."), F.col("b")))
    bad = p.join(F.broadcast(blocked), (F.col("d") == F.col("b")) | ends, "left_semi").select("page_id", F.lit(True).alias("bad"))
    hit = (F.when(F.col("kind") == "suffix", F.col("d").endswith(F.col("pattern"))).when(F.col("kind") == "contains", F.contains("d", "pattern"))
           .otherwise((F.col("d") == F.col("pattern")) | F.col("d").endswith(F.concat(F.lit("."), F.col("pattern")))))
    first = p.join(F.broadcast(rules), hit).groupBy("page_id").agg(F.min_by("level", "ord").alias("l"))
    return p.join(bad, "page_id", "left").join(first, "page_id", "left").select("page_id", F.when(F.col("bad"), "blocked").otherwise(F.coalesce("l", F.lit("unknown"))).alias("level"))


@query("html_title", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages")
def html_title(spark, sf_dir):
    """The title by pattern."""
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n"))


@query("html_main")
def html_main(spark, sf_dir):
    """Main content by selector order, pages under 100 characters dropped."""
    from ..sources.html import main_content

    return main_content(load(spark, sf_dir, "pages"))


CHUNKS = """c AS (SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 900 + 1 AS INT), 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900.0) AS BIGINT), 1))) AS i FROM documents))"""


@query("chunk_fixed", f"WITH {CHUNKS} SELECT doc_id, chunk_index, length(content) AS n, md5(content) AS h FROM c")
def chunk_fixed(spark, sf_dir):
    """Windows of 1000 characters that overlap by 100."""
    c = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 1000, 100)).alias("chunk_index", "content"))
    return c.select("doc_id", "chunk_index", F.length("content").alias("n"), F.md5("content").alias("h"))


@query("chunk_ids", f"WITH {CHUNKS} SELECT doc_id, chunk_index, substr(sha256(doc_id||':'||chunk_index||':'||left(content, 100)), 1, 16) AS chunk_id FROM c")
def chunk_ids(spark, sf_dir):
    """F17, K9."""
    c = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 1000, 100)).alias("chunk_index", "content"))
    return c.select("doc_id", "chunk_index", X.short_hash(F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.substring("content", 1, 100)).alias("chunk_id"))


@query("clean_text", r"SELECT doc_id, md5(regexp_replace(" + "regexp_replace(" * 8 + r"text, '\n{3,}', chr(10)||chr(10), 'g'), ' {2,}', ' ', 'g'), " + "), ".join(
    f"'(?i){n}', '', 'g'" for n in X.NOISE_PAGE) + r"), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def clean_text(spark, sf_dir):
    """F5."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h"))


@query("normalized_names", r"SELECT p_partkey, regexp_replace(upper(p_name), '\W+', '_', 'g') AS rel, replace(trim(regexp_replace(replace(lower(p_name), '_', ' '), '\s+', ' ', 'g')), ' ', '_') AS key FROM part")
def normalized_names(spark, sf_dir):
    """F2, F3."""
    return load(spark, sf_dir, "part").select("p_partkey", X.relation_type(F.col("p_name")).alias("rel"), X.relation_key(F.col("p_name")).alias("key"))


@query("title_names", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name, left(p_type, 30) AS label FROM part")
def title_names(spark, sf_dir):
    """F1, F4."""
    return load(spark, sf_dir, "part").select("p_partkey", X.title_case(F.col("p_name")).alias("name"), X.clean_label(F.concat(F.lit("**Type**: "), F.col("p_type"))).alias("label"))


@query("keyword_extract", f"SELECT item_id, array_to_string(list_transform(list_filter({WORDS.format(c='text')}, lambda w: length(w) > 2 AND w NOT IN {_in(X.STOP_QUERY)}), lambda w: trim(w, '''\",.?!')), ' ') AS kw FROM benchmark")
def keyword_extract(spark, sf_dir):
    """F12."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.keywords(F.col("text")), " ").alias("kw"))


@query("keyword_study", f"SELECT item_id, array_to_string(list_filter({WORDS.format(c='''replace(replace(text, '?', ''), '.', '')''')}, lambda w: length(w) > 2 AND w NOT IN {_in(X.STOP_STUDY)}), ' ') AS kw FROM benchmark")
def keyword_study(spark, sf_dir):
    """F12."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.keywords_study(F.col("text")), " ").alias("kw"))


def _count_sql(k: str) -> str:
    return f"(length(text) - length(replace(lower(text), '{k}', ''))) // {len(k)}"


@query("ontology_hits", "SELECT doc_id, " + ", ".join(f"{' + '.join(_count_sql(k) for k in ks)} AS {t.lower()}" for t, ks in X.TYPE_HINTS.items()) + " FROM documents")
def ontology_hits(spark, sf_dir):
    """hits of each type's words by document."""
    return load(spark, sf_dir, "documents").select("doc_id", *[X.hits(F.col("text"), ks).alias(t.lower()) for t, ks in X.TYPE_HINTS.items()])


@query("ontology_found", "WITH h AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{t}' AS label, sum({' + '.join(_count_sql(k) for k in ks)}) AS n, {least} AS least FROM documents"
    for kind, hints, least in (("type", X.TYPE_HINTS, 3), ("relation", X.RELATION_HINTS, 2)) for t, ks in hints.items())
    + "), b AS (SELECT * FROM (VALUES ('type','Person'),('type','Turbine'),('relation','USES'),('relation','OWNS')) t(kind, label))"
    + " SELECT kind, label, max(base) AS in_base FROM (SELECT kind, label, false AS base FROM h WHERE n >= least UNION ALL SELECT kind, label, true FROM b) GROUP BY 1, 2")
def ontology_found(spark, sf_dir):
    """types seen three times or more and relations seen twice, merged into a base ontology."""
    d = load(spark, sf_dir, "documents")
    rows = [("type", t, ks, 3) for t, ks in X.TYPE_HINTS.items()] + [("relation", t, ks, 2) for t, ks in X.RELATION_HINTS.items()]
    sums = d.agg(*[F.sum(X.hits(F.col("text"), ks)).alias(f"{kind}:{t}") for kind, t, ks, _ in rows])
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("label"), (F.coalesce(F.col(f"`{kind}:{t}`"), F.lit(0)) >= least).alias("ok")) for kind, t, _, least in rows])
    found = sums.select(F.explode(pairs).alias("p")).select("p.*").filter("ok").select("kind", "label", F.lit(False).alias("in_base"))
    base = ontology(spark, {"Person": "a human", "Turbine": "a machine"}, "type").unionByName(ontology(spark, {"USES": "", "OWNS": ""}, "relation"))
    return found.unionByName(base.select("kind", "label", F.lit(True).alias("in_base"))).groupBy("kind", "label").agg(F.max("in_base").alias("in_base"))


@query("keyword_gate", "SELECT doc_id FROM documents WHERE contains(text, 'MW') OR contains(text, 'the ') OR regexp_matches(text, 'net|out') OR lang IN ('de')")
def keyword_gate(spark, sf_dir):
    """P3."""
    return load(spark, sf_dir, "documents").filter(F.contains("text", F.lit("MW")) | F.contains("text", F.lit("the ")) | F.col("text").rlike("net|out") | F.col("lang").isin("de")).select("doc_id")


@query("name_pattern", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '(?i)[a-z]+ [a-z]+.*') AND length(p_name) < 30")
def name_pattern(spark, sf_dir):
    """P10."""
    return load(spark, sf_dir, "part").filter(F.col("p_name").rlike("(?i)^[a-z]+ [a-z]+.*$") & (F.length("p_name") < 30)).select("p_partkey", "p_name")


@query("label_missing", "SELECT count_if(c_name = c_mktsegment) AS missing, count_if(c_name <> c_mktsegment) AS named FROM customer")
def label_missing(spark, sf_dir):
    """P11."""
    c = F.col("c_name") == F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").agg(F.count_if(c).alias("missing"), F.count_if(~c).alias("named"))


@query("pages_with_url", "SELECT page_id, url, coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END, 0) AS score FROM pages WHERE url IS NOT NULL AND url <> '' AND coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END, 0) >= 10 ORDER BY score DESC, page_id LIMIT 40")
def pages_with_url(spark, sf_dir):
    """P5, B18."""
    s = F.coalesce(F.when(F.col("page_id") % 3 != 0, F.col("page_id")), F.lit(0))
    return load(spark, sf_dir, "pages").filter(F.col("url").isNotNull() & (F.col("url") != "")).select("page_id", "url", s.alias("score")).filter("score >= 10").orderBy(F.col("score").desc(), "page_id").limit(40)


@query("both_sources", "SELECT p_partkey, n FROM (SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS n, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) WHERE list_contains(f, 'A') AND list_contains(f, 'R') ORDER BY n DESC, p_partkey LIMIT 50")
def both_sources(spark, sf_dir):
    """P6."""
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n"), F.collect_set("l_returnflag").alias("f"))
    return g.filter(F.array_contains("f", "A") & F.array_contains("f", "R")).orderBy(F.col("n").desc(), "p_partkey").limit(50).select("p_partkey", "n")


@query("shared_word_pairs", rf"""WITH w AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({WORDS.format(c='text')}) AS w FROM benchmark) WHERE length(w) > 4)
SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id JOIN w ON w.item_id = a.item_id AND contains(lower(b.text), w.w)
WHERE b.item_id <> a.item_id + 1""")
def shared_word_pairs(spark, sf_dir):
    """Items that are not linked (here: to the next one), though a word of more
    than four letters of the first occurs in the other text."""
    b = load(spark, sf_dir, "benchmark")
    linked = b.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return missing_pairs(b.select(F.col("item_id").alias("id"), "text"), linked)


@query("shared_token_pairs", rf"""WITH w AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({WORDS.format(c='text')}) AS w FROM benchmark) WHERE length(w) > 4)
SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id""")
def shared_token_pairs(spark, sf_dir):
    """The token form, an equality join."""
    w = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("w")).filter(F.length("w") > 4)
    return w.select(F.col("item_id").alias("a"), "w").join(w.select(F.col("item_id").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()


@query("label_similarity", """WITH l AS (SELECT DISTINCT p_brand AS category, p_name AS label FROM part)
SELECT a.category, a.label AS a, b.label AS b, round(1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)), 6) AS sim FROM l a JOIN l b ON a.category = b.category AND a.label < b.label
WHERE 1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)) > 0.7""")
def label_similarity(spark, sf_dir):
    """Labels of one category above 0.7, pairs pruned by length before the distance."""
    n = load(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("label")).distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    sim = 1 - F.levenshtein("a", "b") / longest
    met = n.toDF("category", "a").join(n.toDF("category", "b"), "category").filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) < 0.3 * longest))
    return met.select("category", "a", "b", F.round(sim, 6).alias("sim"), sim.alias("s")).filter("s > 0.7").drop("s")


@query("name_cascade", """WITH c AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red wodget' THEN 1 WHEN levenshtein(lower(p_name), 'red wodget') <= 2 THEN 2 WHEN contains(lower(p_name), 'red wodget') THEN 3 END AS tier FROM part)
SELECT p_partkey, p_name, tier FROM c WHERE tier = (SELECT min(tier) FROM c)""")
def name_cascade(spark, sf_dir):
    """exact, else near, else containing names."""
    low = F.lower("p_name")
    tier = F.when(low == "red wodget", 1).when(F.levenshtein(low, F.lit("red wodget")) <= 2, 2).when(F.contains(low, F.lit("red wodget")), 3)
    c = load(spark, sf_dir, "part").select("p_partkey", "p_name", tier.alias("tier")).dropna(subset=["tier"])
    best = c.agg(F.min("tier").alias("tier"))
    return c.join(F.broadcast(best), "tier").select("p_partkey", "p_name", "tier")


@query("rank_articles", "SELECT p_partkey, round(0.4*least(p_size/100.0,1.0)+0.3*least(p_retailprice/5000.0,1.0)+0.2*(length(p_name)>10)::INT+0.1*contains(p_type,'SMALL')::INT, 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 50")
def rank_articles(spark, sf_dir):
    """F22, O4."""
    url = F.when(F.contains("p_type", F.lit("SMALL")), "https://en.wikipedia.org/x").otherwise("")
    s = S.article_rank(F.col("p_size"), F.col("p_retailprice") / 100.0, F.col("p_name"), url)
    return load(spark, sf_dir, "part").select("p_partkey", F.round(s, 6).alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(50)


KW = ("the", "de", "ening")


@query("keyword_search", """WITH h AS (SELECT doc_id, (1.5 * contains(lower(text),'the')::INT + 1.0 * contains(lower(text),'ening')::INT + 0.8 * contains(lower(text),'worthless')::INT) AS score FROM documents)
SELECT doc_id, round(score, 6) AS score FROM h WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def keyword_search(spark, sf_dir):
    """Additive keyword passes, capped by a total order."""
    low = F.lower("text")
    parts = [F.when(F.contains(low, F.lit(k)), w).otherwise(0.0) for k, w in (("the", 1.5), ("ening", 1.0), ("worthless", 0.8))]
    return load(spark, sf_dir, "documents").select("doc_id", F.round(parts[0] + parts[1] + parts[2], 6).alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(25)


@query("word_windows", f"SELECT item_id, len(range(0, greatest(CAST(ceil(len({WORDS.format(c='text')}) / 10.0) AS BIGINT), 1))) AS windows FROM benchmark")
def word_windows(spark, sf_dir):
    """F16, B13."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(X.word_windows(F.col("text"), 20)).cast("long").alias("windows"))


@query("truncations", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77)||'...' ELSE text END AS t, left(text, 50) AS s FROM documents")
def truncations(spark, sf_dir):
    """F18, F19, R12, K13."""
    return load(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("t"), F.substring("text", 1, 50).alias("s"))


@query("event_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_json(spark, sf_dir):
    """F20, F21."""
    return load(spark, sf_dir, "events").select("event_id", F.from_json(X.fenced_json(F.col("props")), "k long").getField("k").alias("k"))


@query("abstract_paragraph")
def abstract_paragraph(spark, sf_dir):
    """The best scored paragraph, the earliest of equals."""
    p = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("pos", "para")).filter(F.length("para") >= 50)
    s = p.withColumn("score", X.paragraph_score(F.col("para"), F.lit("the")))
    best = s.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "para")).alias("m"))
    return best.select("doc_id", F.col("m.pos").alias("pos"), X.cut_at_sentence(F.col("m.para"), 300).alias("abstract"))


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    """sentences cut where the similarity of neighbours is lowest (word overlap
    stands in for an embedding): the running count of cuts numbers the chunks."""
    s = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    w = Window.partitionBy("item_id").orderBy("pos")
    words, before = F.array_distinct(X.words(F.col("sentence"))), F.lag(F.array_distinct(X.words(F.col("sentence")))).over(w)
    s = s.withColumn("sim", F.size(F.array_intersect(words, before)) / F.size(F.array_union(words, before)))
    cut = s.groupBy("item_id").agg(F.percentile(1 - F.col("sim"), 0.85).alias("cut"))
    s = s.join(cut, "item_id").withColumn("new", F.coalesce(((1 - F.col("sim")) > F.col("cut")).cast("int"), F.lit(0)))
    return s.withColumn("chunk", F.sum("new").over(w)).groupBy("item_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("content"))


@query("recursive_split")
def recursive_split(spark, sf_dir):
    """recursive splitting by a list of separators."""
    from ..functions.splitters import split_documents

    return split_documents(load(spark, sf_dir, "documents"), 1000, 100)


@query("raptor_tree")
def raptor_tree(spark, sf_dir):
    """Leaves, clusters of leaves and a root per document."""
    from ..functions.splitters import split_documents

    leaves = split_documents(load(spark, sf_dir, "documents"), 1000, 100).select(
        "doc_id", "chunk_index", F.lit(2).alias("level"), F.concat_ws(":", "doc_id", F.lit("c"), F.floor(F.col("chunk_index") / 3)).alias("parent"), F.concat_ws(":", "doc_id", F.lit("l"), "chunk_index").alias("id"))
    clusters = leaves.groupBy("doc_id", F.col("parent").alias("id")).agg(F.min("chunk_index").alias("chunk_index")).select("doc_id", "chunk_index", F.lit(1).alias("level"), F.concat_ws(":", "doc_id", F.lit("r")).alias("parent"), "id")
    roots = leaves.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("chunk_index"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), F.concat_ws(":", "doc_id", F.lit("r")).alias("id"))
    return leaves.unionByName(clusters).unionByName(roots)


@query("chat_messages", "SELECT doc_id, 'Extract a graph.' AS system, text AS user_text, CASE WHEN length(text) < 600 THEN 'short' WHEN length(text) < 1500 THEN 'medium' ELSE 'long' END AS template FROM documents WHERE length(text) >= 50")
def chat_messages(spark, sf_dir):
    """The user message holds the whole text."""
    return _messages(load(spark, sf_dir, "documents"), F.col("text"))


def _messages(d, text):
    d = d.filter(F.length("text") >= 50)
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("Extract a graph.").alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
    return d.select("doc_id", m.alias("m"), S.prompt_size(F.length("text")).alias("template")).select("doc_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user_text"), "template")


@query("first_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index FROM c WHERE chunk_index < 3 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id)")
def first_chunks(spark, sf_dir):
    """The first chunks of documents that no cache holds."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return d.select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 1000, 100)).alias("chunk_index", "c")).filter("chunk_index < 3").select("doc_id", "chunk_index")


@query("type_mapping", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#2','Brand#17') THEN p_brand WHEN p_type IN ('Brand#2','Brand#17') THEN p_type ELSE p_brand END AS t FROM part")
def type_mapping(spark, sf_dir):
    """F29."""
    return load(spark, sf_dir, "part").select("p_partkey", X.ontology_type(F.array("p_brand", "p_type"), ("Brand#2", "Brand#17")).alias("t"))


@query("source_types", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'web' WHEN 2 THEN 'graph' ELSE coalesce(lower(source), 'unknown') END AS kind FROM documents")
def source_types(spark, sf_dir):
    """source names brought to their canonical form."""
    given = F.when(F.col("doc_id") % 4 == 0, "Wikipedia").when(F.col("doc_id") % 4 == 1, "web_search").when(F.col("doc_id") % 4 == 2, "Neo4j").otherwise(F.col("source"))
    return load(spark, sf_dir, "documents").select("doc_id", X.source_type(given).alias("kind"))


@query("name_scores", """SELECT a.p_partkey, round(CASE WHEN n = 'red widget' THEN 1.0 WHEN contains(n, 'red widget') OR contains('red widget', n) THEN 0.85 ELSE len(list_intersect(string_split(n, ' '), ['red','widget'])) / len(list_distinct(list_concat(string_split(n, ' '), ['red','widget']))) END, 6) AS score
FROM (SELECT p_partkey, lower(p_name) AS n FROM part) a""")
def name_scores(spark, sf_dir):
    """Names against a mention: equal, contained, or by shared words."""
    return load(spark, sf_dir, "part").select("p_partkey", F.round(name_similarity(F.col("p_name"), F.lit("Red widget")), 6).alias("score"))


@query("query_texts", """SELECT p_partkey, p_partkey % 5 IN (0, 1) AS valid FROM part""")
def query_texts(spark, sf_dir):
    """Which texts look like a graph query."""
    forms = ("MATCH (n {name: 'NAME'})-[r]->(m) RETURN m", "match (n) return n.name, 'NAME'", "MATCH (n {name: 'NAME'} RETURN n", "```MATCH (n) RETURN n // NAME```", "DELETE (n) -- NAME")
    text = F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("NAME"), F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", X.looks_like_query(text).alias("valid"))


@query("wiki_titles", "SELECT p_partkey, p_name||' (part)' AS title, 'en.wikipedia.org' AS host FROM part")
def wiki_titles(spark, sf_dir):
    """the article and host of a wiki url."""
    url = F.concat(F.lit("https://EN.wikipedia.org/wiki/"), F.url_encode(F.replace(F.concat("p_name", F.lit(" (part)")), F.lit(" "), F.lit("_"))), F.lit("?action=view"))
    return load(spark, sf_dir, "part").select("p_partkey", X.wiki_title(url).alias("title"), X.domain(url).alias("host"))


@query("number_functions", """SELECT p_partkey, round(ln(p_retailprice), 6) AS ln_price, round(exp(-p_size / 10.0), 6) AS decay, round(1 / (1 + exp(-p_size / 10.0)), 6) AS squashed, greatest(0.0, least(1.0, p_size / 40.0)) AS clamped, round(100.0 * p_size / (SELECT sum(p_size) FROM part), 6) AS percent FROM part""")
def number_functions(spark, sf_dir):
    """logarithm, exponential, sigmoid, clamp and share of the whole."""
    size = F.col("p_size").cast("double")
    total = F.sum("p_size").over(Window.partitionBy())
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.log("p_retailprice"), 6).alias("ln_price"), F.round(F.exp(-size / 10), 6).alias("decay"), F.round(sigmoid(size / 10), 6).alias("squashed"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), size / 40)).alias("clamped"), F.round(100 * size / total, 6).alias("percent"))


@query("section_pieces", "SELECT item_id, i AS pos, trim(CASE i WHEN 0 THEN text ELSE '## Part '||i||chr(10)||left(text, 40) END) AS piece FROM benchmark, (VALUES (0), (1), (2)) t(i)")
def section_pieces(spark, sf_dir):
    """a text cut before its level-two headings."""
    part = lambda i: F.concat(F.lit(f"## Part {i}\n"), F.substring("text", 1, 40))
    whole = F.concat(F.col("text"), F.lit("\n"), part(1), F.lit("\n"), part(2))
    return load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.sections(whole)).alias("pos", "piece")).withColumn("piece", F.trim(F.regexp_replace("piece", r"\s+$", "")))


@query("first_paragraphs")
def first_paragraphs(spark, sf_dir):
    """the first paragraph of some length that is no heading."""
    return load(spark, sf_dir, "documents").select("doc_id", X.first_paragraph(F.regexp_replace("text", r"\n", "\n\n"), 300).alias("paragraph"))


@query("agent_prompts", r"""SELECT conv_id, '<|im_start|>system'||chr(10)||'You answer from the graph.<|im_end|>'||chr(10)||string_agg('<|im_start|>'||role||chr(10)||text||'<|im_end|>', chr(10) ORDER BY turn) AS prompt
FROM conversations WHERE role IN ('user', 'assistant') AND NOT (role = 'assistant' AND text = '') GROUP BY 1""")
def agent_prompts(spark, sf_dir):
    """F32: turns in the chat template, system prompt first."""
    return render_chat(load(spark, sf_dir, "conversations"), "You answer from the graph.").select("conv_id", "prompt")


@query("agent_traces", r"""SELECT conv_id, count(*) AS steps, md5(string_agg(text, '|' ORDER BY turn)) AS thoughts FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations WHERE role = 'user') GROUP BY 1""")
def agent_traces(spark, sf_dir):
    """F32: traces printed as text and parsed again."""
    c = load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("thought"))
    steps = c.withColumns({"action": F.lit("graph_lookup"), "action_input": F.to_json(F.struct("turn")), "observation": F.lit("found")})
    parsed = X.parse_trace(F.col("trace"))
    back = print_traces(steps).select("conv_id", F.posexplode(parsed).alias("pos", "s")).filter("s.thought <> 'done'")
    g = back.groupBy("conv_id").agg(F.count("*").alias("steps"), F.array_sort(F.collect_list(F.struct("pos", F.col("s.thought").alias("t")))).alias("l"))
    return g.select("conv_id", "steps", F.md5(F.array_join(F.transform("l", lambda x: x["t"]), "|")).alias("thoughts"))


@query("context_lines", "SELECT n_regionkey, string_agg(line, chr(10) ORDER BY line) AS context FROM (SELECT n_regionkey, '- '||n_name AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation) WHERE r <= 8 GROUP BY 1")
def context_lines(spark, sf_dir):
    """F30, R2."""
    n = top_per_group(load(spark, sf_dir, "nation"), ["n_regionkey"], [F.col("n_name")], 8)
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("n_name")))), "\n").alias("context"))

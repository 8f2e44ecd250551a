"""Answer, retrieval and trajectory quality metrics; conversations stand for traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators.retrieval import compress
from ..sources.tables import load
from .registry import query
from .text_queries import WORDS, _in, _list

QA = """qa AS (SELECT conv_id, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a USING(conv_id) WHERE q.role = 'user' AND a.role = 'assistant' AND a.turn = q.turn + 1 AND q.turn <= 1)"""


def qa(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    q = c.filter("role = 'user' and turn <= 1").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(q, ["conv_id", "turn"]).select("conv_id", "question", "answer")


def _content(c: str, stop) -> str:
    return f"list_distinct(list_filter({WORDS.format(c=c)}, lambda w: w NOT IN {_in(stop)}))"


@query("faithfulness", f"WITH {QA}, w AS (SELECT conv_id, {_content('answer', S.STOP_FAITH)} AS c, lower(question) AS ctx FROM qa) SELECT conv_id, round(CASE WHEN len(c) = 0 THEN 0.5 ELSE len(list_filter(c, lambda w: contains(ctx, w))) / len(c) END, 6) AS score FROM w")
def faithfulness(spark, sf_dir):
    """The question stands for the context."""
    return qa(spark, sf_dir).select("conv_id", F.round(S.faithfulness(F.col("answer"), F.col("question")), 6).alias("score"))


@query("relevance", f"WITH {QA}, w AS (SELECT conv_id, {_content('question', S.STOP_RELEVANCE)} AS q, {_content('answer', S.STOP_RELEVANCE)} AS a FROM qa) SELECT conv_id, round(CASE WHEN len(q) = 0 THEN 0.5 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS score FROM w")
def relevance(spark, sf_dir):
    """E7."""
    return qa(spark, sf_dir).select("conv_id", F.round(S.relevance(F.col("question"), F.col("answer")), 6).alias("score"))


@query("groundedness", f"WITH {QA}, w AS (SELECT conv_id, {_content('question', S.STOP_GROUND)} AS q, {_content('answer', S.STOP_GROUND)} AS a FROM qa) SELECT conv_id, round(CASE WHEN len(a) = 0 THEN 0.5 ELSE least(1.0, 1.5 * len(list_intersect(q, a)) / len(a)) END, 6) AS score FROM w")
def groundedness(spark, sf_dir):
    """E11."""
    return qa(spark, sf_dir).select("conv_id", F.round(S.groundedness(F.col("answer"), F.col("question")), 6).alias("score"))


@query("fluency", f"""WITH w AS (SELECT item_id, text, {WORDS.format(c='text')} AS w, len(string_split(text, '.')) AS d FROM benchmark)
SELECT item_id, round(CASE WHEN len(w) < 5 THEN 0.3 WHEN len(w) > 500 THEN 0.7 ELSE greatest(0.2, least(1.0, 0.8 - CASE WHEN len(w) / d < 3 THEN 0.2 ELSE 0 END - CASE WHEN len(list_distinct(w)) / len(w) < 0.3 THEN 0.2 ELSE 0 END)) END, 6) AS score FROM w""")
def fluency(spark, sf_dir):
    """E11."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.round(S.fluency(F.col("text")), 6).alias("score"))


@query("ngram_recall", f"""WITH {QA}, w AS (SELECT conv_id, {WORDS.format(c='answer')} AS w, lower(question) AS c FROM qa), g AS (SELECT conv_id, c, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM w)
SELECT conv_id, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_filter(g, lambda x: contains(c, x))) / len(g) END, 6) AS score FROM g""")
def ngram_recall(spark, sf_dir):
    """E8."""
    return qa(spark, sf_dir).select("conv_id", F.round(S.trigram_recall(F.col("answer"), F.col("question")), 6).alias("score"))


@query("claims_split", r"SELECT item_id, len(list_filter(list_transform(string_split(replace(replace(text, '!', '.'), '?', '.'), '.'), lambda s: trim(s)), lambda s: length(s) > 10)) AS claims FROM benchmark")
def claims_split(spark, sf_dir):
    """E8, D15."""
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(S.claims(F.col("text"))).cast("long").alias("claims"))


REJ = f"list_filter({_list(S.REJECTION)}, lambda p: contains(lower(t), p))"


@query("rejection_detect", f"""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'I cannot answer; unable to determine. ' WHEN 1 THEN 'No data found: ' ELSE 'According to the text ' END || text AS t, (doc_id % 10) / 10.0 AS conf FROM documents),
n AS (SELECT doc_id, conf, len({REJ}) AS n, len(list_filter({_list(S.CONFIDENCE)}, lambda p: contains(lower(t), p))) AS s FROM a)
SELECT doc_id, CASE WHEN conf < 0.2 THEN true WHEN s > 0 AND conf > 0.7 THEN false ELSE n >= 2 OR (n >= 1 AND conf < 0.5) END AS rejected, round(CASE WHEN conf < 0.2 THEN greatest(least(n / 5.0, 1.0), 0.8) ELSE least(n / 5.0, 1.0) END, 6) AS strength FROM n""")
def rejection_detect(spark, sf_dir):
    """Phrases anywhere in the text."""
    return _rejections(load(spark, sf_dir, "documents"), F.col("text"))


def _rejections(d, text):
    lead = F.when(F.col("doc_id") % 4 == 0, "I cannot answer; unable to determine. ").when(F.col("doc_id") % 4 == 1, "No data found: ").otherwise("According to the text ")
    a = d.select("doc_id", F.concat(lead, text).alias("t"), (F.col("doc_id") % 10 / 10.0).alias("conf"))
    return a.select("doc_id", S.is_rejection(F.col("t"), F.col("conf")).alias("rejected"), F.round(S.rejection_strength(F.col("t"), F.col("conf")), 6).alias("strength"))


@query("traversal_efficiency", """WITH v AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS vis FROM orders GROUP BY 1)
SELECT c_custkey, round(CASE WHEN vis IS NULL THEN 0.0 ELSE len(list_intersect(['1-URGENT','2-HIGH'], vis)) / len(vis) END, 6) AS score FROM customer LEFT JOIN v ON k = c_custkey""")
def traversal_efficiency(spark, sf_dir):
    """E1."""
    v = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("v"))
    want = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    vis = F.coalesce("v", F.array().cast("array<string>"))
    return load(spark, sf_dir, "customer").join(v, "c_custkey", "left").select("c_custkey", F.round(S.efficiency(want, vis), 6).alias("score"))


@query("loop_efficiency", """WITH s AS (SELECT conv_id, count(*) AS n, count(*) - count(DISTINCT role) AS red FROM conversations GROUP BY 1)
SELECT conv_id, round(greatest(0.0, least(3.0 / n, 1.0) - 0.1 * red), 6) AS score FROM s""")
def loop_efficiency(spark, sf_dir):
    """E3."""
    s = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("r"))
    return s.select("conv_id", F.round(S.loop_efficiency(F.lit(3.0), F.col("n"), F.col("n") - F.col("r")), 6).alias("score"))


@query("trajectory_coherence", f"""WITH t AS (SELECT conv_id, turn, {WORDS.format(c='text')} AS w, lag({WORDS.format(c='text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, round(coalesce(avg(CASE WHEN p IS NOT NULL THEN CASE WHEN len(list_intersect(list_slice(p, 1, 20), w)) > 0 THEN 0.9 ELSE 0.7 END END), 1.0), 6) AS score FROM t GROUP BY 1""")
def trajectory_coherence(spark, sf_dir):
    """E14, W6."""
    w = X.words(F.col("text"))
    p = F.lag(F.slice(w, 1, 20)).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = load(spark, sf_dir, "conversations").select("conv_id", w.alias("w"), p.alias("p"))
    return t.groupBy("conv_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("p").isNotNull(), F.when(F.arrays_overlap("p", "w"), 0.9).otherwise(0.7))), F.lit(1.0)), 6).alias("score"))


@query("trajectory_overall", f"""WITH {QA}, w AS (SELECT conv_id, list_distinct({WORDS.format(c='question')}) AS q, list_distinct({WORDS.format(c='answer')}) AS a FROM qa),
r AS (SELECT conv_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE least(1.0, 2.0 * len(list_intersect(q, a)) / len(q)) END AS rel FROM w), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, round(0.3 * rel + 0.7 * CASE WHEN n <= 3 THEN 1.0 WHEN n <= 5 THEN 0.8 WHEN n <= 7 THEN 0.5 ELSE 0.3 END, 6) AS overall FROM r JOIN n USING(conv_id)""")
def trajectory_overall(spark, sf_dir):
    """E14."""
    q, a = F.array_distinct(X.words(F.col("question"))), F.array_distinct(X.words(F.col("answer")))
    rel = F.when(F.size(q) == 0, 0.0).otherwise(F.least(F.lit(1.0), 2.0 * F.size(F.array_intersect(q, a)) / F.size(q)))
    n = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return qa(spark, sf_dir).join(n, "conv_id").select("conv_id", F.round(0.3 * rel + 0.7 * S.step_ladder(F.col("n"), F.lit(3)), 6).alias("overall"))


@query("source_credibility", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS d FROM pages) SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 1.0 WHEN d = '' THEN 0.3 WHEN contains(d, 'example.org') THEN 0.9 WHEN contains(d, 'wikipedia.org') THEN 0.8 ELSE 0.5 END AS score FROM p""")
def source_credibility(spark, sf_dir):
    """E9."""
    kind = F.when(F.col("page_id") % 9 == 0, "graph").otherwise("web")
    return load(spark, sf_dir, "pages").select("page_id", S.credibility(kind, X.domain(F.col("url")), ("example.org",)).alias("score"))


@query("url_validity", r"""SELECT page_id, CASE WHEN regexp_matches(url, '(localhost|example\.com|test\.com|bit\.ly)') AND regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE '%example.com%' THEN 'suspicious' ELSE 'valid' END AS status FROM pages WHERE regexp_matches(url, '^https?://[a-z.0-9-]+/[^ ]*$')""")
def url_validity(spark, sf_dir):
    """D14."""
    return load(spark, sf_dir, "pages").filter(F.col("url").rlike(r"^https?://[a-z.0-9-]+/[^ ]*$")).select("page_id", S.url_validity(F.col("url"), X.domain(F.col("url"))).alias("status"))


@query("schema_adherence", "SELECT event_type, count(*) AS n, count_if(event_type NOT IN ('click','view','purchase')) AS violations, count_if(value IS NULL) AS warnings, round(count_if(event_type IN ('click','view','purchase')) / count(*), 6) AS valid FROM events GROUP BY 1")
def schema_adherence(spark, sf_dir):
    """Types checked against an ontology table."""
    known = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string").withColumn("known", F.lit(True))
    e = load(spark, sf_dir, "events").join(F.broadcast(known), "event_type", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("violations"), F.count_if(F.col("value").isNull()).alias("warnings"), F.round(F.count_if("known") / F.count("*"), 6).alias("valid"))


@query("citation_status", "WITH s AS (SELECT vec_id, label = 1 AS exact, abs(embedding[1]::DOUBLE) * 5 AS sim FROM embeddings) SELECT vec_id, CASE WHEN exact OR sim >= 0.75 THEN 'verified' WHEN sim >= 0.5 THEN 'partial' ELSE 'hallucinated' END AS status FROM s")
def citation_status(spark, sf_dir):
    """E12, D16."""
    sim = F.abs(F.col("embedding")[0].cast("double")) * 5
    return load(spark, sf_dir, "embeddings").select("vec_id", S.citation_status(F.col("label") == 1, sim).alias("status"))


@query("overlap_ratio", "WITH g AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS p, list(DISTINCT l_suppkey) AS g FROM lineitem GROUP BY 1) SELECT k, round(CASE WHEN p IS NULL THEN 0.0 ELSE len(list_intersect(p, g)) / len(g) END, 6) AS ratio FROM g")
def overlap_ratio(spark, sf_dir):
    """E13."""
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("p"), F.collect_set("l_suppkey").alias("g"))
    return g.select("k", F.round(S.overlap_ratio(F.col("p"), F.col("g")), 6).alias("ratio"))


@query("context_overlap", f"""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS r FROM conversations GROUP BY 1), t AS (SELECT conv_id, [text] AS t FROM conversations WHERE turn = 0)
SELECT conv_id, round(len(list_filter(r, lambda x: contains(lower(x), lower(t[1])) OR contains(lower(t[1]), lower(x)))) / len(r), 6) AS precision, CASE WHEN contains(lower(array_to_string(r, ' ')), lower(t[1])) THEN 1.0 ELSE 0.0 END AS recall FROM c JOIN t USING(conv_id)""")
def context_overlap(spark, sf_dir):
    """E5: whole contexts against the whole truth."""
    return _context_overlap(load(spark, sf_dir, "conversations"), F.col("text"), F.col("text"))


def _context_overlap(c, context, truth):
    r = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", context.alias("t")))), lambda x: x["t"]).alias("r"))
    t = c.filter("turn = 0").select("conv_id", F.array(truth).alias("t"))
    return r.join(t, "conv_id").select("conv_id", F.round(S.context_precision(F.col("r"), F.col("t")), 6).alias("precision"), S.context_recall(F.col("r"), F.col("t")).cast("double").alias("recall"))


@query("perplexity_scores", "WITH p AS (SELECT user_id, avg(-value / 50) AS lp FROM events GROUP BY 1) SELECT user_id, round(exp(-lp), 4) AS perplexity, round(greatest(0.0, 1 - exp(-lp) / 100), 6) AS score, round((0.4 * greatest(0.0, 1 - exp(-lp) / 100) + 0.3 * 0.8) / 0.7, 6) AS combined FROM p")
def perplexity_scores(spark, sf_dir):
    """without a consistency value the weights of the others are scaled up."""
    p = load(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(-F.col("value") / 50).alias("lp"))
    s = S.perplexity_score(F.col("lp"))
    return p.select("user_id", F.round(F.exp(-F.col("lp")), 4).alias("perplexity"), F.round(s, 6).alias("score"), F.round(S.combined_confidence(s, F.lit(0.2), F.lit(None).cast("double")), 6).alias("combined"))


@query("candidate_scores", "SELECT p_partkey, least(CASE WHEN lower(p_brand) = 'brand#1' THEN 1.0 WHEN contains(lower(p_brand), 'brand#1') THEN 0.5 ELSE 0.0 END + CASE WHEN p_size > 25 THEN 0.3 ELSE 0.0 END, 1.0) AS score FROM part")
def candidate_scores(spark, sf_dir):
    """F26, V12."""
    return load(spark, sf_dir, "part").select("p_partkey", S.candidate_score(F.col("p_brand"), F.lit("Brand#1"), F.col("p_size") > 25).alias("score"))


@query("facts_found", "SELECT doc_id, round(len(list_filter(['the', 'thatnever', 'ening'], lambda f: contains(lower(text), f))) / 3, 6) AS score FROM documents")
def facts_found(spark, sf_dir):
    """D12."""
    return load(spark, sf_dir, "documents").select("doc_id", F.round(S.facts_found(F.col("text"), F.array(*[F.lit(x) for x in ("the", "thatnever", "ening")])), 6).alias("score"))


@query("duplicate_penalty", "SELECT user_id, greatest(0.0, 1 - count_if(event_type = 'click') * 0.02) AS score FROM events GROUP BY 1")
def duplicate_penalty(spark, sf_dir):
    """D13."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(S.duplicate_penalty(F.count_if(F.col("event_type") == "click"), 0.02).alias("score"))


@query("update_action", "SELECT c_mktsegment, CASE WHEN s < 0.45 THEN 'rollback' WHEN s < 0.5 THEN 'warn' ELSE 'commit' END AS action FROM (SELECT c_mktsegment, avg(c_acctbal) / 9000 AS s FROM customer GROUP BY 1)")
def update_action(spark, sf_dir):
    """E15, E16."""
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(S.update_action(F.avg("c_acctbal") / 9000, 0.5, 0.45).alias("action"))


@query("compression_bands", "SELECT doc_id, length(c) AS n, length(c) / greatest(length(text), 1) BETWEEN 0.1 AND 0.4 AS in_band FROM (SELECT doc_id, text, CASE WHEN length(text) < 500 THEN text ELSE left(text, 1000) END AS c FROM documents)")
def compression_bands(spark, sf_dir):
    """Compressed contexts and whether their ratio is in the band."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", compress(F.col("text")).alias("c"))
    return d.select("doc_id", F.length("c").alias("n"), S.compression_band(F.length("text"), F.length("c")).alias("in_band"))


@query("tool_scores", """SELECT item_id, tool, CASE WHEN contains(q, 'what is') AND tool = 'graph_lookup' THEN 0.9 WHEN contains(q, 'latest') AND tool = 'web_search' THEN 0.9 WHEN contains(q, 'latest') AND tool = 'graph_lookup' THEN 0.5 WHEN contains(q, 'who') AND tool = 'graph_lookup' THEN 0.8 ELSE 0.7 END AS score,
 2 + CASE WHEN n > 0 THEN greatest(1, n // 3) ELSE 0 END + CASE WHEN m > 0 THEN greatest(1, m // 2) ELSE 0 END AS steps
FROM (SELECT item_id, lower(CASE item_id % 4 WHEN 0 THEN 'What is ' WHEN 1 THEN 'Latest ' WHEN 2 THEN 'Who ' ELSE '' END || text) AS q, item_id % 8 AS n, item_id % 5 AS m FROM benchmark), (VALUES ('graph_lookup'), ('web_search')) t(tool)
WHERE NOT contains(q, 'define') AND NOT contains(q, 'current')""")
def tool_scores(spark, sf_dir):
    """How well a tool suits a question, and the steps it should take."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("What is ", "Latest ", "Who ", "")]), (F.col("item_id") % 4 + 1).cast("int"))
    b = load(spark, sf_dir, "benchmark").select("item_id", F.lower(F.concat(lead, "text")).alias("q"), F.explode(F.array(F.lit("graph_lookup"), F.lit("web_search"))).alias("tool"))
    b = b.filter(~F.contains("q", F.lit("define")) & ~F.contains("q", F.lit("current")))
    return b.select("item_id", "tool", S.tool_score(F.col("q"), F.col("tool")).alias("score"), S.estimated_steps(F.col("item_id") % 8, F.col("item_id") % 5).alias("steps"))


@query("conversation_filter", "SELECT conv_id, count(*) AS turns, bool_or(role = 'system') AS has_system FROM conversations GROUP BY 1 HAVING count(*) >= 4")
def conversation_filter(spark, sf_dir):
    """D4."""
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("role") == "system").alias("has_system")).filter("turns >= 4")


@query("context_items", "SELECT conv_id, turn, left(text, 100) AS content, CASE role WHEN 'user' THEN 'graph' ELSE 'citation' END AS kind FROM conversations WHERE role IN ('user','assistant')")
def context_items(spark, sf_dir):
    """Steps and citations flattened to rows."""
    c = load(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return c.select("conv_id", "turn", F.substring("text", 1, 100).alias("content"), F.when(F.col("role") == "user", "graph").otherwise("citation").alias("kind"))


@query("preference_pairs", rf"""WITH {QA}, k AS (SELECT *, CASE WHEN right(md5(CAST(conv_id AS VARCHAR)), 1) IN ('0','2','4','6','8','a','c','e') THEN 'wrong_number' ELSE 'swap_words' END AS kind FROM qa)
SELECT conv_id, answer AS chosen, CASE kind WHEN 'wrong_number' THEN regexp_replace(answer, '\d', '7', 'g') ELSE regexp_replace(answer, '^(\S+) (\S+)', '\2 \1') END AS rejected, kind FROM k""")
def preference_pairs(spark, sf_dir):
    """Faithful and perturbed answers: years shifted, words swapped."""
    last = F.right(F.md5(F.col("conv_id").cast("string")), F.lit(1))
    kind = F.when(last.isin(*"02468ace"), "wrong_number").otherwise("swap_words")
    bad = F.when(kind == "wrong_number", F.regexp_replace("answer", r"\d", "7")).otherwise(F.regexp_replace("answer", r"^(\S+) (\S+)", "$2 $1"))
    return qa(spark, sf_dir).select("conv_id", F.col("answer").alias("chosen"), bad.alias("rejected"), kind.alias("kind"))

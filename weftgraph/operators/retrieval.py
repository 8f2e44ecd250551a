"""Batch retrieval over many questions at once.

Questions are rows; each pass adds ranked hits, passes are united in order of
precedence, and the first pass of an item wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords, print_step, words
from .graph import top_per_group, undirected


def containing(words: DataFrame, tokens: DataFrame, n: int = 3) -> DataFrame:
    """(word, token) of all distinct ``words`` (word) inside ``tokens`` (token): an
    equality join on a word's first ``n`` characters, which a token must have
    somewhere, before the words are looked for."""
    w = words.select("word", F.substring("word", 1, n).alias("gram")).filter("word <> ''").distinct()
    t = tokens.select("token").distinct()
    starts = F.sequence(F.lit(1), F.length("token"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("token"), i, F.lit(k)) for k in range(1, n + 1)]))))
    t = t.filter("token <> ''").select("token", F.explode(grams).alias("gram"))
    return w.join(t, "gram").filter(F.contains("token", "word")).select("word", "token").distinct()


def missing_pairs(texts: DataFrame, linked: DataFrame, longer: int = 4) -> DataFrame:
    """(a, b) with a < b, not in ``linked`` in either direction, where a word of
    more than ``longer`` characters of a's text occurs in b's. ``texts``: id, text."""
    tokens = texts.select("id", F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    mine = tokens.filter(F.length("token") > longer)
    met = containing(mine.select(F.col("token").alias("word")), tokens, longer + 1)
    pairs = mine.select(F.col("id").alias("a"), F.col("token").alias("word")).join(met, "word").select("a", "token").distinct().join(tokens.withColumnRenamed("id", "b"), "token")
    pairs = pairs.filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    known = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti")


def keyword_pass(questions: DataFrame, docs: DataFrame, most: int = 4, limit: int = 20) -> DataFrame:
    """Documents that contain a question's keywords: qid, doc_id, hits; the best
    ``limit`` of each question by hits, then id. Keywords have no white space, so a
    document holds one if one of its tokens does; tokens and keywords meet by equality."""
    kw = questions.select("qid", F.explode(F.slice(F.array_distinct(keywords(F.col("question"))), 1, most)).alias("kw")).filter("kw <> ''")
    tokens = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    met = containing(kw.select(F.col("kw").alias("word")), tokens)
    found = tokens.join(met, "token").select("doc_id", F.col("word").alias("kw")).distinct()
    hits = found.join(kw, "kw").groupBy("qid", "doc_id").agg(F.count("*").alias("hits"))
    return top_per_group(hits, ["qid"], [F.col("hits").desc(), F.col("doc_id")], limit)


def first_wins(passes: list[DataFrame], group: str, item: str, order: list[Column]) -> DataFrame:
    """Passes in order of precedence, each item of a group once."""
    named = [p.withColumn("pass", F.lit(i)) for i, p in enumerate(passes)]
    rows = reduce(DataFrame.unionByName, named)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group, item).orderBy("pass", *order))).filter("__n = 1").drop("__n")


def expand(hits: DataFrame, edges: DataFrame, hops: int = 1, limit: int = 30) -> DataFrame:
    """Neighbours of each question's hits (qid, node), up to
    ``hops`` steps; one step is the usual case."""
    near = undirected(edges).select("node", "other").distinct()
    seen = hits.select("qid", "node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        new = frontier.join(near, "node").select("qid", F.col("other").alias("node")).distinct().join(seen, ["qid", "node"], "left_anti").withColumn("hop", F.lit(h))
        frontier = top_per_group(new, ["qid"], [F.col("node")], limit)
        seen = seen.unionByName(frontier)
    return seen


def hybrid(vector_hits: DataFrame, graph_hits: DataFrame, keep: int = 15) -> DataFrame:
    """Vector hits first, then graph hits, each item once, ``keep`` per question."""
    rows = first_wins([vector_hits.select("qid", "node", "score"), graph_hits.select("qid", "node", F.lit(0.0).alias("score"))], "qid", "node", [F.col("score").desc()])
    return top_per_group(rows, ["qid"], [F.col("pass"), F.col("score").desc(), F.col("node")], keep)


def with_source(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The source of each chunk that a search returned."""
    return hits.join(chunks.select("chunk_id", "source_id", "source_url"), "chunk_id", "left")


def graph_lookup(entities: DataFrame, links: DataFrame, episodes: DataFrame, most_links: int = 15, most: int = 5) -> DataFrame:
    """An entity with its relations in both directions, its newest episodes and
    the first other members of its community, each cut to its limit and aggregated
    before its join. ``entities`` (id, ord, community), ``links`` (src, dst,
    rel_type), ``episodes`` (id, episode_id, at, ord)."""
    def joined(rows: DataFrame, col: str, order: str, out: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("c"))))
        return rows.groupBy("id").agg(F.array_join(F.transform(items, lambda x: x["c"]), ",").alias(out))

    out = links.select(F.col("src").alias("id"), F.concat("rel_type", F.lit(" -> "), "dst").alias("line"))
    back = links.select(F.col("dst").alias("id"), F.concat("rel_type", F.lit(" <- "), "src").alias("line"))
    lines = top_per_group(out.unionByName(back), ["id"], [F.col("line")], most_links)
    newest = Window.partitionBy("id").orderBy(F.col("at").desc(), "ord")
    recent = episodes.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= most)
    # One member more than wanted, as an entity may be among the first of its own community.
    first = entities.select("community", F.col("id").alias("other"), F.row_number().over(Window.partitionBy("community").orderBy("ord")).alias("n")).filter(F.col("n") <= most + 1)
    fellows = entities.select("id", "community").join(first, "community").filter(F.col("id") != F.col("other"))
    fellows = top_per_group(fellows, ["id"], [F.col("n")], most)
    got = entities.select("id").join(joined(lines, "line", "line", "relations"), "id", "left").join(joined(recent, "episode_id", "n", "episodes"), "id", "left").join(joined(fellows, "other", "n", "members"), "id", "left")
    return got.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("relations", "episodes", "members")])


def rerank(pairs: DataFrame, scorer=None) -> DataFrame:
    """(qid, doc_id, question, text) ordered by a scorer column, by default
    the sigmoid of the shared words; any ``(question, text) -> Column`` may stand in."""
    from ..functions.vectors import sigmoid

    def overlap(q: Column, t: Column) -> Column:
        return sigmoid(F.size(F.array_intersect(words(q), words(t))).cast("double") / 5 - 1)

    s = (scorer or overlap)(F.col("question"), F.col("text"))
    scored = pairs.withColumn("rerank_score", F.round(s, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "doc_id"))).drop("question", "text")


def compress(context: Column, passthrough: int = 500, most: int = 1000) -> Column:
    """Short texts pass, long ones are cut."""
    return F.when(F.length(context) < passthrough, context).otherwise(F.substring(context, 1, most))


def render_chat(turns: DataFrame, system: str) -> DataFrame:
    """F32: (conv_id, prompt) of user and assistant turns (conv_id, turn, role,
    text) in the chat template; assistant turns without text are left out."""
    said = turns.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("text") != "")))
    line = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>"))
    g = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    head = F.lit(f"<|im_start|>system\n{system}<|im_end|>")
    return g.select("conv_id", F.concat_ws("\n", head, F.transform("l", lambda x: x["line"])).alias("prompt"))


def print_traces(steps: DataFrame) -> DataFrame:
    """F32: (conv_id, trace) of steps (conv_id, turn, thought, action, action_input, observation)."""
    one = print_step(F.col("thought"), F.col("action"), F.col("action_input"), F.col("observation"))
    g = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("step")))).alias("l"))
    return g.select("conv_id", F.concat_ws("\n\n", F.transform("l", lambda x: x["step"]), F.lit("Thought: done\nFinal Answer: done")).alias("trace"))

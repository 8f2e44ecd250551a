"""Formula scores and metrics as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Phrases of a refusal and of a sure answer.
REJECTION = (
    "cannot answer", "unable to answer", "don't have enough information", "do not have enough information", "cannot find",
    "no information available", "unable to determine", "cannot determine", "not enough context", "insufficient information", "i don't know",
    "i cannot", "not available in", "no relevant information", "outside the scope", "beyond my knowledge", "unable to provide",
    "cannot provide", "no data found", "unable to locate",
)
CONFIDENCE = ("according to", "based on the information", "the answer is", "clearly shows", "evidence suggests", "data indicates", "confirms that")
# Stop words of the faithfulness, relevance and groundedness fallbacks.
STOP_FAITH = tuple(
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once here there when "
    "where why how all each few more most other some such no nor not only own same so than too very just and but if or because until while "
    "this that these those it".split()
)
STOP_RELEVANCE = ("the", "a", "an", "is", "are", "what", "who", "where", "when", "why", "how", "which", "?", ".", ",")
STOP_GROUND = ("the", "a", "an", "is", "are", "was", "were", "to", "of", "and", "in", "that", "it")
# Hosts that make a url suspicious, and reference sites.
SUSPICIOUS = ("bit.ly", "tinyurl", "goo.gl", "localhost", "127.0.0.1", "example.com", "test.com")
REFERENCE_SITES = ("wikipedia.org", "stackoverflow.com", "github.com", "docs.python.org", "docs.microsoft.com")
URL_FORM = (
    r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
)


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def count_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p)))


def without(ws: Column, stop: tuple[str, ...]) -> Column:
    return F.array_except(F.array_distinct(ws), F.array(*[F.lit(s) for s in stop]))


def article_rank(connectivity: Column, abstraction: Column, description: Column, url: Column) -> Column:
    """weighted connectivity, abstraction, description and url quality."""
    return (
        0.4 * F.least(connectivity / 100.0, F.lit(1.0)) + 0.3 * F.least(abstraction / 50.0, F.lit(1.0))
        + 0.2 * F.when(F.length(description) > 10, 1.0).otherwise(0.0) + 0.1 * F.when(F.contains(url, F.lit("wikipedia.org")), 1.0).otherwise(0.0)
    )


def perplexity_score(mean_logprob: Column) -> Column:
    """perplexity brought to [0, 1]."""
    return F.greatest(F.lit(0.0), 1 - F.exp(-mean_logprob) / 100.0)


def combined_confidence(perplexity: Column, entropy: Column, consistency: Column) -> Column:
    """weights .4, .3, .3 over the parts that are known."""
    parts = [(perplexity, 0.4), (1 - entropy, 0.3), (consistency, 0.3)]
    top = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * 0.4)
    low = sum((F.when(v.isNull(), 0.0).otherwise(w) for v, w in parts[1:]), F.when(parts[0][0].isNull(), 0.0).otherwise(0.4))
    return F.when(low > 0, top / low).otherwise(F.lit(0.5))


def sparse_importance(degree: Column) -> Column:
    """1 - degree / 3."""
    return 1 - degree / 3.0


def incomplete_importance(length: Column) -> Column:
    """.9 without a description, else .7 less a hundredth a character, .3 at least."""
    return F.when(length.isNull() | (length == 0), 0.9).otherwise(F.greatest(0.7 - length / 100.0, F.lit(0.3)))


def candidate_score(name: Column, mention: Column, context_hit: Column) -> Column:
    """exact 1, partial .5, .3 more with context, 1 at most."""
    low, m = F.lower(name), F.lower(mention)
    base = F.when(low == m, 1.0).when(F.contains(low, m) | F.contains(m, low), 0.5).otherwise(0.0)
    return F.least(base + F.when(context_hit, 0.3).otherwise(0.0), F.lit(1.0))


def efficiency(expected: Column, visited: Column) -> Column:
    """Share of visited entities that were expected."""
    return F.when(F.size(expected) == 0, 1.0).when(F.size(visited) == 0, 0.0).otherwise(F.size(F.array_intersect(expected, visited)) / F.size(F.array_distinct(visited)))


def loop_efficiency(minimum: Column, actual: Column, redundant: Column) -> Column:
    """Least over actual steps, capped at 1, less .1 per redundant step, 0 at least."""
    return F.greatest(F.lit(0.0), F.least(minimum / F.greatest(actual, F.lit(1)), F.lit(1.0)) - 0.1 * redundant)


def estimated_steps(entities: Column, relations: Column) -> Column:
    """Two steps, a third of the entities and half of the relations."""
    e = F.when(entities > 0, F.greatest(F.lit(1), F.floor(entities / 3))).otherwise(0)
    r = F.when(relations > 0, F.greatest(F.lit(1), F.floor(relations / 2))).otherwise(0)
    return F.lit(2) + e + r


def is_rejection(answer: Column, confidence: Column) -> Column:
    """Refusal by phrases and reported confidence."""
    low = F.lower(answer)
    n, sure = count_phrases(low, REJECTION), count_phrases(low, CONFIDENCE)
    by_phrase = (n >= 2) | ((n >= 1) & (confidence < 0.5))
    return F.when(confidence < 0.2, True).when((sure > 0) & (confidence > 0.7), False).otherwise(by_phrase)


def rejection_strength(answer: Column, confidence: Column) -> Column:
    n = count_phrases(F.lower(answer), REJECTION)
    s = F.least(n / 5.0, F.lit(1.0))
    return F.when(confidence < 0.2, F.greatest(s, F.lit(0.8))).otherwise(s)


def context_precision(retrieved: Column, truth: Column) -> Column:
    """E5: share of retrieved texts that contain or lie in a true one."""
    ok = F.filter(retrieved, lambda r: F.exists(truth, lambda t: F.contains(F.lower(r), F.lower(t)) | F.contains(F.lower(t), F.lower(r))))
    return F.when((F.size(retrieved) == 0) | (F.size(truth) == 0), 0.0).otherwise(F.size(ok) / F.size(retrieved))


def context_recall(retrieved: Column, truth: Column) -> Column:
    """E5: share of true texts found in the retrieved ones joined."""
    text = F.lower(F.array_join(retrieved, " "))
    ok = F.filter(truth, lambda t: F.contains(text, F.lower(t)))
    return F.when((F.size(retrieved) == 0) | (F.size(truth) == 0), 0.0).otherwise(F.size(ok) / F.size(truth))


def faithfulness(answer: Column, context: Column) -> Column:
    """Distinct content words of the answer that occur in the context."""
    content = without(words(answer), STOP_FAITH)
    low = F.lower(context)
    found = F.filter(content, lambda w: F.contains(low, w))
    return F.when((F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == ""), 0.0).otherwise(ratio(F.size(found), F.size(content), 0.5))


def relevance(question: Column, answer: Column) -> Column:
    """Question words that the answer repeats."""
    q, a = without(words(question), STOP_RELEVANCE), without(words(answer), STOP_RELEVANCE)
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).otherwise(ratio(F.size(F.array_intersect(q, a)), F.size(q), 0.5))


def trigram_recall(answer: Column, cited: Column) -> Column:
    """Three-word phrases of the answer that the cited text holds."""
    w = words(answer)
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))).otherwise(
        F.array().cast("array<string>"))
    low = F.lower(cited)
    return ratio(F.size(F.filter(grams, lambda g: F.contains(low, g))), F.size(grams), 0.0)


def claims(answer: Column) -> Column:
    """Sentences of more than ten characters."""
    parts = F.transform(F.split(F.translate(answer, "!?", ".."), r"\."), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 10)


def credibility(kind: Column, host: Column, credible: tuple[str, ...]) -> Column:
    """Graph 1, credible hosts .9, reference sites .8, unknown .5, none .3."""
    def any_of(hosts: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: F.contains(host, h)) if hosts else F.lit(False)

    return F.when(kind.isin("entity", "graph", "neo4j"), 1.0).when(F.coalesce(host, F.lit("")) == "", 0.3).when(any_of(credible), 0.9).when(any_of(REFERENCE_SITES), 0.8).otherwise(0.5)


def groundedness(answer: Column, context: Column) -> Column:
    """Word overlap scaled by 1.5."""
    a, c = without(words(answer), STOP_GROUND), without(words(context), STOP_GROUND)
    return F.when(F.size(a) == 0, 0.5).otherwise(F.least(F.lit(1.0), 1.5 * F.size(F.array_intersect(a, c)) / F.size(a)))


def fluency(answer: Column) -> Column:
    """Length, sentence length and repetition rules."""
    w = words(answer)
    n = F.size(w)
    dots = F.size(F.split(answer, r"\."))
    score = F.lit(0.8) - F.when(n / dots < 3, 0.2).otherwise(0.0) - F.when(F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1)) < 0.3, 0.2).otherwise(0.0)
    return F.when(n < 5, 0.3).when(n > 500, 0.7).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), score)))


def citation_status(exact: Column, similarity: Column, threshold: float = 0.75) -> Column:
    """Exact, supported, weak or hallucinated."""
    return F.when(exact, "verified").when(similarity >= threshold, "verified").when(similarity >= 0.5, "partial").otherwise("hallucinated")


def overlap_ratio(predicted: Column, gold: Column) -> Column:
    """Share of gold items that were predicted."""
    return ratio(F.size(F.array_intersect(predicted, gold)), F.size(F.array_distinct(gold)), 0.0)


def step_ladder(steps: Column, optimal: Column) -> Column:
    """1, .8, .5, .3 by steps over the optimum."""
    return F.when(steps <= optimal, 1.0).when(steps <= optimal + 2, 0.8).when(steps <= optimal + 4, 0.5).otherwise(0.3)


def tool_score(question: Column, tool: Column) -> Column:
    """How well a tool suits the question's wording."""
    q = F.lower(question)
    fresh = F.contains(q, F.lit("current")) | F.contains(q, F.lit("latest"))
    return (
        F.when(F.contains(q, F.lit("what is")) & (tool == "graph_lookup"), 0.9)
        .when(F.contains(q, F.lit("define")) & tool.isin("graph_lookup", "wiki_search"), 0.9)
        .when(fresh & (tool == "web_search"), 0.9).when(fresh & (tool == "graph_lookup"), 0.5)
        .when(F.contains(q, F.lit("who")) & (tool == "graph_lookup"), 0.8).otherwise(0.7)
    )


def update_action(mean_score: Column, warn: float = 0.7, rollback: float = 0.5) -> Column:
    """What to do with a batch of updates."""
    return F.when(mean_score < rollback, "rollback").when(mean_score < warn, "warn").otherwise("commit")


def compression_band(original: Column, compressed: Column) -> Column:
    """Whether the compressed text is a tenth to two fifths of the original."""
    r = compressed / F.greatest(original, F.lit(1))
    return (r >= 0.1) & (r <= 0.4)


def facts_found(answer: Column, facts: Column) -> Column:
    """Share of facts that the answer contains."""
    low = F.lower(answer)
    return ratio(F.size(F.filter(facts, lambda f: F.contains(low, F.lower(f)))), F.size(facts), 0.0)


def duplicate_penalty(n: Column, penalty: float = 0.2) -> Column:
    """D13."""
    return F.greatest(F.lit(0.0), 1 - n * penalty)


def url_validity(url: Column, host: Column) -> Column:
    """Empty, malformed, suspicious or valid."""
    bad = F.exists(F.array(*[F.lit(s) for s in SUSPICIOUS]), lambda s: F.contains(host, s))
    return F.when(F.coalesce(url, F.lit("")) == "", "empty").when(~url.rlike(URL_FORM), "invalid").when(bad, "suspicious").otherwise("valid")


def prompt_size(length: Column) -> Column:
    """Template by text length."""
    return F.when(length < 600, "short").when(length < 1500, "medium").otherwise("long")

"""Queries that SQL cannot express, against plain loops over the same tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions.splitters import split_text
from weftgraph.functions.text import DEFINITIONS, NAVIGATION, NOISE_PAGE
from weftgraph.operators import graph as G
from weftgraph.operators import vectors as V
from weftgraph.plans.catalogue import QUERIES
from weftgraph.sources.tables import edges
from weftgraph.streaming import events


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: QUERIES[name](spark, sf_dir).collect()


def cleaned(text):
    out = re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text))
    for n in NOISE_PAGE:
        out = re.sub("(?i)" + n, "", out)
    return out.strip()


def test_html_main(run, table):
    import html

    want = {}
    for r in table("pages"):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        pieces = [html.unescape(x).strip() for x in re.split(r"<[^>]*>", inner)]
        text = cleaned("\n".join(x for x in pieces if x))
        if len(text) >= 100:
            want[r["page_id"]] = text
    got = {r["page_id"]: r["content"] for r in run("html_main")}
    assert set(got) == set(want) and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_page_selectors():
    from weftgraph.sources.html import content

    page = '<div class="content">c</div><div class="main-content">m</div><div role="main">r</div><article>a</article>'
    assert content(page) == "a" and content(page.replace("article", "p")) == "r"
    assert content(page.replace("article", "p").replace(' role="main"', "")) == "m"
    assert content('<div class="article-content">x<nav>no</nav></div>y') == "x"


def sentence_cut(text, most):
    if len(text) <= most:
        return text
    kept = ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(kept) + len(s) + 1 > most:
            break
        kept += s + " "
    return kept.strip(" ") if kept.strip(" ") else text[:most] + "..."


def test_abstract_paragraph(run, table):
    want = {}
    for r in table("documents"):
        best = None
        for pos, para in enumerate((r["text"] or "").split("\n")):
            if len(para) < 50:
                continue
            low = para.lower()
            score = (5 if low.startswith(("the", "a the", "an the", "the the")) else 3) if "the" in low else 0
            score += sum(bool(re.search(p, low)) for p in DEFINITIONS) - 2 * any(x in low for x in NAVIGATION) + 0.5 * (100 <= len(para) <= 400)
            if best is None or score > best[0]:
                best = (score, pos, para)
        if best:
            want[r["doc_id"]] = (best[1], sentence_cut(best[2], 300))
    assert {r["doc_id"]: (r["pos"], r["abstract"]) for r in run("abstract_paragraph")} == want


def test_first_paragraphs(run, table):
    want = {}
    for r in table("documents"):
        text = re.sub("\n", "\n\n", r["text"]).strip(" ") if r["text"] is not None else None
        good = [p for p in (x.strip(" ") for x in re.split(r"\n\s*\n", text or "")) if len(p) >= 50 and p != p.upper() and not p.startswith("#")]
        want[r["doc_id"]] = sentence_cut(good[0], 300) if good else None
    assert {r["doc_id"]: r["paragraph"] for r in run("first_paragraphs")} == want


def test_semantic_chunks(run, table):
    want = {}
    for r in table("benchmark"):
        parts = re.split(r"(?<=[.!?])\s+", r["text"])
        sets = [set(re.split(r"\s+", p.lower().strip())) - {""} for p in parts]
        sims = [None] + [len(a & b) / len(a | b) if a | b else None for a, b in zip(sets, sets[1:])]
        known = [1 - s for s in sims if s is not None]
        cut = np.percentile(known, 85) if known else math.inf
        chunk, out = 0, defaultdict(list)
        for p, s in zip(parts, sims):
            chunk += s is not None and 1 - s > cut
            out[chunk].append(p)
        for c, ps in out.items():
            want[(r["item_id"], c)] = " ".join(ps)
    assert {(r["item_id"], r["chunk"]): r["content"] for r in run("semantic_chunks")} == want


def test_recursive_split_and_tree(run, table):
    want = {r["doc_id"]: split_text(r["text"] or "", 1000, 100) for r in table("documents")}
    got = defaultdict(dict)
    for r in run("recursive_split"):
        got[r["doc_id"]][r["chunk_index"]] = r["content"]
    assert {i: [c[k] for k in range(len(c))] for i, c in got.items()} == {i: c for i, c in want.items() if c}
    for r in table("documents"):
        pieces, text = want[r["doc_id"]], r["text"] or ""
        assert all(len(p) <= 1000 and p in text for p in pieces)
        # No word is lost, whatever neighbours share (separators take a full stop away).
        bare = lambda t: Counter(w.rstrip(".") for w in t.split() if w.strip("."))
        assert not bare(text) - bare(" ".join(pieces))
    levels = defaultdict(list)
    tree = run("raptor_tree")
    ids = {r["id"]: r for r in tree}
    for r in tree:
        levels[(r["doc_id"], r["level"])].append(r)
        assert (r["parent"] is None) == (r["level"] == 0)
        assert r["parent"] is None or (ids[r["parent"]]["level"] == r["level"] - 1 and ids[r["parent"]]["doc_id"] == r["doc_id"])
    for i, c in want.items():
        if c:
            assert [len(levels[(i, k)]) for k in (2, 1, 0)] == [len(c), -(-len(c) // 3), 1]


def unit(rows):
    m = np.array([r["embedding"] for r in rows], dtype=float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_greedy_dedup(run, table):
    rows = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    m, leaders, want = unit(rows), defaultdict(list), {}
    for i, r in enumerate(rows):
        hit = next((j for j in leaders[r["label"]] if m[j] @ m[i] >= 0.3), None)
        if hit is None:
            leaders[r["label"]].append(i)
            hit = i
        want[r["vec_id"]] = rows[hit]["vec_id"]
    assert {r["vec_id"]: r["leader"] for r in run("greedy_dedup")} == want


def test_kmeans_assigns_to_the_nearest_mean(run, table):
    rows = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    m = np.array([r["embedding"] for r in rows], dtype=float)
    of = {r["vec_id"]: r["cluster"] for r in run("kmeans_chunks")}
    label = np.array([of[r["vec_id"]] for r in rows])
    assert len(of) == len(rows) and 2 <= len(set(label)) <= 8
    means = {c: m[label == c].mean(0) for c in set(label)}
    inside = sum(((m[label == c] - v) ** 2).sum() for c, v in means.items())
    best = sum(min(((x - v) ** 2).sum() for v in means.values()) for x in m)
    assert inside <= 1.1 * best and inside < ((m - m.mean(0)) ** 2).sum()


def test_hashed_embeddings(spark, run, table):
    got = {r["doc_id"]: np.array(r["embedding"]) for r in run("hashed_embeddings")}
    docs = table("documents")
    assert set(got) == {r["doc_id"] for r in docs}
    by_words = defaultdict(list)
    for r in docs:
        words = [w for w in re.split(r"\s+", (r["text"] or "").lower()) if w]
        assert abs(np.linalg.norm(got[r["doc_id"]]) - (1 if words else 0)) < 1e-9
        by_words[tuple(sorted(Counter(words).items()))].append(got[r["doc_id"]])
    # Equal bags of words have equal vectors, and a vector adds up its words'.
    assert all(np.array_equal(v[0], x) for v in by_words.values() for x in v[1:])
    df = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "alpha beta"), (3, None)], "doc_id long, text string")
    v = {r["doc_id"]: np.array(r["embedding"]) for r in V.hashed_embedding(df, "doc_id", "text", 32).collect()}
    s = v[0] + v[1]
    assert np.allclose(v[2], s / np.linalg.norm(s)) and not v[3].any()


def test_bfs_capped(spark, sf_dir, run):
    near = defaultdict(set)
    for r in edges(spark, sf_dir, ["LIVES_IN", "IN_REGION", "BASED_IN"]).collect():
        near[r["src"]].add(r["dst"])
        near[r["dst"]].add(r["src"])
    level = {"region:0": 0}
    frontier = ["region:0"]
    for k in (1, 2, 3):
        frontier = sorted({x for n in frontier for x in near[n]} - set(level))[:50]
        level |= {n: k for n in frontier}
    assert {r["node"]: r["level"] for r in run("bfs_capped")} == level


def modularity(pairs, of):
    m2 = 2 * sum(w for _, _, w in pairs)
    inside, strength = defaultdict(float), defaultdict(float)
    for u, v, w in pairs:
        strength[of[u]] += w
        strength[of[v]] += w
        if of[u] == of[v]:
            inside[of[u]] += 2 * w
    return sum(inside[c] / m2 - (strength[c] / m2) ** 2 for c in strength)


def test_louvain(spark):
    ring = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcd" for i in range(6) for j in range(i)]
    ring += [("a0", "b1", 0.5), ("b0", "c1", 0.5), ("c0", "d1", 0.5), ("d0", "a1", 0.5)]
    pairs = [(min(u, v), max(u, v), w) for u, v, w in ring]
    df = spark.createDataFrame(pairs, "u string, v string, weight double")
    of = {r["id"]: r["community"] for r in G.louvain(df).collect()}
    assert len(set(of.values())) == 4 and all(len({of[f"{c}{i}"] for i in range(6)}) == 1 for c in "abcd")
    lpa = {r["id"]: r["community"] for r in G.label_propagation(df).collect()}
    assert modularity(pairs, of) >= modularity(pairs, lpa) - 1e-9
    q = G.modularity(df, spark.createDataFrame(list(of.items()), "id string, community string")).first()["modularity"]
    assert abs(q - modularity(pairs, of)) < 1e-9
    assert G.of_size(spark.createDataFrame([("x", "c"), ("y", "c"), ("z", "d")], "id string, community string"), 2).count() == 2


def test_found_communities(spark, sf_dir, run):
    from weftgraph.plans.graph_queries import _entity_pairs

    pairs = [tuple(r) for r in _entity_pairs(spark, sf_dir).select("u", "v", "weight").collect()]
    strength = defaultdict(float)
    for u, v, w in pairs:
        strength[u] += w
        strength[v] += w
    rows = run("communities_lpa")
    assert sum(r["members"] for r in rows) == len(strength) and len({r["community"] for r in rows}) == len(rows)
    for r in rows:
        shown = r["representatives"].split(",")
        assert len(shown) == min(5, r["members"]) and [(-strength[i], i) for i in shown] == sorted((-strength[i], i) for i in shown)
    found = {r["id"]: r["community"] for r in run("communities_louvain")}
    sizes = Counter(found.values())
    assert set(found) <= set(strength) and (not sizes or min(sizes.values()) >= 3)


def test_stream_dedupe(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:10:00"), (2, "2026-01-01 00:20:00")]
    spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.dedupe(stream).writeStream.format("memory").queryName("deduped").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.table("deduped").collect()) == [1, 2]

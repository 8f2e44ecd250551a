"""Operators over the corpus: mixing, sharding, images, quality, near duplicates."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decision_list, hilbert, image_match, ngram_join, pfair, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, comp long"


def frame(spark, rows):
    """rows: (id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, 0) for i, t, s in rows], SCHEMA)


# mixing


def slow_edf(weights, slots):
    """Slot by slot: the released block of the earliest deadline."""
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        open_ = [(-(-(done[i] + 1) * total // a), i) for i, a in enumerate(weights) if done[i] * total // a <= t]
        i = min(open_)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 2, 1], [7, 1, 1, 1], [50, 30, 13, 7], [1] * 9 + [90]])
def test_one_period_is_fair(weights):
    period = sum(weights)
    slots = pfair.one_period(weights)
    assert slots + slots == slow_edf(weights, 2 * period)
    done = [0] * len(weights)
    for t, i in enumerate(slots, 1):
        done[i] += 1
        assert all(abs(d - t * a / period) < 1 for d, a in zip(done, weights))
    assert done == weights


def test_schedule_blocks_and_slots(spark):
    rows = [(i, "x" * (i % 50), f"s{i % 3}") for i in range(300)] + [(5, "dup", "s1"), (5, "dup", "s1"), (None, None, None), (7, "y" * 5000, "s2")]
    weights = {"s0": 5, "s1": 3, "s2": 1, None: 1}
    got = pfair.schedule(frame(spark, rows), weights, block_bytes=200).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    order = sorted(weights, key=lambda s: (s is not None, s))
    place = slow_edf([weights[s] for s in order], 3000)
    nth = {s: [t for t, i in enumerate(place) if order[i] == s] for s in order}
    for s in order:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["before"])
        at = 0
        for r in mine:
            assert r["before"] == at and r["block"] == at // 200 and r["slot"] == nth[s][r["block"]]
            at += r["size"]
    assert pfair.schedule(frame(spark, [])).count() == 0


def test_mix_keeps_every_row_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("slot", F.lit("clash")).withColumn("before", F.lit(1))
    out = pfair.mix(docs, block_bytes=3000, part_bytes=20_000)
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0 and out.count() == docs.count()
    assert out.rdd.getNumPartitions() > 5
    place = {r["doc_id"]: (r["slot"], r["before"]) for r in pfair.schedule(docs, block_bytes=3000).collect()}
    mixed = [place[r["doc_id"]] for r in out.collect()]
    assert mixed == sorted(mixed)


def test_mix_moves_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = pfair.mix(docs, block_bytes=3000, part_bytes=20_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Sort [" in plan
    physical = pfair.mix(docs, block_bytes=3000, part_bytes=20_000)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") - physical.count("BroadcastExchange ") == 1, physical


def test_mix_edge_cases(spark):
    rows = [(i, "x" * (i % 50), f"s{i % 3}") for i in range(60)] + [(5, "dup", "s1")] * 40 + [(None, None, None), (None, "", None), (7, "y" * 5000, "s2")] + [(9, f"t{i}", "s0") for i in range(60)]
    df = frame(spark, rows)
    out = pfair.mix(df, {"s0": 5, "s1": 3, "s2": 1, None: 1}, block_bytes=200, part_bytes=1000).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter(rows)
    assert pfair.mix(frame(spark, [])).count() == 0


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        pfair.schedule(frame(spark, [(1, "a", "s")]), {"t": 1})
    with pytest.raises(ValueError):
        pfair.schedule(frame(spark, [(1, "a", "s")]), {"s": 0})


# sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    n = 1 << bits
    cells = spark.range(n**dims).select(*[(F.floor(F.col("id") / n**i) % n).cast("long").alias(f"d{i}") for i in range(dims)])
    rows = hilbert.hilbert_index(cells, [f"d{i}" for i in range(dims)], bits, "h").orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(n**dims))
    assert all(sum(abs(a[f"d{i}"] - b[f"d{i}"]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 1, 39, 41, 200])
def test_shards_hold_equal_counts(spark, n):
    rows = [(i // 2 if i else None, None if i % 7 == 0 else "é" * (i % 90), "hot" if i % 3 else f"s{i}") for i in range(n)]
    got = hilbert.shard(frame(spark, rows)).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert not n or max(map(len, by.values())) - (min(map(len, by.values())) if n >= 40 else 0) <= 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1 if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows) or any(i == 0 for i, _, _ in rows)


def test_shards_prune(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    got = hilbert.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=10).join(docs, "doc_id")
    per = got.groupBy("shard").agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("s")).collect()
    assert np.mean([r["l"] for r in per]) < 3 and np.mean([r["s"] for r in per]) < 14


# images


def drawn(v):
    return image_match.to_pgm(image_match.render(np.array([v], dtype=np.float32))[0])


def described(pgm):
    p, b = image_match.describe(image_match.from_pgm(pgm))
    return p.astype("<f4").astype(float), b.view("<u8")


def agrees(query, image):
    """Whether two images agree by all of their corners, compared pair by pair."""
    (p, b), (q, c) = query, image
    x, y = np.nonzero([[sum(int(s ^ t).bit_count() for s, t in zip(e, f)) <= image_match.MAX_BITS for f in c.tolist()] for e in b.tolist()]) if len(b) and len(c) else ([], [])
    if not len(x):
        return False
    m = np.concatenate([p[x], q[y]], 1)
    best = 0
    for a in m:
        s, t = a[6] / a[2], a[7] - a[3]
        rot = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) * s
        off = np.hypot(*(m[:, 4:6] - (a[4:6] + (m[:, :2] - a[:2]) @ rot.T)).T)
        turn = np.abs((m[:, 7] - m[:, 3] - t + np.pi) % (2 * np.pi) - np.pi)
        ok = (off < 5.0) & (turn < 0.4) & (np.abs(np.log(m[:, 6] / m[:, 2] / s)) < 0.3)
        best = max(best, len({tuple(np.rint(k)) for k in m[ok, :2]}))
    return best >= image_match.MIN_INLIERS


def turned(image, angle):
    """Turned about the middle, edges repeated."""
    y, x = np.mgrid[: image.shape[0], : image.shape[1]] - (image.shape[0] - 1) / 2
    a = np.rint(np.cos(angle) * y - np.sin(angle) * x + (image.shape[0] - 1) / 2).astype(int).clip(0, image.shape[0] - 1)
    b = np.rint(np.sin(angle) * y + np.cos(angle) * x + (image.shape[1] - 1) / 2).astype(int).clip(0, image.shape[1] - 1)
    return image[a, b]


def test_distorted_copies_against_brute_force(spark):
    rng = np.random.default_rng(12)
    images = [image_match.from_pgm(drawn(rng.normal(size=64))) for _ in range(30)]
    asked = []
    for im in images[:8]:
        asked += [image_match._resize(im, 1.08), image_match._resize(im, 0.9), turned(im, 0.12), im + rng.normal(0, 6, im.shape), image_match._box(im, 1), im[10:90, 5:80]]
    pgm = [[(i, bytearray(image_match.to_pgm(m))) for i, m in enumerate(ms)] for ms in (asked, images)]
    q, d = (spark.createDataFrame(rows, "id long, media binary") for rows in pgm)
    (qs, ds) = ([described(bytes(m)) for _, m in rows] for rows in pgm)
    want = {(i, j) for i, query in enumerate(qs) for j, image in enumerate(ds) if agrees(query, image)}
    found, near = image_match.match(q, d, "id", "media")
    got = expanded([(x["query"], x["near"]) for x in found.collect()], {x["image"]: x["near"] for x in near.collect()}, range(30))
    assert len(got & want) >= 0.9 * len(want) and not near.count() and got <= want
    assert len({(i, i // 6) for i in range(len(asked))} & want) >= 0.75 * len(asked)


def expanded(matches, classes, images):
    """All pairs that rows of (query, class) and the classes stand for."""
    of = {}
    for i in images:
        of.setdefault(classes.get(i, i), []).append(i)
    return {(q, i) for q, c in matches for i in of[c]}


def test_all_copies_of_all_queries(spark, sf_dir):
    # Near vectors as well: noisy ones of every fifth query and a group of 60, whose images are near copies.
    rng = np.random.default_rng(3)
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    asked = [i for i in vectors if i % 20 == 0]
    near = {100_001 + 20 * i: asked[-5 * i - 1] for i in range(len(asked) // 5)} | {200_001 + 20 * i: asked[0] for i in range(60)}
    for i, j in near.items():
        vectors[i] = (np.array(vectors[j]) + rng.normal(0, 0.01, len(vectors[j]))).tolist()
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    media = {i: drawn(v) for i, v in vectors.items()}
    found = {i: described(m) for i, m in media.items()}
    want = set()
    for i in asked:
        query = described(image_match.to_pgm(image_match.edit(image_match.from_pgm(media[i]), zlib.crc32(media[i]))))
        want |= {(i, j) for j, image in found.items() if agrees(query, image)}
    rows = image_match.copies(df).collect()
    classes = {r["vec_id"]: r["class_id"] for r in rows if r["kind"] == "member"}
    matches = [(r["vec_id"], r["class_id"]) for r in rows if r["kind"] == "match"]
    assert set(classes) == set(vectors) and {(r["vec_id"], r["match_id"]) for r in rows if r["kind"] == "match"} <= want
    got = expanded(matches, classes, vectors)
    assert len(got & want) >= 0.9 * len(want) and len({(i, i) for i in asked} & got) >= 0.8 * len(asked)
    # Classes hold copies of one image only, and the large group is one row for its query.
    assert all(near.get(i, i) == near.get(c, c) for i, c in classes.items())
    assert len(matches) <= 2 * len(asked)


def test_copies_edge_cases(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=64).tolist(), rng.normal(size=64).tolist()
    rows = [(0, a, 1), (20, a, 1), (21, a, 1), (40, b, 1), (41, None, 1), (60, None, 1), (80, [0.0] * 64, 1), (81, [0.0] * 64, 1), (None, a, 1), (100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, image long")
    rows = image_match.copies(df.withColumn("id", F.lit(7)).withColumn("mark", F.lit("clash"))).collect()
    got = {(r["vec_id"], r["class_id"]) for r in rows if r["kind"] == "match"}
    assert {(0, 0), (20, 0), (40, 40)} <= got and all(q not in (60, 80, 100) for q, _ in got)
    # Flat and empty drawings are classes of equal content; null vectors and ids have no image to name.
    assert sorted((r["vec_id"], r["class_id"]) for r in rows if r["kind"] == "member") == [(0, 0), (20, 0), (21, 0), (40, 40), (80, 80), (81, 80), (100, 80)]
    assert image_match.copies(df.limit(0)).count() == 0
    assert image_match.from_pgm(b"P5\n3 3\n255\n12") is None and image_match.from_pgm(None) is None and image_match.from_pgm(b"") is None


# quality


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


AWKWARD = [None, "", " \n ", "a", "a b c d e a b c d e", "x " * 40, "a\na\n a\n\nb\x0bb\ta", "é😀 ü ü #*$%&|<>", "w " * 20000, "A\r\nA\r\n"]


def test_stats_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for df in (docs, frame(spark, [(i, t, "s") for i, t in enumerate(AWKWARD)])):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in decision_list.judge(df, labels).collect():
            want = slow_stats(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def test_rules_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)) == 0
    held = decision_list.judge(docs, labels.filter(half)).join(labels.filter(~half), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_covering_learns_a_conjunction():
    rng = np.random.default_rng(2)
    x = {"u": rng.random(3000), "v": rng.random(3000)}
    bad = (x["u"] > 0.8) & (x["v"] < 0.3)
    rules = decision_list.learn(x, bad, np.arange(3000) % 3 == 0)
    hit = np.zeros(3000, dtype=bool)
    for r in rules:
        hit |= decision_list.covers(r, x)
    assert (hit & bad).sum() >= 0.8 * bad.sum() and (hit & ~bad).sum() <= 0.05 * bad.sum()


def test_quality_edge_cases(spark):
    df = frame(spark, [(1, "one two three four five six seven eight nine ten", "s"), (1, "one two three four five six seven eight nine ten", "s"), (None, "word " * 50, "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    got = sorted((r["doc_id"] or 0, r["kept"]) for r in decision_list.judge(df, none).collect())
    assert got == [(0, False), (1, True), (1, True), (2, False)]
    kept = decision_list.keep_good(df, none)
    assert kept.columns == df.columns and kept.count() == 2
    assert decision_list.judge(df.limit(0), none).count() == 0 and decision_list.keep_good(df.limit(0), none).count() == 0


# near duplicates


def shingles(text, words=4):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def slow_components(rows, words=4, num=85, den=100):
    """Least id of each row's component, all pairs compared."""
    sets = [shingles(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def variants(seed, n, length, edits):
    """A text and near copies of it with a few words changed, in a chain and around it."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
    out, last = [" ".join(base)], base
    for k in range(n):
        last = list(last if k % 3 == 0 else base)
        for p in rng.integers(0, length, rng.integers(0, edits + 1)):
            last[p] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(last))
    return out


def test_components_against_brute_force(spark):
    texts = variants(1, 40, 120, 3) + variants(2, 25, 60, 3) + variants(3, 12, 9, 1) + [None, "", "a", "A", "a b", "a b c d", "A B C  D", "a b c d e"]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{k}_{i}" for i in range(20 + 3 * k)) for k in range(20)]
    rows = [(i * 7 % 1009 if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, texts[5]), (3, texts[5])]
    df = frame(spark, [(i, t, "s") for i, t in rows])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, sketch_bits=10).collect())
    assert got == Counter(slow_components(rows))


def test_pairwise_phase_is_exact(spark):
    texts = variants(4, 60, 150, 5)
    rows = list(enumerate(texts))
    df = frame(spark, [(i, t, "s") for i, t in rows])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, sketch_bits=4, rounds=1).collect())
    assert got == Counter(slow_components(rows))


def test_long_chain_is_one_component(spark):
    ids = np.random.default_rng(1).permutation(1000).tolist()
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (2001, 2000)], "a long, b long")
    got = {r["uid"]: r["comp"] for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in ids} | {2000: 2000, 2001: 2000}


def test_bitmap_bound_never_cuts():
    rng = np.random.default_rng(9)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 700, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 600), replace=False)) for _ in range(2))
        bound = ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b))
        assert bound >= len(np.intersect1d(a, b))


def test_keep_one_per_component(spark):
    texts = variants(6, 20, 80, 2) + [None, "", "x y", "totally different words are here and there for once"]
    rows = [(i // 2 if i > 18 else i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (50, texts[0])]
    df = frame(spark, [(i, t, "s") for i, t in rows])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    sets = [shingles(r["text"], 5) for r in kept.collect()]
    full = [s for s in sets if s]
    for i in range(len(full)):
        for j in range(i):
            inter = len(full[i] & full[j])
            assert 100 * inter < 80 * (len(full[i]) + len(full[j]) - inter)
    comps = slow_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80, 100)
    assert len(sets) == len({c for _, n, c in comps if n}) + sum(n == 0 for _, n, c in comps)
    assert ngram_join.keep_one(df.limit(0)).count() == 0

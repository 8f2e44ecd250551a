"""The corpus pipeline and the SQL twins of the operator queries."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from weftgraph.llm import queries

from .test_corpus import shingles, slow_stats
from .test_records import plain_scan


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        docs = out.cache()
        kept[name] = docs.collect()
    good = kept["quality rules"]
    for r in good:
        n, _, _, _, rep = slow_stats(r["text"])
        assert n >= 10 and 100 * rep <= 20 * n
    sets = [shingles(r["text"], 5) for r in kept["n-gram join"]]
    assert len(sets) <= len(good)
    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            assert 100 * inter < 80 * (len(sets[i]) + len(sets[j]) - inter)
    # Every document that went is linked with one that stayed, directly or through others.
    assert {r["doc_id"] for r in kept["n-gram join"]} <= {r["doc_id"] for r in good}
    assert len(kept["secret scan"]) == len(kept["n-gram join"]) and not any(plain_scan(r["text"]) for r in kept["secret scan"])
    assert Counter(kept["mixing"]) == Counter(kept["secret scan"])
    assert {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["mixing"]}


def test_packing_follows_the_schedule(spark, tmp_path):
    sizes = [3, 40, 8, 120, 60]  # rows of each file, in the order of the schedule
    rows = [(f * 1000 + i, f"w{f} " * 90) for f, n in enumerate(sizes) for i in range(n)]
    sc = spark.sparkContext
    df = spark.createDataFrame(sc.union([sc.parallelize([r for r in rows if r[0] // 1000 == f], 1) for f in range(len(sizes))]), "doc_id long, text string")
    with_sizes = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.enabled": "false"}
    for k, v in with_sizes.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(str(tmp_path / "mixed"))
        packed = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    finally:
        for k in with_sizes:
            spark.conf.unset(k)
    by_file = [{r["sequence_id"] for r in packed if r["doc_id"] // 1000 == f} for f in range(len(sizes))]
    assert all(by_file) and all(max(a) < min(b) for a, b in zip(by_file, by_file[1:]))
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows}
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    run = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in run.description].index(c) for c in cols]
    want = Counter(tuple(r[i] for i in at) for r in run.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == want

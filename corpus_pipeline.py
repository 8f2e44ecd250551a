"""The corpus pipeline: quality rules, near-duplicate removal, secret masking,
mixing and packing, each stage over all that the stage before it kept.

Null and empty texts have no words, so the quality rules reject them. Repeated
rows, rows of one id, and groups of near copies leave one row each behind the
n-gram join (an id that occurs with unlike texts keeps each of them). Very long
texts pass every stage whole. Null ids, sources and languages are values like any
other; ties are settled as the operators say; columns besides those the operators
read are carried along, whatever their names, up to packing, which gives pieces
only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decision_list, kk_packing, ngram_join, pfair, secret_scan
from weftgraph.llm.common import drop_scratch, materialize, read_table, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return decision_list.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 5-word shingles at 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixing schedule."""
    return pfair.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, numbered in the order of the schedule."""
    return kk_packing.pack(docs, by_file=kk_packing.in_files(docs))


STAGES = [
    ("quality rules", quality),
    ("n-gram join", near_duplicates),
    ("secret scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenizing and learned rules are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        # What a stage made for itself goes when its rows are written, its input with it.
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
        if before is not None:
            drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

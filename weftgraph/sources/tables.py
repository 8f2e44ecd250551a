"""Parquet tables and the property-graph views over them (S1, §1.5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str | Column) -> Column:
    """Graph-wide node id: ``kind:key``."""
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


#: relation -> (table, source kind, source key, target kind, target key)
RELATIONS = {
    "IN_REGION": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    "LIVES_IN": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "BASED_IN": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "PLACED_BY": ("orders", "orders", "o_orderkey", "customer", "o_custkey"),
    "CONTAINS": ("lineitem", "orders", "l_orderkey", "part", "l_partkey"),
    "SUPPLIED_BY": ("lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
}


def edges(spark: SparkSession, sf_dir: str, relations: list[str] | None = None, touching: list[str] | None = None) -> DataFrame:
    """(src, dst, rel_type) of the typed graph; repeated rows of a relation are kept.

    ``touching`` keeps the edges of some node ids: as conditions on the key columns
    they reach the Parquet scan, and relations of other kinds of nodes are not read.
    """
    keys: dict[str, list[int]] = {}
    for node in touching or ():
        kind, _, key = node.partition(":")
        if key.lstrip("-").isdigit():
            keys.setdefault(kind, []).append(int(key))
    parts = []
    for rel in relations or list(RELATIONS):
        table, a, ka, b, kb = RELATIONS[rel]
        rows = load(spark, sf_dir, table)
        if touching is not None:
            near = [F.col(k).isin(keys[kind]) for kind, k in ((a, ka), (b, kb)) if kind in keys]
            rows = rows.filter(reduce(Column.__or__, near, F.lit(False)))
        parts.append(rows.select(node_id(a, ka).alias("src"), node_id(b, kb).alias("dst"), F.lit(rel).alias("rel_type")))
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name) of the typed graph."""
    spec = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"),
            ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    parts = [load(spark, sf_dir, t).select(node_id(t, k).alias("id"), F.lit(t).alias("label"), F.col(n).alias("name")) for t, k, n in spec]
    return reduce(DataFrame.unionByName, parts)


#: The same edges as SQL, for the oracles.
EDGES_SQL = """edges AS (
  SELECT 'nation:'||n_nationkey AS src, 'region:'||n_regionkey AS dst, 'IN_REGION' AS rel_type FROM nation
  UNION ALL SELECT 'customer:'||c_custkey, 'nation:'||c_nationkey, 'LIVES_IN' FROM customer
  UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'BASED_IN' FROM supplier
  UNION ALL SELECT 'orders:'||o_orderkey, 'customer:'||o_custkey, 'PLACED_BY' FROM orders
  UNION ALL SELECT 'orders:'||l_orderkey, 'part:'||l_partkey, 'CONTAINS' FROM lineitem
  UNION ALL SELECT 'part:'||l_partkey, 'supplier:'||l_suppkey, 'SUPPLIED_BY' FROM lineitem)"""

NODES_SQL = """nodes AS (
  SELECT 'region:'||r_regionkey AS id, 'region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'nation:'||n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:'||c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:'||s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part:'||p_partkey, 'part', p_name FROM part)"""

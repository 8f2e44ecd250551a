"""Batch twins of the streaming operators and the config sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import config as C
from ..sources.tables import load
from ..streaming import events as E
from .registry import query


@query("window_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_counts(spark, sf_dir):
    """Tumbling windows; the stream gives the same rows."""
    return E.windowed(load(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("session_counts", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    """Session windows per user."""
    return E.sessions(load(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("maintenance_points", "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 600) AS BIGINT) AS batch FROM events")
def maintenance_points(spark, sf_dir):
    """Count-triggered work."""
    return E.maintenance_points(load(spark, sf_dir, "events"))


@query("stable_versions", """WITH v AS (SELECT event_type AS category, CAST(date_part('day', ts) AS INT) AS version, count(DISTINCT user_id) // 40 AS labels FROM events GROUP BY 1, 2),
g AS (SELECT *, sum(c) OVER (PARTITION BY category ORDER BY version) AS grp FROM (SELECT *, CASE WHEN labels = lag(labels) OVER (PARTITION BY category ORDER BY version) THEN 0 ELSE 1 END AS c FROM v)),
n AS (SELECT *, row_number() OVER (PARTITION BY category, grp ORDER BY version) AS n FROM g) SELECT category, min(version) AS stable_at FROM n WHERE n = 4 GROUP BY 1""")
def stable_versions(spark, sf_dir):
    """When a category's labels stopped changing."""
    v = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category"), F.dayofmonth("ts").alias("version")).agg(F.floor(F.countDistinct("user_id") / 40).alias("labels"))
    return E.stable_since(v, 3)


@query("trust_defaults", "SELECT category, count(*) AS n FROM (VALUES " + ", ".join(f"('{level}', '{category}')" for _, _, level, category in C.TRUSTED) + ") t(level, category) WHERE level IN ('medium', 'high') GROUP BY 1")
def trust_defaults(spark, sf_dir):
    """Default sources of medium trust or better by category."""
    return C.trust_export(C.trust_at_least(C.trust_table(spark), "medium")).select("category", F.size("sources").alias("n"))


@query("corpus_slice", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20 OFFSET 50")
def corpus_slice(spark, sf_dir):
    """S3."""
    return C.corpus_slice(load(spark, sf_dir, "documents"), F.col("doc_id"), 50, 20).select("doc_id", "source")

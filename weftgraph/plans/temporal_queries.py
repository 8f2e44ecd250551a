"""Bi-temporal, versioning and timeline queries; events stand for episodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import temporal as T
from ..sources.tables import load
from .registry import query

FACTS = """facts AS (SELECT event_id AS entity_id, 'user '||user_id AS name, event_type AS ontology_type, ts AS valid_from,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, ts AS created_at,
  CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 5 DAY END AS obsoleted_at,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'obsolete' ELSE 'active' END AS fact_status, value AS confidence FROM events)"""
MID = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"
T0, T1 = "TIMESTAMP '2024-01-12 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"


def facts(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("entity_id"), F.concat(F.lit("user "), F.col("user_id")).alias("name"), F.col("event_type").alias("ontology_type"),
        F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 5 DAY")).alias("obsoleted_at"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, "obsolete").otherwise("active").alias("fact_status"),
        F.col("value").alias("confidence"))


def at(t: str):
    return F.expr(t.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


COVER = "(valid_from IS NULL OR valid_from <= {t}) AND (valid_to IS NULL OR valid_to > {t})"
KNOWN = "created_at <= {t} AND (obsoleted_at IS NULL OR obsoleted_at > {t})"


@query("valid_at", f"WITH {FACTS} SELECT entity_id, name FROM facts WHERE {COVER.format(t=T0)} AND fact_status = 'active'")
def valid_at(spark, sf_dir):
    """T1, P4 (strict)."""
    return T.valid_at(facts(spark, sf_dir), at(T0)).select("entity_id", "name")


@query("valid_tolerant", f"WITH {FACTS} SELECT entity_id FROM facts WHERE {COVER.format(t=T0)} AND coalesce(fact_status,'active') = 'active'")
def valid_tolerant(spark, sf_dir):
    """P4 (tolerant)."""
    return facts(spark, sf_dir).filter(T.covers(at(T0)) & (F.coalesce("fact_status", F.lit("active")) == "active")).select("entity_id")


@query("valid_range", f"WITH {FACTS} SELECT entity_id FROM facts WHERE (valid_from IS NULL OR valid_from <= {T1}) AND (valid_to IS NULL OR valid_to >= {T0})")
def valid_range(spark, sf_dir):
    """T2."""
    return T.in_range(facts(spark, sf_dir), at(T0), at(T1)).select("entity_id")


@query("known_at", f"WITH {FACTS} SELECT entity_id FROM facts WHERE {KNOWN.format(t=T1)}")
def known_at(spark, sf_dir):
    """T4."""
    return T.facts_known_at(facts(spark, sf_dir), at(T1)).select("entity_id")


@query("bitemporal", f"WITH {FACTS} SELECT entity_id FROM facts WHERE {COVER.format(t=T0)} AND {KNOWN.format(t=T1)}")
def bitemporal(spark, sf_dir):
    """T5."""
    return T.bitemporal(facts(spark, sf_dir), at(T0), at(T1)).select("entity_id")


@query("timeline", "SELECT event_id AS episode_id, ts AS reference_time FROM events WHERE user_id = 3 ORDER BY ts, event_id LIMIT 20")
def timeline(spark, sf_dir):
    """T3, J22."""
    e = load(spark, sf_dir, "events")
    ep = e.select(F.col("event_id").alias("episode_id"), F.col("ts").alias("reference_time"))
    con = e.select(F.col("event_id").alias("episode_id"), F.col("user_id").cast("string").alias("entity_id"))
    return T.timeline(ep, con, "3", limit=20)


@query("episodes_in_range", f"SELECT event_id AS episode_id, ts AS reference_time FROM events WHERE ts BETWEEN {T0} AND {T1}")
def episodes_in_range(spark, sf_dir):
    """T8."""
    ep = load(spark, sf_dir, "events").select(F.col("event_id").alias("episode_id"), F.col("ts").alias("reference_time"))
    return T.episodes_in_range(ep, at(T0), at(T1))


@query("versions_scd2", """SELECT event_id AS entity_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS version_rank FROM events""")
def versions_scd2(spark, sf_dir):
    """T7, W3, W9."""
    h = load(spark, sf_dir, "events").select(F.col("event_id").alias("entity_id"), "user_id", "ts")
    return T.versions(h, "user_id", "ts")


@query("superseded", """WITH v AS (SELECT event_id, 'user '||user_id AS name, ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS closed FROM events)
SELECT event_id AS old_id, nxt AS new_id, name AS old_name, name AS new_name, closed AS superseded_at FROM v WHERE nxt IS NOT NULL""")
def superseded(spark, sf_dir):
    """T6, J23."""
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = e.select(F.col("event_id").alias("old_id"), F.lead("event_id").over(w).alias("new_id"), F.lead("ts").over(w).alias("superseded_at")).dropna(subset=["new_id"])
    ent = e.select(F.col("event_id").alias("entity_id"), F.concat(F.lit("user "), F.col("user_id")).alias("name"))
    return T.superseded(ent, s).select("old_id", "new_id", "old_name", "new_name", "superseded_at")


@query("community_members", "SELECT c_custkey AS entity_id, round(c_acctbal, 2) AS confidence FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'")
def community_members(spark, sf_dir):
    """Members of one community with the active status."""
    c = load(spark, sf_dir, "customer")
    ent = c.select(F.col("c_custkey").alias("entity_id"), F.round("c_acctbal", 2).alias("confidence"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("merged").alias("fact_status"))
    bel = c.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").cast("string").alias("community_id"))
    return T.community_members(ent, bel, "5").select("entity_id", "confidence")


@query("mark_obsolete", f"""WITH {FACTS} SELECT entity_id, CASE WHEN entity_id % 5 = 0 THEN 'obsolete' ELSE fact_status END AS fact_status,
 CASE WHEN entity_id % 5 = 0 THEN {T1} ELSE obsoleted_at END AS obsoleted_at FROM facts""")
def mark_obsolete(spark, sf_dir):
    """T10."""
    f = facts(spark, sf_dir).withColumn("modified_at", F.col("created_at"))
    ch = f.filter("entity_id % 5 = 0").select("entity_id")
    return T.mark_obsolete(f, ch, at(T1)).select("entity_id", "fact_status", "obsoleted_at")


@query("restore_entities", f"""WITH {FACTS} SELECT entity_id, CASE WHEN entity_id % 2 = 0 AND fact_status = 'obsolete' THEN 'active' ELSE fact_status END AS fact_status,
 CASE WHEN entity_id % 2 = 0 AND fact_status = 'obsolete' THEN NULL ELSE obsoleted_at END AS obsoleted_at FROM facts""")
def restore_entities(spark, sf_dir):
    """T13."""
    f = facts(spark, sf_dir).withColumn("modified_at", F.col("created_at"))
    return T.restore(f, f.filter("entity_id % 2 = 0").select("entity_id"), at(T1)).select("entity_id", "fact_status", "obsoleted_at")


@query("new_versions", f"""WITH {FACTS} SELECT entity_id, name, valid_from, CASE WHEN entity_id % 10 = 0 THEN {T1} ELSE valid_to END AS valid_to, CASE WHEN entity_id % 10 = 0 THEN 'superseded' ELSE fact_status END AS fact_status FROM facts
UNION ALL SELECT entity_id + 1000000000, name||' v2', {T1}, NULL, 'active' FROM facts WHERE entity_id % 10 = 0""")
def new_versions(spark, sf_dir):
    """T11."""
    f = facts(spark, sf_dir).withColumn("modified_at", F.col("created_at"))
    u = f.filter("entity_id % 10 = 0").select("entity_id", (F.col("entity_id") + 1000000000).alias("new_id"), F.concat("name", F.lit(" v2")).alias("name"))
    return T.new_versions(f, u, at(T1))[0].select("entity_id", "name", "valid_from", "valid_to", "fact_status")


@query("merge_temporal", f"""WITH {FACTS} SELECT entity_id, CASE WHEN entity_id % 13 = 0 THEN 'merged' ELSE fact_status END AS fact_status, CASE WHEN entity_id % 13 = 0 THEN {T1} ELSE valid_to END AS valid_to FROM facts""")
def merge_temporal(spark, sf_dir):
    """T12."""
    f = facts(spark, sf_dir).withColumn("modified_at", F.col("created_at"))
    p = f.filter("entity_id % 13 = 0").select(F.col("entity_id").alias("source_id"), (F.col("entity_id") + 1).alias("target_id"))
    return T.merge_entities(f, p, at(T1))[0].select("entity_id", "fact_status", "valid_to")


@query("temporal_statistics", f"""WITH {FACTS}, c AS (SELECT count(*) AS total, count_if(fact_status='active') AS active, count_if(fact_status='obsolete') AS obsolete, count_if(fact_status='merged') AS merged,
 count_if({COVER.format(t=T0)}) AS valid_now, count_if(valid_to IS NOT NULL) AS closed FROM facts)
SELECT 'count' AS metric, 'total' AS key, CAST(total AS BIGINT) AS value FROM c UNION ALL SELECT 'count','active',active FROM c UNION ALL SELECT 'count','obsolete',obsolete FROM c UNION ALL SELECT 'count','merged',merged FROM c
UNION ALL SELECT 'count','valid_now',valid_now FROM c UNION ALL SELECT 'count','closed',closed FROM c UNION ALL SELECT 'status', coalesce(fact_status,'unknown'), count(*) FROM facts GROUP BY 2""")
def temporal_statistics(spark, sf_dir):
    """T14."""
    return T.statistics(facts(spark, sf_dir), at(T0))


@query("asof_value", """SELECT o_orderkey, o_custkey, (SELECT e.value FROM events e WHERE e.user_id = o.o_custkey AND e.ts <= o.o_orderdate + INTERVAL 9000 DAY ORDER BY e.ts DESC, e.value DESC LIMIT 1) AS as_of_value FROM orders o""")
def asof_value(spark, sf_dir):
    """Addition: the latest event value of a customer before each order."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAY")).alias("t"))
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), "ts", "value")
    return T.as_of(o, e, "o_custkey", "t", "ts", "value").select("o_orderkey", "o_custkey", "as_of_value")

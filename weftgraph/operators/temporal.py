"""Bi-temporal predicates, timelines and versioning.

Rows carry valid time (valid_from, valid_to), transaction time (created_at,
obsoleted_at) and fact_status. Writers return new tables; nothing is changed
in place. Times are timestamps, never strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covers(t: Column) -> Column:
    """Half-open valid time: from <= t < to, open ends null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def known(t: Column) -> Column:
    """T4: recorded by ``t`` and not yet obsolete."""
    return (F.col("created_at") <= t) & (F.col("obsoleted_at").isNull() | (F.col("obsoleted_at") > t))


def valid_at(facts: DataFrame, t: Column) -> DataFrame:
    """Valid at ``t`` with status exactly active (null is not)."""
    return facts.filter(covers(t) & (F.col("fact_status") == "active"))


def in_range(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Valid time meets the closed range, any status."""
    return facts.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= end)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start)))


def facts_known_at(facts: DataFrame, t: Column) -> DataFrame:
    return facts.filter(known(t))


def bitemporal(facts: DataFrame, valid: Column, recorded: Column) -> DataFrame:
    """T5: valid at one time as known at another, any status."""
    return facts.filter(covers(valid) & known(recorded))


def timeline(episodes: DataFrame, contains: DataFrame, entity: str, by: str = "entity_id", newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Episodes that contain an entity, by time; ``by`` name is case-sensitive."""
    found = episodes.join(contains.filter(F.col(by) == entity), "episode_id", "left_semi")
    t = F.col("reference_time")
    found = found.orderBy(t.desc() if newest_first else t.asc(), "episode_id")
    return found.limit(limit) if limit else found


def episodes_in_range(episodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed range, by time."""
    return episodes.filter(F.col("reference_time").between(start, end)).orderBy("reference_time", "episode_id")


def superseded(entities: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Old and new version of each replacement, latest first."""
    old = entities.select(F.col("entity_id").alias("old_id"), F.col("name").alias("old_name"))
    new = entities.select(F.col("entity_id").alias("new_id"), F.col("name").alias("new_name"))
    return supersedes.join(old, "old_id").join(new, "new_id").orderBy(F.col("superseded_at").desc(), "old_id")


def versions(history: DataFrame, key: str, at: str) -> DataFrame:
    """Versions per key, newest first, each valid until the next one."""
    w = Window.partitionBy(key).orderBy(F.col(at), "entity_id")
    down = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("entity_id").desc())
    return history.withColumn("valid_to", F.lead(at).over(w)).withColumn("version_rank", F.row_number().over(down))


def community_members(entities: DataFrame, belongs: DataFrame, community: str) -> DataFrame:
    """Strictly active members, most confident first."""
    return entities.join(belongs.filter(F.col("community_id") == community), "entity_id", "left_semi").filter(F.col("fact_status") == "active").orderBy(
        F.col("confidence").desc_nulls_last(), "entity_id")


def mark_obsolete(facts: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """``changes`` (entity_id, reason) become obsolete at ``at``."""
    hit = facts.join(changes.select("entity_id", F.lit(True).alias("__hit")).dropDuplicates(["entity_id"]), "entity_id", "left")
    h = F.col("__hit").isNotNull()
    return hit.withColumns({
        "obsoleted_at": F.when(h, at).otherwise(F.col("obsoleted_at")), "fact_status": F.when(h, "obsolete").otherwise(F.col("fact_status")),
        "modified_at": F.when(h, at).otherwise(F.col("modified_at")),
    }).select(*facts.columns)


def restore(facts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Obsolete ones become active again; others stay."""
    hit = facts.join(ids.select("entity_id", F.lit(True).alias("__hit")).dropDuplicates(["entity_id"]), "entity_id", "left")
    h = F.col("__hit").isNotNull() & (F.col("fact_status") == "obsolete")
    return hit.withColumns({
        "obsoleted_at": F.when(h, F.lit(None)).otherwise(F.col("obsoleted_at")), "fact_status": F.when(h, "active").otherwise(F.col("fact_status")),
        "modified_at": F.when(h, at).otherwise(F.col("modified_at")),
    }).select(*facts.columns)


CORE = ("name", "ontology_type", "description", "confidence")


def new_versions(facts: DataFrame, updates: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Close the old row, add a copy with the updates, link them.

    ``updates``: entity_id, new_id and any core columns (null keeps the old value).
    Returns the table and the SUPERSEDES edges.
    """
    given = [c for c in CORE if c in updates.columns]
    u = updates.select("entity_id", "new_id", *[F.col(c).alias(f"__u_{c}") for c in given])
    both = facts.join(u, "entity_id", "left")
    hit = F.col("new_id").isNotNull()
    closed = both.withColumns({
        "valid_to": F.when(hit, at).otherwise(F.col("valid_to")), "fact_status": F.when(hit, "superseded").otherwise(F.col("fact_status")),
        "modified_at": F.when(hit, at).otherwise(F.col("modified_at")),
    }).select(*facts.columns)
    fresh = {c: F.coalesce(F.col(f"__u_{c}"), F.col(c)) for c in given}
    added = both.filter(hit).withColumns(fresh | {
        "entity_id": F.col("new_id"), "valid_from": at, "valid_to": F.lit(None), "created_at": at, "modified_at": at, "obsoleted_at": F.lit(None),
        "fact_status": F.lit("active"),
    }).select(*[F.col(c).cast(facts.schema[c].dataType) for c in facts.columns])
    edges = updates.join(facts.select("entity_id"), "entity_id", "left_semi").select(
        F.col("new_id"), F.col("entity_id").alias("old_id"), at.alias("superseded_at"))
    return closed.unionByName(added), edges


def merge_entities(facts: DataFrame, pairs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Sources (source_id -> target_id) end as merged; edges record it."""
    hit = facts.join(pairs.select(F.col("source_id").alias("entity_id"), F.lit(True).alias("__hit")).dropDuplicates(["entity_id"]), "entity_id", "left")
    h = F.col("__hit").isNotNull()
    out = hit.withColumns({
        "fact_status": F.when(h, "merged").otherwise(F.col("fact_status")), "valid_to": F.when(h, at).otherwise(F.col("valid_to")),
        "modified_at": F.when(h, at).otherwise(F.col("modified_at")),
    }).select(*facts.columns)
    return out, pairs.select("source_id", "target_id", at.alias("merged_at"))


def statistics(facts: DataFrame, t: Column) -> DataFrame:
    """Counts and histograms as (metric, key, value)."""
    one = facts.agg(
        F.count("*").alias("total"), F.count_if(F.col("fact_status") == "active").alias("active"), F.count_if(F.col("fact_status") == "obsolete").alias("obsolete"),
        F.count_if(F.col("fact_status") == "merged").alias("merged"), F.count_if(covers(t)).alias("valid_now"), F.count_if(F.col("valid_to").isNotNull()).alias("closed"),
    )
    names = one.columns
    counts = one.select(F.expr("stack({}, {}) as (key, value)".format(len(names), ", ".join(f"'{n}', `{n}`" for n in names))))
    by_status = facts.groupBy(F.coalesce("fact_status", F.lit("unknown")).alias("key")).agg(F.count("*").alias("value"))
    return counts.select(F.lit("count").alias("metric"), "key", "value").unionByName(by_status.select(F.lit("status").alias("metric"), "key", "value"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str) -> DataFrame:
    """The latest right value at or before each left time, by one sort of the union."""
    cols = left.columns
    l = left.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = right.select(F.col(key), F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn("as_of_value", F.last("__v", ignorenulls=True).over(w)).filter(F.col("__side") == 1).select("__row.*", "as_of_value")

"""Merge-style writers as joins and aggregates.

Parquet has no MERGE; each function gives the table after the merge, to be
written to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Outer join on ``key``; per column ``new`` takes the new
    value, ``coalesce`` the new one unless null, ``keep`` the old one, ``max`` and
    ``min`` the extreme. Unmatched new rows take their own values; of new rows of one
    key the greatest counts."""
    rows = F.struct(*[F.col(c) for c in new.columns if c != key])
    a, b = old.alias("a"), new.groupBy(key).agg(F.max(rows).alias("__row")).select(key, "__row.*").alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    out = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    matched = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    for c in old.columns:
        if c == key:
            continue
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        rule = rules.get(c, "keep")
        merged = {"new": y, "coalesce": F.coalesce(y, x), "keep": x, "max": F.greatest(x, y), "min": F.least(x, y)}[rule]
        out.append(F.when(matched, merged).otherwise(F.coalesce(x, y)).alias(c))
    return both.select(*out)


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, types: dict[str, str] | None = None, default: str = "RELATED_TO") -> DataFrame:
    """K2, K4: typed edges whose ends exist, once per (src, rel_type, dst)."""
    rel: Column = F.col("rel_type")
    if types:
        table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
        rel = F.coalesce(F.try_element_at(table, F.col("rel_type")), F.lit(default))
    ids = nodes.select("id").distinct()
    ok = new.select("src", "dst", rel.alias("rel_type")).join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return edges.select("src", "dst", "rel_type").unionByName(ok).dropDuplicates(["src", "rel_type", "dst"])


def entity_merge_max(rows: DataFrame) -> DataFrame:
    """K3: one row per entity, first name by time, highest confidence, all chunks."""
    first = F.min(F.struct("created_at", "name")).getField("name")
    return rows.groupBy("entity_id").agg(first.alias("name"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))


def accumulate(rows: DataFrame, keys: list[str], text: str, label: str, at: str) -> DataFrame:
    """K5, K6: descriptions joined in time order, distinct label history, count."""
    items = F.array_sort(F.collect_list(F.struct(F.col(at), F.col(text).alias("t"), F.col(label).alias("l"))))
    out = rows.groupBy(*keys).agg(items.alias("items"), F.count("*").alias("extraction_count"))
    return out.select(
        *keys, F.array_join(F.transform("items", lambda i: i["t"]), " | ").alias("description"),
        F.array_distinct(F.transform("items", lambda i: i["l"])).alias("label_history"), "extraction_count")


def first_writer(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K7: the first row of each key stays."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") == 1).drop("__n")


def label_counts(rows: DataFrame, name: str, category: str, at: str) -> DataFrame:
    """K8: uses of each label with first and last time."""
    return rows.groupBy(name, category).agg(F.count("*").alias("uses"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def chunk_edges(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K9: HAS_CHUNK edges (source to chunk, with position) and CHILD_OF edges."""
    has = chunks.select(F.col("source_id").alias("src"), F.col("chunk_id").alias("dst"), F.col("chunk_index").alias("position"))
    child = chunks.filter(F.col("parent_chunk_id").isNotNull()).select(F.col("chunk_id").alias("src"), F.col("parent_chunk_id").alias("dst"))
    return has, child


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and every edge that touches one of them removed."""
    left = nodes.join(gone, "id", "left_anti")
    e = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
    return left, e


def resolve_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Names to ids, case ignored, the last of equal names wins; edges with an
    unknown end are dropped. ``entities``: name, entity_id, pos (order)."""
    low = entities.withColumn("k", F.lower("name"))
    last = low.groupBy("k").agg(F.max_by("entity_id", "pos").alias("id"))
    return (
        edges.join(last.toDF("ks", "src"), F.lower("source") == F.col("ks")).join(last.toDF("kt", "dst"), F.lower("target") == F.col("kt"))
        .select("src", "dst", "rel_type")
    )


def transfer_edges(edges: DataFrame, mapping: DataFrame, retype: str | None = None) -> DataFrame:
    """Ends rewritten through ``mapping`` (old, primary); types are kept
    unless ``retype`` names the one that moved edges get."""
    m1, m2 = mapping.toDF("src", "ps"), mapping.toDF("dst", "pd")
    moved = F.col("ps").isNotNull() | F.col("pd").isNotNull()
    rel = F.when(moved, F.lit(retype)).otherwise(F.col("rel_type")) if retype else F.col("rel_type")
    return edges.join(m1, "src", "left").join(m2, "dst", "left").select(
        F.coalesce("ps", "src").alias("src"), F.coalesce("pd", "dst").alias("dst"), rel.alias("rel_type")).distinct()


def merge_members(rows: DataFrame) -> DataFrame:
    """one entity per group: first name, other names as aliases, distinct
    descriptions joined, highest confidence, earliest start, all urls.
    ``rows``: grp, pos, name, description, confidence, valid_from, url."""
    items = F.array_sort(F.collect_list(F.struct("pos", "name", "description")))
    out = rows.groupBy("grp").agg(items.alias("items"), F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"),
                                  F.array_sort(F.collect_set("url")).alias("urls"))
    def join(acc: Column, i: Column) -> Column:
        new = i["description"]
        return F.when(new.isNull() | F.contains(acc, new), acc).when(acc == "", new).otherwise(F.concat(acc, F.lit(" "), new))

    name = F.col("items")[0]["name"]
    others = F.array_distinct(F.filter(F.transform("items", lambda i: i["name"]), lambda n: n != name))
    return out.select("grp", name.alias("name"), F.array_sort(others).alias("aliases"), F.aggregate("items", F.lit(""), join).alias("description"), "confidence", "valid_from", "urls")

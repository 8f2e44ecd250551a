"""Small configuration sources: seeds, JSON lines caches, trust tables, ontologies,
golden datasets and sitemaps (S3-S7, S12-S15, D25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default trusted sources (domain, match type, level, category).
TRUSTED = (
    ("arxiv.org", "exact", "high", "academic"), ("scholar.google.com", "exact", "high", "academic"), ("pubmed.gov", "exact", "high", "academic"),
    ("semanticscholar.org", "exact", "high", "academic"), ("wikipedia.org", "exact", "medium", "reference"), ("britannica.com", "exact", "high", "reference"),
    ("stanford.edu", "exact", "high", "reference"), ("reuters.com", "exact", "high", "news"), ("apnews.com", "exact", "high", "news"),
    ("bbc.com", "exact", "medium", "news"), (".gov", "suffix", "high", "government"), ("who.int", "exact", "high", "government"), ("un.org", "exact", "high", "government"),
)
LEVELS = ("low", "medium", "high")


def corpus_slice(df: DataFrame, order: Column, start: int, limit: int) -> DataFrame:
    """S3: rows ``start`` to ``start + limit`` in a total order."""
    return df.orderBy(order).offset(start).limit(limit)


def seeds(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Qid, name and category of a seeds file, one category if given."""
    out = spark.read.option("multiLine", True).json(path).select(F.explode("seeds").alias("s")).select("s.qid", "s.name", "s.category")
    return out.filter(F.col("category") == category) if category else out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines table; broken lines become null rows and are dropped."""
    return spark.read.schema(schema).json(path).dropna("all")


def uncached(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows that a cache does not hold yet."""
    return df.join(cache.select(key).distinct(), key, "left_anti")


def trust_table(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The default sources in order, later rows added at the end."""
    rows = [(i, *r) for i, r in enumerate((*TRUSTED, *extra))]
    return spark.createDataFrame(rows, "ord int, pattern string, match_type string, level string, category string")


def trust_at_least(table: DataFrame, level: str) -> DataFrame:
    """Sources of a level or better."""
    return table.filter(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")) >= LEVELS.index(level) + 1)


def trust_match(hosts: DataFrame, table: DataFrame, blocked: DataFrame, host_col: str = "host") -> DataFrame:
    """(host, trusted, level, category): blocked first, then the first match.
    Blocked patterns (pattern) match a host and its subdomains."""
    def sub(p: Column) -> Column:
        h = F.col(host_col)
        return F.when(p.startswith("."), h.endswith(p)).otherwise((h == p) | h.endswith(F.concat(F.lit("."), p)))

    names = hosts.select(host_col).distinct()
    p = F.col("pattern")
    bad = names.join(blocked.select("pattern"), sub(p), "left_semi").withColumn("__bad", F.lit(True))
    hit = F.when(F.col("match_type") == "suffix", F.col(host_col).endswith(p)).when(F.col("match_type") == "contains", F.contains(F.col(host_col), p)).otherwise(sub(p))
    first = names.join(table, hit).groupBy(host_col).agg(F.min(F.struct("ord", "level", "category")).alias("m"))
    out = hosts.join(bad, host_col, "left").join(first, host_col, "left")
    ok = F.col("__bad").isNull() & F.col("m").isNotNull()
    return out.select(*hosts.columns, ok.alias("trusted"), F.when(ok, F.col("m.level")).alias("level"), F.when(ok, F.col("m.category")).alias("category"))


def trust_export(table: DataFrame) -> DataFrame:
    """Sources grouped by category."""
    return table.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("pattern", "level", "match_type"))).alias("sources"))


def ontology(spark: SparkSession, types: dict[str, str], kind: str) -> DataFrame:
    """An ontology as rows: kind, label, description."""
    return spark.createDataFrame([(kind, k, v) for k, v in types.items()], "kind string, label string, description string")


def golden(cases: DataFrame, kind: str | None = None, status: str | None = None, difficulty: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Golden cases by type, status, difficulty and any of some tags."""
    for col, v in (("type", kind), ("review_status", status), ("difficulty", difficulty)):
        if v is not None:
            cases = cases.filter(F.col(col) == v)
    return cases.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else cases


def sitemap(pages: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Url and lastmod of every entry of sitemap documents."""
    def tags(path: str) -> Column:
        return F.xpath(F.regexp_replace(xml_col, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), F.lit(path))

    pairs = F.arrays_zip(tags("/urlset/url/loc/text()").alias("loc"), tags("/urlset/url/lastmod/text()").alias("lastmod"))
    return pages.select(F.explode(pairs).alias("e")).select(F.col("e.loc").alias("url"), F.col("e.lastmod").alias("lastmod"))


def sitemap_index(pages: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The sitemaps that a sitemap index names, for the next round of reading."""
    plain = F.regexp_replace(xml_col, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    return pages.select(F.explode(F.xpath(plain, F.lit("/sitemapindex/sitemap/loc/text()"))).alias("url"))


def expand_sitemaps(start: DataFrame, documents: DataFrame, most: int = 10) -> DataFrame:
    """Url and lastmod of all entries below the sitemaps ``start`` (url), whose
    text ``documents`` (url, xml) hold; indexes are followed, each sitemap once."""
    seen, frontier, out = start.select("url").distinct(), start.select("url").distinct(), None
    for _ in range(most):
        read = documents.join(frontier, "url", "left_semi")
        entries = sitemap(read)
        out = entries if out is None else out.unionByName(entries)
        frontier = sitemap_index(read).distinct().join(seen, "url", "left_anti").checkpoint()
        if frontier.isEmpty():
            return out
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"sitemap indexes are nested more than {most} deep")


def merge_golden(old: DataFrame, new: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases of two datasets, the newer one of equal ids."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def named_records(rows: DataFrame, names: list[str], col: str = "row") -> DataFrame:
    """Positional result rows (an array each) as named columns; positions
    beyond a row's end are null."""
    return rows.select(*[F.get(F.col(col), F.lit(i)).alias(n) for i, n in enumerate(names)])

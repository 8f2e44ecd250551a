"""Text, URL and id column builders (F1-F20, F28-F32, P2, P10, P17). JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noise lines that cleaning removes.
NOISE_PAGE = (
    r"Cookie\s*(Settings|Policy|Preferences).*?\n", r"Accept\s*(All)?\s*Cookies.*?\n", r"Skip to (main )?content.*?\n",
    r"Share this (page|article).*?\n", r"Print this page.*?\n", r"Follow us on.*?\n",
)
NOISE_ARTICLE = NOISE_PAGE + (r"Subscribe to our newsletter.*?\n", r"©\s*\d{4}.*?\n", r"All rights reserved.*?\n")
# Stop words of the two keyword extractors.
STOP_QUERY = ("the", "is", "at", "which", "on", "what", "how", "does", "are", "was", "for", "and", "gas", "turbine")
STOP_STUDY = ("what", "is", "the", "a", "an", "and", "or", "how", "does", "do", "are", "in", "to", "of", "for", "with", "on", "at",
              "between", "from", "that", "which", "this", "its", "their")
# Words and phrases that hint at entity and relation types.
TYPE_HINTS = {
    "Technology": ("technology", "system", "software", "hardware", "device"),
    "Organization": ("company", "corporation", "organization", "institution", "university"),
    "Person": ("inventor", "founder", "engineer", "scientist", "researcher"),
    "Location": ("country", "city", "region", "facility", "plant"),
    "Process": ("process", "method", "technique", "procedure", "workflow"),
    "Product": ("product", "model", "version", "series", "line"),
    "Event": ("event", "conference", "meeting", "launch", "announcement"),
    "Concept": ("concept", "theory", "principle", "standard", "specification"),
}
RELATION_HINTS = {
    "PART_OF": ("part of", "component of", "belongs to", "included in"),
    "PRODUCES": ("produces", "manufactures", "creates", "generates"),
    "USES": ("uses", "utilizes", "employs", "requires"),
    "LOCATED_IN": ("located in", "based in", "headquartered in"),
    "DEVELOPED_BY": ("developed by", "created by", "invented by", "designed by"),
    "RELATED_TO": ("related to", "associated with", "connected to"),
}
# Patterns of a defining sentence and marks of navigation text.
DEFINITIONS = (r"\bis\s+a\b", r"\bare\s+a\b", r"\brefers\s+to\b", r"\bis\s+defined\b", r"\bis\s+the\b", r"\bare\s+the\b")
NAVIGATION = ("click here", "learn more", "contact us", "subscribe")


def words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def title_case(c: Column) -> Column:
    """``_`` to space, white space collapsed, every run of letters capitalised
    (after an apostrophe or hyphen too, unlike ``initcap``)."""
    plain = F.trim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\s+", " "))
    runs = F.regexp_extract_all(F.lower(plain), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def relation_type(c: Column) -> Column:
    """runs of non-word characters to ``_``, upper case."""
    return F.upper(F.regexp_replace(c, r"(?U)\W+", "_"))


def relation_key(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """canonical relation name, through a synonym map if given."""
    key = F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), r"\s+", " ")), " ", "_")
    if not synonyms:
        return key
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def clean_label(c: Column, most: int = 30) -> Column:
    """a label out of a chatty reply: markdown and lead-ins gone, the part
    after a colon, first line, at most ``most`` characters."""
    bare = F.regexp_replace(c, r"[*`#\"']", "")
    first = F.trim(F.element_at(F.split(F.trim(bare), r"\n"), 1))
    after = F.trim(F.regexp_replace(first, r"^[^:]*:\s*", ""))
    return F.substring(after, 1, most)


def clean_text(c: Column, noise: tuple[str, ...] = NOISE_PAGE) -> Column:
    """long runs of line ends and spaces shortened, noise lines gone, trimmed."""
    out = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {2,}", " ")
    for n in noise:
        out = F.regexp_replace(out, "(?i)" + n, "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def cut_at_sentence(c: Column, most: int) -> Column:
    """Whole sentences up to ``most`` characters, else a cut with dots."""
    state = F.struct(F.lit("").alias("t"), F.lit(False).alias("stop"))

    def add(acc: Column, s: Column) -> Column:
        fits = ~acc["stop"] & (F.length(acc["t"]) + F.length(s) + 1 <= most)
        return F.struct(F.when(fits, F.concat(acc["t"], s, F.lit(" "))).otherwise(acc["t"]).alias("t"), (~fits).alias("stop"))

    kept = F.trim(F.aggregate(sentences(c), state, add)["t"])
    return F.when(F.length(c) <= most, c).when(kept != "", kept).otherwise(F.concat(F.substring(c, 1, most), F.lit("...")))


def first_paragraph(c: Column, most: int = 500) -> Column:
    """the first paragraph of 50 characters that is no heading, cut at a sentence."""
    paras = F.transform(F.split(F.trim(c), r"\n\s*\n"), lambda p: F.trim(p))
    good = F.filter(paras, lambda p: (F.length(p) >= 50) & (p != F.upper(p)) & ~p.startswith("#"))
    return cut_at_sentence(F.get(good, F.lit(0)), most)


def paragraph_score(para: Column, name: Column) -> Column:
    """how likely a paragraph defines ``name``."""
    low, n = F.lower(para), F.lower(name)
    starts = low.startswith(n)
    for lead in ("a ", "an ", "the "):
        starts = starts | low.startswith(F.concat(F.lit(lead), n))
    score = F.when(F.contains(low, n), F.when(starts, 5.0).otherwise(3.0)).otherwise(0.0)
    for p in DEFINITIONS:
        score = score + F.when(low.rlike(p), 1.0).otherwise(0.0)
    nav = F.lit(False)
    for x in NAVIGATION:
        nav = nav | F.contains(low, F.lit(x))
    return score - F.when(nav, 2.0).otherwise(0.0) + F.when(F.length(para).between(100, 400), 0.5).otherwise(0.0)


def url_host(url: Column) -> Column:
    """host without any ``www.``."""
    return F.replace(F.coalesce(F.parse_url(url, F.lit("AUTHORITY")), F.lit("")), F.lit("www."), F.lit(""))


def url_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")


def url_entry(url: Column) -> dict[str, Column]:
    """Domain, division, category, subcategory, depth and parent url."""
    parts = url_parts(url)
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "/"))
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    root = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("AUTHORITY")), F.lit("/"))
    parent = F.when(F.size(parts) > 1, F.concat(root, up, F.lit("/"))).when(F.size(parts) == 1, root)
    return {
        "domain": url_host(url), "division": F.coalesce(F.get(parts, F.lit(0)), F.lit("")), "category": F.get(parts, F.lit(1)),
        "subcategory": rest, "depth": F.size(parts), "parent_url": parent,
    }


def wiki_title(url: Column) -> Column:
    """the article name in a wiki url (a plus sign stays a plus sign)."""
    return F.replace(F.url_decode(F.replace(F.regexp_extract(url, r"/wiki/([^?#]+)", 1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def domain(url: Column) -> Column:
    """lower-case host of a url, or the text itself if it is none."""
    return F.lower(F.when(F.contains(url, F.lit("://")), F.parse_url(url, F.lit("AUTHORITY"))).otherwise(url))


def keywords(c: Column, stop: tuple[str, ...] = STOP_QUERY) -> Column:
    """words of more than two characters that are no stop words, trimmed of punctuation."""
    kept = F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.transform(kept, lambda w: F.regexp_replace(w, "^['\",.?!]+|['\",.?!]+$", ""))


def keywords_study(c: Column) -> Column:
    """the second variant: question marks and full stops dropped first."""
    return F.filter(words(F.replace(F.replace(c, F.lit("?"), F.lit("")), F.lit("."), F.lit(""))), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_STUDY))


def fixed_chunks(c: Column, size: int, overlap: int) -> Column:
    """windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(c) - F.lit(overlap)) / F.lit(step)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * step + 1, F.lit(size)))


def sections(c: Column) -> Column:
    """text before and between level-two headings."""
    return F.filter(F.split(c, r"(?m)^(?=##\s)"), lambda s: F.trim(s) != "")


def word_windows(c: Column, size: int = 500) -> Column:
    """Windows of size/5 words every size/2 words, as matched text."""
    w, step, width = words(c), size // 2, size // 5
    n = F.greatest(F.ceil(F.size(w) / F.lit(step)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, width), " "))


def short_hash(*parts: Column) -> Column:
    """first 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def truncate(c: Column, most: int) -> Column:
    """at most ``most`` characters, the last three dots if something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def fenced_json(c: Column) -> Column:
    """the JSON object inside a fenced or chatty reply."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def count_of(c: Column, part: str) -> Column:
    """Occurrences of a literal, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def hits(c: Column, phrases: tuple[str, ...]) -> Column:
    """occurrences of any of the phrases, case ignored."""
    low = F.lower(c)
    return sum((count_of(low, p) for p in phrases[1:]), count_of(low, phrases[0]))


def ontology_type(labels: Column, known: tuple[str, ...]) -> Column:
    """the first label of the ontology, else the first label, else Concept."""
    inside = F.filter(labels, lambda x: x.isin(*known))
    return F.coalesce(F.get(inside, F.lit(0)), F.get(labels, F.lit(0)), F.lit("Concept"))


def source_type(c: Column) -> Column:
    """canonical source type names."""
    low = F.lower(c)
    return F.when(low.isin("web", "web_search", "webpage", "url"), "web").when(low.isin("wiki", "wikipedia", "wiki_search"), "wiki").when(
        low.isin("entity", "graph", "graph_lookup", "neo4j"), "graph").otherwise(F.coalesce(low, F.lit("unknown")))


def looks_like_query(c: Column) -> Column:
    """Has MATCH and RETURN, balanced brackets and no code fence."""
    ok = F.contains(F.upper(c), F.lit("MATCH")) & F.contains(F.upper(c), F.lit("RETURN")) & ~F.contains(c, F.lit("```"))
    for a, b in ("()", "[]", "{}"):
        ok = ok & (count_of(c, a) == count_of(c, b))
    return ok


def print_step(thought: Column, action: Column, action_input: Column, observation: Column) -> Column:
    """F32: one step of a trace as text; parts that are null are left out."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Thought: "), thought), F.concat(F.lit("Action: "), action),
        F.when(action.isNotNull(), F.concat(F.lit("Action Input: "), action_input)), F.concat(F.lit("Observation: "), observation))


def parse_trace(c: Column) -> Column:
    """F32: the steps of a printed trace: thought, action, observation each (empty
    where a step has none), by the labels that start its lines."""
    def part(step: Column, label: str) -> Column:
        return F.trim(F.regexp_extract(step, rf"(?m)^{label}: (.*)$", 1))

    steps = F.filter(F.split(c, r"\n\n(?=Thought: )"), lambda s: s.startswith("Thought: "))
    return F.transform(steps, lambda s: F.struct(part(s, "Thought").alias("thought"), part(s, "Action").alias("action"), part(s, "Observation").alias("observation")))

"""Main content of a page by selector order, with the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

# Elements that are dropped, and where content is looked for, in order.
DROPPED = ("script", "style", "nav", "footer", "header")
SELECTORS = ("main", "article", '[role="main"]', ".main-content", ".content", "#content", ".page-content", ".article-content")
MIN_CHARS = 100
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[int]]] = []
        self.dropped = 0
        self.found: dict[int, list[str]] = {}
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        names = {tag, *("." + c for c in (a.get("class") or "").split()), "#" + (a.get("id") or ""), f'[role="{a.get("role") or ""}"]'}
        self.stack.append((tag, [i for i, s in enumerate(SELECTORS) if s in names and i not in self.found]))
        for i in self.stack[-1][1]:
            self.found[i] = []
        self.dropped += tag in DROPPED

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            self.dropped -= sum(t in DROPPED for t, _ in self.stack[at:])
            del self.stack[at:]

    def handle_data(self, data):
        if self.dropped or not data.strip():
            return
        self.body.append(data.strip())
        for _, hits in self.stack:
            for i in hits:
                self.found[i].append(data.strip())


def content(page: str | None) -> str:
    p = _Collector()
    p.feed(page or "")
    text = "\n".join(next((p.found[i] for i in range(len(SELECTORS)) if p.found.get(i)), p.body))
    return text


def main_content(pages: DataFrame) -> DataFrame:
    """page_id, url, cleaned content of pages with at least 100 characters of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["page_id", "url"]].assign(content=[content(h) for h in pdf["html"]])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, content string")
    return found.withColumn("content", clean_text(F.col("content"))).filter(F.length("content") >= MIN_CHARS)

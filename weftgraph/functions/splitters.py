"""Recursive character splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that
    occurs; neighbours share up to ``overlap`` characters."""
    sep, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    window: list[str] = []
    length = 0

    def close() -> None:
        piece = sep.join(window).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size and rest:
            close()
            window, length = [], 0
            out += split_text(part, size, overlap, rest)
            continue
        grown = length + len(part) + (len(sep) if window else 0)
        if grown > size and window:
            close()
            while window and (length > overlap or length + len(part) + len(sep) > size):
                length -= len(window[0]) + (len(sep) if len(window) > 1 else 0)
                window = window[1:]
            grown = length + len(part) + (len(sep) if window else 0)
        window = [*window, part]
        length = grown
    close()
    return out


def split_documents(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per chunk: id, chunk_index, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, c) for i, t in zip(pdf[id_col], pdf[text_col]) for n, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(docs.dtypes)[id_col]}, chunk_index int, content string")

"""Python data sources that stand for outside services.

Nothing here opens a connection: a source reads a local folder of saved replies,
one JSON object a line, and a real client can replace ``replies``. Retries and
waits are the client's business; a partition is one file.
"""

from __future__ import annotations

import glob
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, fields: list[str], most: dict[str, int]):
        self.folder, self.fields, self.most = folder, fields, most

    def partitions(self):
        return [_File(p) for p in sorted(glob.glob(f"{self.folder}/*.jsonl"))] or [_File("")]

    def replies(self, path: str):
        if path:
            with open(path, encoding="utf-8") as f:
                yield from (json.loads(line) for line in f if line.strip())

    def read(self, partition):
        for r in self.replies(partition.path):
            yield tuple(None if r.get(k) is None else str(r[k])[: self.most.get(k)] for k in self.fields)


class _Replies(DataSource):
    FIELDS: tuple[str, ...] = ()
    MOST: dict[str, int] = {}

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in self.FIELDS)

    def reader(self, schema):
        return _Reader(self.options["path"], list(self.FIELDS), self.MOST)


class Articles(_Replies):
    """Encyclopedia articles, content cut at 50 000 characters."""

    FIELDS = ("title", "url", "content")
    MOST = {"content": 50_000}


class Bindings(_Replies):
    """Rows of a graph endpoint: source, property, target, label."""

    FIELDS = ("source_qid", "property_id", "target_qid", "label")


class WebResults(_Replies):
    """Search results with extracted content."""

    FIELDS = ("query", "url", "title", "content")


def register(spark) -> None:
    for source in (Articles, Bindings, WebResults):
        spark.dataSource.register(source)

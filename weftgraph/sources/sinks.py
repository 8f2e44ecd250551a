"""Table and text sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by type, the layout that prunes partitions."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def episodes(chunks: DataFrame, most: int = 2000) -> DataFrame:
    """Episodes with shortened content, derived from their chunks."""
    return chunks.select(F.concat(F.lit("ep_"), F.col("chunk_id")).alias("episode_id"), F.substring("content", 1, most).alias("content"), F.col("chunk_id").alias("source_chunk_id"))


def documents(docs: DataFrame, most: int = 10_000) -> DataFrame:
    """Content for the store and the text that gets embedded."""
    return docs.withColumns({"content": F.substring("content", 1, most), "embed_text": F.concat_ws(": ", "title", F.substring("content", 1, 500))})


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def sharegpt(messages: DataFrame) -> DataFrame:
    """Messages (array of role, content) in the from/value form."""
    return messages.withColumn("conversations", F.transform("messages", lambda m: F.struct(
        F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))).drop("messages")


def alpaca(messages: DataFrame) -> DataFrame:
    """Instruction, input and output of a system, user, assistant triple."""
    return messages.select(*[c for c in messages.columns if c != "messages"], F.col("messages")[0]["content"].alias("instruction"), F.col("messages")[1]["content"].alias("input"), F.col("messages")[2]["content"].alias("output"))


def write_splits(df: DataFrame, path: str) -> None:
    """Per split and domain in one partitioned table."""
    df.write.mode("overwrite").partitionBy("split", "domain").json(path)


def junit_xml(results: list[dict], suite: str = "evaluation") -> str:
    """A test report of a small list of results: name, passed, message, seconds."""
    from xml.sax.saxutils import escape, quoteattr

    failed = sum(not r["passed"] for r in results)
    rows = [f'<testsuite name={quoteattr(suite)} tests="{len(results)}" failures="{failed}">']
    for r in results:
        inner = "" if r["passed"] else f"<failure>{escape(r.get('message') or '')}</failure>"
        rows.append(f'<testcase name={quoteattr(r["name"])} time="{r.get("seconds", 0):.3f}">{inner}</testcase>')
    return "\n".join([*rows, "</testsuite>"])


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """A markdown table of a small result."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(columns), line("---" for _ in columns), *(line(r) for r in rows)])

"""Helpers shared by the operators: shared scratch tables and text access."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in local mode (tests) a temporary
    folder is made and set, once per application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that pass between JVM and Python at once. Rows here hold whole texts, sets or
#: images, and both sides hold a batch, the JVM in buffers that it does not give back.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside pass at most ``BATCH_ROWS`` rows at once to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables made by :func:`materialize` inside the open scopes, innermost last.
_SCOPES: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, but columnar and compressed,
    so later reads prune columns. A lost executor costs a re-read only.
    """
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope that deletes the tables made in it at its end, but for those given to
    the function it yields (they pass to the scope around it)."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        paths = {df.scratch_path for df in kept}
        drop_scratch(*[df for df in made if df.scratch_path not in paths])
        if _SCOPES:
            _SCOPES[-1].extend(df for df in made if df.scratch_path in paths)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize`, once nothing reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not at some later
    garbage collection of an idle driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


_MODEL: list = [None, None]


def one_model(key, make: Callable):
    """What ``make`` gives for ``key``, kept by a worker process until another is asked
    for: a worker that serves several operators holds the vocabulary of one at a time."""
    if _MODEL[0] != key:
        _MODEL[:] = [None, None]
        gc.collect()
        _MODEL[:] = [key, make()]
    return _MODEL[1]

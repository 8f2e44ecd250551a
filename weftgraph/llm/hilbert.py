"""Sharding along a Hilbert curve (DataFrame functions only).

Several metadata columns are quantised to a few bits each, equal shares of the
rows to each step; the cell's index on the Hilbert curve through that grid is
computed with bit operations, rows are sorted by it, and the order is cut into
runs. Neighbouring cells of the curve are neighbours in every dimension, so a
shard covers a compact box and its minima and maxima prune files.

The law is ``rows``: the n-th row of the order goes to shard n * shards // rows,
so counts differ by at most one whatever the data. Ties within a cell go by the
checksum of the text, so that equal texts of a cell stand together (a shard's end
may still part them), then by a hash of the id and the id. Ranks are counted from the sizes of the sorted range
partitions, kept as a narrow table in the shared folder; no task sees the whole
order. Null ids, nulls in any dimension and null or empty text (no bytes) are
values like any other; a very long text counts by its size alone; repeated rows get
slots of their own; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

BITS = 5
SHARDS = 40


def hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Add the Hilbert index of integer columns ``dims`` (each below 2**bits).

    Gray-code transform after Skilling: undo excess work from the top bit down,
    Gray encode, then interleave. One projection per step keeps every
    intermediate value computed once.
    """
    x = [f"__wg_x{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(d).cast("long") for a, d in zip(x, dims)})
    for b in range(bits - 1, 0, -1):
        low = F.lit((1 << b) - 1).cast("long")
        for i, a in enumerate(x):
            is_set = F.col(a).bitwiseAND(F.lit(1 << b)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(low)
            first = F.when(is_set, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swap))
            cols = {x[0]: first}
            if i:
                cols[a] = F.when(is_set, F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))
            df = df.withColumns(cols)
    for i in range(1, len(x)):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    flip: Column = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("__wg_flip", flip)
    df = df.withColumns({a: F.col(a).bitwiseXOR(F.col("__wg_flip")) for a in x})
    index: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in x:
            bit = F.shiftright(F.col(a), b).bitwiseAND(F.lit(1).cast("long"))
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return df.withColumn(out, index).drop(*x, "__wg_flip")


def _steps(df: DataFrame, dim: str, bits: int, partitions: int) -> DataFrame:
    """(value, step): steps of equal shares of the rows, in order of the value.
    One row per distinct value, counted before the shuffle; the shares are summed
    up range by range, so that no task sees all the values."""
    counts = df.groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(partitions, F.col("v").asc_nulls_first()).select("v", "n", F.spark_partition_id().alias("p"))
    ranged = materialize(ranged, "hilbert-values")
    # One row per range.
    ranges = ranged.groupBy("p").agg(F.sum("n").alias("m"))
    ahead = ranges.select("p", (F.sum("m").over(Window.orderBy("p")) - F.col("m")).alias("ahead"), F.sum("m").over(Window.partitionBy()).alias("total"))
    before = F.col("ahead") + F.sum("n").over(Window.partitionBy("p").orderBy(F.col("v").asc_nulls_first())) - F.col("n")
    return ranged.join(F.broadcast(ahead), "p").select(
        F.col("v").alias(f"__wg_v_{dim}"), F.floor((before * (1 << bits)) / F.col("total")).cast("long").alias(f"__wg_q_{dim}")
    )


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    categories: tuple[str, ...] = ("lang", "source"), bits: int = BITS, partitions: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, size, crc32 of the text, law, shard and slot."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    plain = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)],
    )
    with scratch() as keep:
        # A narrow table (no text), read several times below.
        plain = materialize(plain, "hilbert-metadata")
        # Sizes fall into classes of a quarter of a power of two: a bounded set of values.
        plain = plain.withColumn("z", F.floor(F.log2(F.col("size").cast("double")) * 4).cast("long"))
        dims = [f"c{i}" for i in range(len(categories))] + ["z"]
        placed = plain
        for d in dims:
            steps = _steps(plain, d, bits, partitions)
            placed = placed.join(steps, F.col(d).eqNullSafe(F.col(f"__wg_v_{d}"))).drop(f"__wg_v_{d}")
        indexed = hilbert_index(placed, [f"__wg_q_{d}" for d in dims], bits, "h")
        order = ["h", "crc", "tie", "id", "size"]
        ranged = (
            indexed.select("id", "size", "crc", "h", F.xxhash64("id").alias("tie"))
            .repartitionByRange(partitions, *order)
            .sortWithinPartitions(*order)
            .select("id", "size", "crc", F.monotonically_increasing_id().alias("at"))
        )
        ranged = keep(materialize(ranged, "hilbert-order"))
    part = F.shiftrightunsigned("at", 33)
    # One row per range partition.
    counts = ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    offsets = counts.select(
        "p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    number = F.expr(f"(rank * {shards}L) div total").cast("int")
    start = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return (
        ranged.withColumn("p", part).join(F.broadcast(offsets), "p")
        .withColumn("rank", rank)
        .withColumn("shard", number)
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
            (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )

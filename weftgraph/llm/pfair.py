"""Mixing sources to target weights by Pfair scheduling.

Every source's rows, in a hashed order, are cut into blocks of equal size. With
weight w (a share of 1), block k of a source may run from slot floor(k / w) on
and must run before slot ceil((k + 1) / w); giving each slot to the released
block of the earliest deadline keeps every source within one block of its
target at every slot. Weights are whole numbers, so the schedule repeats after
as many slots as their sum: one period is worked out on the driver (its length
is bounded by ``MAX_PERIOD``) and block k of a source with weight a runs at
slot k // a * period + place[k % a]. When a source ends, its slots stay empty,
so the others keep their ratios and every row is scheduled.

:func:`mix` works the schedule out on a narrow table (source, hash, size) and then
moves every text once, straight to the part of the schedule that its hash falls
into: a source's rows of one part are a stretch of its hashes, so a bounded table
of stretches (sources times parts, at most ``MAX_STRETCHES``) places every row.

Null ids, sources and texts are values like any other (a null source is a source
of its own, a null text has no bytes); empty texts have their overhead as size; a
very long text is one row of its block, which then ends late; rows of equal id and
text, and rows of equal hash, are scheduled one after the other in no fixed order
(in :func:`mix` they stay in one part); repeated ids with different texts fall
apart; columns of any name are kept by :func:`mix` and ignored by :func:`schedule`;
an empty table gives an empty schedule.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

MAX_PERIOD = 100_000
MAX_SOURCES = 10_000
BLOCK_BYTES = 1_000_000
#: Rows per (source, hash range); no window or task gathers more on average.
RANGE_ROWS = 5_000
OVERHEAD = 16
#: Bytes of a part of a mixed table, and the most (source, part) stretches.
PART_BYTES = 64_000_000
MAX_STRETCHES = 2_000_000


def one_period(weights: list[int]) -> list[int]:
    """The source (by index) of each slot of one period; earliest deadline
    first, ties to the earlier source. Weights are positive whole numbers."""
    period = sum(weights)
    released = [[] for _ in range(period)]
    for i, a in enumerate(weights):
        for k in range(a):
            released[k * period // a].append((-(-(k + 1) * period // a), i))
    ready: list[tuple[int, int]] = []
    slots = []
    for t in range(period):
        for job in released[t]:
            heapq.heappush(ready, job)
        deadline, i = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        slots.append(i)
    return slots


def tempered_weights(sizes: dict, power: float = 0.7, period: int = 1000) -> dict:
    """Whole-number weights in proportion to size ** power, at least 1, of a sum near ``period``."""
    raw = {s: max(b, 1) ** power for s, b in sizes.items()}
    total = sum(raw.values()) or 1.0
    out = {s: max(1, round(period * r / total)) for s, r in raw.items()}
    g = reduce(gcd, out.values(), 0) or 1
    return {s: a // g for s, a in out.items()}


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + OVERHEAD


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    """63 bits that put a source's rows in order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))), 1)


class _Law:
    """The slots of every source: order of sources, shares, places in a period."""

    def __init__(self, facts: list, weights: dict | None):
        if len(facts) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
        if weights is None:
            weights = tempered_weights({r["__wg_source"]: r["b"] for r in facts})
        missing = [r["__wg_source"] for r in facts if r["__wg_source"] not in weights]
        if missing:
            raise ValueError(f"no weight for source {missing[0]!r}")
        self.order = sorted(weights, key=lambda s: (s is not None, s))
        if any(int(weights[s]) != weights[s] or weights[s] < 1 for s in self.order):
            raise ValueError("weights must be positive whole numbers")
        g = reduce(gcd, (int(weights[s]) for s in self.order), 0) or 1
        self.shares = [int(weights[s]) // g for s in self.order]
        self.period = sum(self.shares)
        if self.period > MAX_PERIOD:
            raise ValueError(f"the weights sum to {self.period}; at most {MAX_PERIOD} is allowed")
        self.places: list[list[int]] = [[] for _ in self.order]
        for t, i in enumerate(one_period(self.shares)):
            self.places[i].append(t)

    def add_slots(self, df: DataFrame, block_bytes: int) -> DataFrame:
        """``df`` (__wg_source, before) with block and slot."""
        kind = df.schema["__wg_source"].dataType.simpleString()
        # One row a source, at most MAX_PERIOD places in all.
        table = df.sparkSession.createDataFrame(list(zip(self.order, self.shares, self.places)), f"s {kind}, a long, places array<int>")
        slot = F.floor(F.col("block") / F.col("a")).cast("long") * self.period + F.expr("get(places, cast(block % a as int))")
        return (
            df.join(F.broadcast(table), F.col("__wg_source").eqNullSafe(F.col("s")))
            .withColumn("block", F.floor(F.col("before") / F.lit(block_bytes)).cast("long")).withColumn("slot", slot).drop("s", "a", "places")
        )


def _planned(docs: DataFrame, weights: dict | None, id_col: str, source_col: str, text_col: str, block_bytes: int, seed: int) -> tuple[DataFrame, _Law]:
    """A narrow row per row of ``docs`` with its place: id, source, size, hash,
    ``first`` (bytes of the source ahead of all rows of that hash), ``before``, block, slot."""
    sized = docs.select(
        F.col(id_col).alias("__wg_id"), F.col(source_col).alias("__wg_source"), _size(text_col).alias("__wg_size"), _hash(id_col, text_col, seed).alias("__wg_h"),
    )
    facts = sized.groupBy("__wg_source").agg(F.count("*").alias("n"), F.sum("__wg_size").alias("b")).limit(MAX_SOURCES + 1).collect()
    law = _Law(facts, weights)
    ranges = max(1, -(-max([r["n"] for r in facts], default=0) // RANGE_ROWS))
    # Bytes ahead of each hash range of a source: at most sources x ranges rows.
    span = (F.shiftrightunsigned("__wg_h", 32) * F.lit(ranges) / F.lit(2**31)).cast("long")
    ranged = sized.withColumn("__wg_range", span)
    heads = ranged.groupBy("__wg_source", "__wg_range").agg(F.sum("__wg_size").alias("__wg_b"))
    ahead = heads.select(
        F.col("__wg_source").alias("s2"), F.col("__wg_range").alias("r2"),
        (F.sum("__wg_b").over(Window.partitionBy("__wg_source").orderBy("__wg_range")) - F.col("__wg_b")).alias("__wg_ahead"),
    )
    group = Window.partitionBy("__wg_source", "__wg_range").orderBy("__wg_h")
    none = F.lit(0)
    inner = ranged.withColumns({
        "__wg_in": F.coalesce(F.sum("__wg_size").over(group.rowsBetween(Window.unboundedPreceding, -1)), none),
        "__wg_eq": F.coalesce(F.sum("__wg_size").over(group.rangeBetween(Window.unboundedPreceding, -1)), none),
    })
    placed = inner.join(ahead, F.col("__wg_source").eqNullSafe(F.col("s2")) & (F.col("__wg_range") == F.col("r2"))).withColumns({
        "before": F.col("__wg_ahead") + F.col("__wg_in"), "first": F.col("__wg_ahead") + F.col("__wg_eq"),
    })
    return law.add_slots(placed, block_bytes), law


def schedule(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", block_bytes: int = BLOCK_BYTES, seed: int = 11,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, block, slot and ``before``
    (bytes of the source ahead of it). Texts are not shuffled.

    ``weights`` maps every source to a positive whole number; by default it
    follows the sources' sizes (:func:`tempered_weights`).
    """
    placed, _ = _planned(docs, weights, id_col, source_col, text_col, block_bytes, seed)
    return placed.select(F.col("__wg_id").alias(id_col), F.col("__wg_source").alias(source_col), F.col("__wg_size").alias("size"), "block", "slot", "before")


def mix(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, seed: int = 11, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs``, in the order of the schedule: partition
    after partition, and row after row in each."""
    names = docs.columns
    planned, law = _planned(docs, weights, id_col, source_col, text_col, block_bytes, seed)
    number = {s: i for i, s in enumerate(law.order)}
    planned = materialize(planned.select("__wg_source", "__wg_h", "first", "__wg_size", "slot"), "mix-plan")
    filled = planned.groupBy("slot").agg(F.sum("__wg_size").alias("b"))
    total = filled.agg(F.sum("b").alias("b")).first()["b"]
    if total is None:
        return docs
    parts = max(1, min(-(-total // part_bytes), MAX_STRETCHES // max(1, len(law.order))))
    cuts: list[int] = []
    if parts > 1:
        # Slots hold about a block each, so equal numbers of filled slots have about equal bytes.
        cuts = filled.agg(F.percentile_approx("slot", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("c")).first()["c"]

    @F.pandas_udf("int")
    def part_of(slots: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, dtype=np.int64), slots.to_numpy(), side="right").astype(np.int32))

    # At most MAX_STRETCHES rows: where each source's hashes enter each part.
    starts: dict[int, list[tuple[int, int, int]]] = {i: [] for i in number.values()}
    for r in planned.groupBy("__wg_source", part_of("slot").alias("p")).agg(F.min(F.struct("__wg_h", "first")).alias("m")).collect():
        starts[number[r["__wg_source"]]].append((r["m"]["__wg_h"], r["p"], r["m"]["first"]))
    drop_scratch(planned)
    stretches = docs.sparkSession.sparkContext.broadcast({i: np.array(sorted(v), dtype=np.int64) for i, v in starts.items()})

    @F.pandas_udf("part int, ahead long")
    def place(sources: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        h = hashes.to_numpy()
        out = np.zeros((len(h), 2), dtype=np.int64)
        at, values = pd.factorize(sources)
        codes = np.array([*(number[v] for v in values), number.get(None, -1)])[at]
        for i in np.unique(codes):
            rows_, table = codes == i, stretches.value[i]
            out[rows_] = table[np.searchsorted(table[:, 0], h[rows_], side="right") - 1, 1:]
        return pd.DataFrame({"part": out[:, 0].astype(np.int32), "ahead": out[:, 1]})

    kept = [F.col(f"`{c}`").alias(f"__wg_keep_{i}") for i, c in enumerate(names)]
    rows = docs.select(*kept, F.col(source_col).alias("__wg_source"), _size(text_col).alias("__wg_size"), _hash(id_col, text_col, seed).alias("__wg_h"))
    rows = rows.withColumn("__wg_at", place("__wg_source", "__wg_h")).withColumn("__wg_part", F.col("__wg_at.part"))
    rows = rows.repartitionById(parts, F.col("__wg_part"))
    within = Window.partitionBy("__wg_part", "__wg_source").orderBy("__wg_h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("__wg_at.ahead") + F.coalesce(F.sum("__wg_size").over(within), F.lit(0)))
    return law.add_slots(rows, block_bytes).sortWithinPartitions("slot", "before").select(*[F.col(f"__wg_keep_{i}").alias(c) for i, c in enumerate(names)])

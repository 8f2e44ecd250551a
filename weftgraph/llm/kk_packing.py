"""Packing by Karmarkar-Karp multiway differencing.

A document's ids (its tokens and an end id) are cut into windows of the full
length while they last; the rest is cut into near-equal pieces of at most
``piece`` ids. Pieces are gathered into bounded groups in reading order and
each group is split over k windows, k being the least number that could hold
it: partial partitions are merged two by two, the largest loads of one with the
smallest of the other, always the two of largest imbalance first. If a window
comes out over the capacity, k rises by one and the group is split again.

Groups never leave their input partition, so there is no shuffle and memory is
bounded by one group. Sequence ids are (input partition, running number). Spark
reads files by descending length, so where the order of the rows lies in part
files (``by_file``) the ids are (part number, first row of a stretch that was
read on end, running number) and a group ends with its stretch: in the order of
the ids, sequences follow the order in which the rows were written.
Null or empty text is one piece, the end id; a very long text is cut into windows
as it comes; rows repeated in the input, or of one id, are packed as often; sets of
equal load are ordered by when they were formed; null ids are values like any other;
columns besides id and text are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_file
from .wordcache import encoder

CAPACITY = 2048
PIECE = 512
GROUP_WINDOWS = 128
END_ID = 1
#: Bits of a sequence id by file: part number, first row, running number.
PART_BITS, ROW_BITS, RUN_BITS = 18, 26, 19
PART_FILE = re.compile(r"^part-(\d+)-.*-c0+\.")


def differencing(weights: list[int], k: int) -> list[tuple[int, tuple]]:
    """Split ``weights`` over ``k`` sets of near-equal sums: (sum, indices) each.

    Partial partitions are ascending lists of (load, members); missing entries
    are empty sets. Ties fall to the earlier formed partition.
    """
    heap = [(-w, i, [(w, (i,))]) for i, w in enumerate(weights)]
    if k == 1:
        return [(sum(weights), tuple(range(len(weights))))]
    heapq.heapify(heap)
    made = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            c = sorted(a + b)
        else:
            low = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[:over], b[over - 1 :: -1])]
            c = sorted(low + a[over:] + b[over:])
        spread = c[-1][0] - (c[0][0] if len(c) == k else 0)
        heapq.heappush(heap, (-spread, made, c))
        made += 1
    return heap[0][2]


def split_group(weights: list[int], capacity: int) -> list[tuple[int, tuple]]:
    """Differencing with as many sets as the capacity asks for."""
    k = -(-sum(weights) // capacity)
    while True:
        parts = differencing(weights, k)
        if parts[-1][0] <= capacity:
            return parts
        k += 1


def cut(n: int, capacity: int, piece: int) -> tuple[int, list[int]]:
    """Full windows and the lengths of the rest's pieces for ``n`` ids."""
    full, rest = divmod(n, capacity)
    if not rest:
        return full, []
    m = -(-rest // piece)
    return full, [rest // m + (i < rest % m) for i in range(m)]


def in_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a plain read of numbered part files, so that their numbers
    and the rows' numbers in them give the order in which the rows were written."""
    if docs._jdf.queryExecution().analyzed().children().nonEmpty():
        return False
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return False
    return all(PART_FILE.match(f.rsplit("/", 1)[-1]) for f in docs.inputFiles())


def first_id(part: int | None, row: int) -> int:
    """The least sequence id of a stretch of rows."""
    if part is None or part >> PART_BITS or row >> ROW_BITS:
        raise ValueError(f"no sequence id for row {row} of part {part}")
    return (part << ROW_BITS | row) << RUN_BITS


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, end_id: int = END_ID,
    with_ids: bool = False, by_file: bool = False,
) -> DataFrame:
    """One row per piece: document, start, length, crc32 of the ids, ids of the
    document, sequence and offset there; with ``with_ids`` the ids themselves.
    With ``by_file`` sequences are numbered by part file and row."""
    path = tokenizer or tokenizer_file("byte_bpe_50k.json")
    limit = group_windows * capacity
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        base = TaskContext.get().partitionId() << 36
        after: tuple | None = None  # the place that goes on from the last row
        sequences = 0
        waiting: list[tuple] = []  # (doc, start, piece, doc_tokens)
        held = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, pieces, total, seq, offset = zip(*rows)
            length, crc, raw = zip(*pieces)
            cols = [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(total, pa.int64()),
                    pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        def piece_of(raw: bytes, at: int, n: int) -> tuple[int, int, bytes | None]:
            """Length, checksum and, where they are wanted, the ids: waiting pieces hold no more."""
            part = raw[4 * at : 4 * (at + n)]
            return n, zlib.crc32(part), part if with_ids else None

        def close() -> list[tuple]:
            nonlocal sequences
            rows = []
            for _, members in split_group([w[2][0] for w in waiting], capacity):
                at = 0
                for i in members:
                    doc, start, part, total = waiting[i]
                    rows.append((doc, start, part, total, base + sequences, at))
                    at += part[0]
                sequences += 1
            return rows

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            rows: list[tuple] = []
            places = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if by_file else repeat(None)
            for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), places):
                if place:
                    if place != after:
                        if waiting:
                            rows += close()
                            waiting, held = [], 0
                        base, sequences = first_id(*place), 0
                    elif sequences >> (RUN_BITS - 1):
                        raise ValueError(f"too many sequences in part {place[0]}")
                    after = (place[0], place[1] + 1)
                raw = enc.encode(text.as_py()) + end
                n = len(raw) // 4
                full, rest = cut(n, capacity, piece)
                at = 0
                for _ in range(full):
                    rows.append((doc, at, piece_of(raw, at, capacity), n, base + sequences, 0))
                    sequences += 1
                    at += capacity
                for m in rest:
                    waiting.append((doc, at, piece_of(raw, at, m), n))
                    held += m
                    at += m
                if held >= limit:
                    rows += close()
                    waiting, held = [], 0
                if len(rows) > 5_000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)
        if waiting:
            yield emit(close())

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    part = F.regexp_extract("_metadata.file_name", PART_FILE.pattern, 1)
    place = [F.nullif(part, F.lit("")).cast("int").alias("part"), F.col("_metadata.row_index").alias("row")] if by_file else []
    return docs.select(id_col, text_or_empty(text_col).alias("text"), *place).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else "")
    )

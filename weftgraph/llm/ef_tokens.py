"""Token output: concatenated id arrays with Elias-Fano document boundaries.

Documents are put in ascending order of id by range partitions whose cut points
come from the id column alone (so texts are encoded once), and every partition
writes files of bounded size. A file holds one id array and, as Elias-Fano
sequences, the ends of its documents and their ids: low bits packed, high bits
as a unary bit vector, and a sample of select positions. ``select`` finds
boundaries from the samples; files are read back a stretch of documents at a
time, the boundaries by ``select`` and the ids by ranges of the file, so no table
of 64-bit offsets is ever made, in the file or in memory.

Files are written to a temporary name and renamed, with content that depends on
the rows alone, so a task that runs twice leaves one whole file. Null ids sort
first; null or empty text is an empty document (its end id); a very long text is
one document whatever its length, in a file of its own size at most longer than
the others; rows of equal id are separate documents, ordered by their ids' hash;
columns besides id and text are ignored, whatever their names; an empty table
gives no file and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, text_or_empty, tokenizer_file
from .wordcache import encoder

MAGIC = b"WGEF0002"
#: magic, null document ids, documents, ids, id width, least document id
HEADER = struct.Struct("<8sQQQIq")
#: values, low bits, sample step, bytes of high bits
SEQUENCE = struct.Struct("<QIIQ")
SAMPLE = 256
#: Ids per file; one file is held in memory by its writer.
FILE_IDS = 4_000_000
#: Bytes of text per output partition.
PARTITION_BYTES = 48_000_000
#: Texts, and bytes of ids, that the encoder holds at once.
SLICE_TEXTS, SLICE_BYTES = 256, 4_000_000
#: Documents that the reader decodes at once.
READ_DOCS = 1024
END_ID = 1


class EliasFano:
    """A non-decreasing sequence below ``universe + 1`` in about 2 + log2(u/n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, step: int):
        self.n, self.low_bits, self.low, self.high, self.samples, self.step = n, low_bits, low, high, samples, step

    @classmethod
    def build(cls, values: np.ndarray, step: int = SAMPLE) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = min(62, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(n + int(universe >> low_bits) + 1, dtype=np.uint8)
        places = high + np.arange(n)
        bits[places] = 1
        lows = values & np.uint64((1 << low_bits) - 1)
        flat = ((lows[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(flat, bitorder="little"), np.packbits(bits, bitorder="little"),
                   places[::step].astype("<u4"), step)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64)
        return (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int, j: int | None = None) -> np.ndarray | int:
        """The ``i``-th value, or those from the ``i``-th to before the ``j``-th. Only
        the high bits between the samples around them are read."""
        one, j = j is None, i + 1 if j is None else j
        first, last = i // self.step, (j - 1) // self.step + 1
        lo = int(self.samples[first]) >> 3
        hi = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[lo:hi], bitorder="little")) + 8 * lo
        places = places[np.searchsorted(places, int(self.samples[first])) :][i - first * self.step : j - first * self.step]
        ranks = np.arange(i, j)
        out = ((places - ranks).astype(np.uint64) << np.uint64(self.low_bits)) + self._low(ranks)
        return int(out[0]) if one else out

    def tobytes(self) -> bytes:
        head = SEQUENCE.pack(self.n, self.low_bits, self.step, len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, source) -> EliasFano:
        """The sequence at the current place of a file."""
        n, low_bits, step, n_high = SEQUENCE.unpack(source.read(SEQUENCE.size))

        def take(count: int, dtype: str) -> np.ndarray:
            return np.frombuffer(source.read(count * np.dtype(dtype).itemsize), dtype)

        return cls(n, low_bits, take((n * low_bits + 7) // 8, "u1"), take(n_high, "u1"), take(-(-n // step), "<u4"), step)


def write_file(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of one file: header, document ids (ascending, nulls first) and
    boundaries as Elias-Fano sequences, id array."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids) - len(known), len(doc_ids), len(ids), ids.dtype.itemsize, least),
        # Differences wrap around in 64 bits, so any range of ids fits.
        EliasFano.build(known.astype(np.uint64) - np.int64(least).astype(np.uint64)).tobytes(),
        EliasFano.build(ends).tobytes(), ids.tobytes(),
    ])


def read_file(source, docs: int = READ_DOCS) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Stretches of at most ``docs`` documents of one open file: their ids, their
    boundaries (one more than documents) and the ids between the outer ones."""
    magic, nulls, n, _, width, least = HEADER.unpack(source.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    names, ends = EliasFano.read(source), EliasFano.read(source)
    at, before = source.tell(), 0
    for i in range(0, n, docs):
        j = min(i + docs, n)
        bounds = np.concatenate([[before], ends.select(i, j).astype(np.int64)])
        source.seek(at + before * width)
        ids = np.frombuffer(source.read((int(bounds[-1]) - before) * width), f"<u{width}")
        before = int(bounds[-1])
        doc_ids: list = [None] * max(0, min(j, nulls) - i)
        if j > nulls:
            raw = names.select(max(i, nulls) - nulls, j - nulls) + np.int64(least).astype(np.uint64)
            doc_ids += raw.astype(np.int64).tolist()
        yield doc_ids, bounds, ids


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def file_name(pid: int, seq: int) -> str:
    return f"tokens-{pid:06d}-{seq:06d}.ef"


def _put(folder: str, name: str, attempt: int, raw: bytes) -> None:
    store, path = _store(folder)
    store.create_dir(path)
    part = f"{path}/_{name}.{attempt}"
    with store.open_output_stream(part) as out:
        out.write(raw)
    store.move(part, f"{path}/{name}")


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = END_ID, file_ids: int = FILE_IDS, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Write ``docs`` to ``folder`` and return the manifest: a row per file."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_file("word_bpe_49k.json")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = src.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(size) // partition_bytes), min(spark.sparkContext.defaultParallelism, int(size) // 2_000_000))
    cuts: list[int] = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        cuts = src.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * parts)).alias("c")).first()["c"] or []

    # Known to the driver, so that no writer loads a vocabulary.
    width = "<u2" if encoder(path).tok.get_vocab_size() <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=width).tobytes()
        bounds = np.array(cuts, dtype=np.int64)

        def emit(ids: pa.Array, raw: list[bytes]) -> pa.RecordBatch:
            part = np.searchsorted(bounds, np.array(ids.fill_null(-(2**63))), side="right")
            return pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(part, pa.int32())], names=["doc_id", "raw", "part"])

        for batch in batches:
            ids, texts = batch.columns
            raw: list[bytes] = []
            at = held = 0
            for i in range(len(ids)):
                raw.append(np.frombuffer(enc.encode(texts[i].as_py()), "<u4").astype(width).tobytes() + end)
                held += len(raw[-1])
                if len(raw) == SLICE_TEXTS or held > SLICE_BYTES:
                    yield emit(ids.slice(at, len(raw)), raw)
                    at, raw, held = i + 1, [], 0
            if raw:
                yield emit(ids.slice(at), raw)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        pid, seq = context.partitionId(), 0
        names: list = []
        raws: list[bytes] = []
        held = 0
        for batch in batches:
            docs_, ids = batch.columns
            for i in range(len(docs_)):
                names.append(docs_[i].as_py())
                raws.append(ids[i].as_py())
                held += len(raws[-1])
                if held >= file_ids * int(width[-1]):
                    yield flush(context, pid, seq, names, raws)
                    names, raws, held, seq = [], [], 0, seq + 1
        if names:
            yield flush(context, pid, seq, names, raws)

    def flush(context, pid, seq, names, raws) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(raws), width)
        ends = np.cumsum([len(r) // int(width[-1]) for r in raws])
        _put(folder, file_name(pid, seq), context.taskAttemptId(), write_file(names, ids, ends))
        row = {"pid": pid, "seq": seq, "n_docs": len(names), "n_ids": len(ids)}
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row.values()], names=list(row))

    placed = (
        src.mapInArrow(encode, "doc_id long, raw binary, part int")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("raw"))
        .select("doc_id", "raw")
    )
    return materialize(placed.mapInArrow(store, "pid long, seq long, n_docs long, n_ids long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: id, start in the whole id stream,
    number of ids, crc32 of the ids as little-endian unsigned 32-bit integers."""
    by_part = manifest.groupBy("pid").agg(F.sum("n_ids").alias("ids"))
    before = by_part.select("pid", (F.sum("ids").over(Window.orderBy("pid")) - F.col("ids")).alias("before"))
    starts = manifest.join(before, "pid").select(
        "pid", "seq", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("pid").orderBy("seq")) - F.col("n_ids")).alias("first")
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    parts = manifest.agg(F.max("pid").alias("m")).first()["m"]
    if parts is None:
        return spark.createDataFrame([], schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for pid, seq, first in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{base}/{file_name(pid, seq)}") as source:
                    for doc_ids, bounds, ids in read_file(source):
                        wide = ids.astype("<u4")
                        near = bounds - bounds[0]
                        crc = [zlib.crc32(wide[s:e]) for s, e in zip(near, near[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + first, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                             pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("pid", "seq", "first").repartitionById(parts + 1, F.col("pid").cast("int")).mapInArrow(decode, schema)


def token_output(docs: DataFrame, **options) -> DataFrame:
    """Write to a new folder in the shared scratch space and read the files back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    return read_tokens(spark, folder, write_tokens(docs, folder, **options))

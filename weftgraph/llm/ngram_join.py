"""N-gram Jaccard join: documents whose shingle sets overlap by a given share.

A document's set holds the distinct 64-bit hashes of its n-word shingles. Equal
sets form one class, and one representative stands for it. Candidates share a
tile: a size band (sizes within the threshold's ratio lie in the same or the
next band) and a shingle of both prefixes in one global order, rarest first, so
that passages many documents share come last; what the sets hold from that
shingle on must suffice for the overlap. Rarity is read off a count sketch
of fixed size over all documents; its errors change the order, never the result.

A candidate pair first meets its hashed bitmaps, whose width follows the set's
size: every differing bit stands for an element that only one set has, which
bounds the overlap from above. What passes is settled by intersecting the exact
sorted arrays, recomputed from the texts that are still in question.

Links only matter for components here, so a tile is not expanded into all its
pairs: in a round or two every document meets one leader of its tiles, and linked
documents merge. Whatever still shares a tile across components afterwards is
compared pair by pair, without a cap; a pair is left out only where the bitmap
shows one side too far from a leader (Jaccard distance is a metric) that the
other is linked to.

Null, empty or wordless text has an empty set and links with nothing; a very long
text is hashed in stretches and its set held whole; equal texts link with each
other; rows repeated in the input get the same component; of a component's ids the
least names it, null ids only where it has no other; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from .common import drop_scratch, materialize, release, scratch, small_batches, text_or_empty
from .texthash import shingle_set

WORDS = 4
NUM, DEN = 85, 100
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
ROUNDS = 2
#: Pairs per document under which the pairwise phase starts without further rounds of
#: leaders. The phase is exact either way; this only chooses the cheaper order of work.
PAIRS_PER_ROW = 50
#: Buckets of the filter that thins the texts before their join (a bound on its rows).
FILTER_BUCKETS = 1 << 18
#: Pairs of one leader that a task compares before the next task takes over.
LEADER_PAIRS = 2_000


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that few sets are held at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def digest(s: np.ndarray) -> tuple[int, int]:
    h = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def sketch(texts: DataFrame, words: int, bits: int) -> np.ndarray:
    """Counts of shingles by hash slot over all documents (2**bits numbers).

    Tasks emit the non-empty blocks of their counts; blocks are summed by block
    number, so nothing but the fixed-size result reaches the driver.
    """
    size = 1 << bits
    block = min(SKETCH_BLOCK, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        held: list[np.ndarray] = []
        n = 0

        def add() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=size)

        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                s = shingle_set(_raw(text), words)
                held.append((s & np.uint64(size - 1)).astype(np.int64))
                n += len(s)
                if n > 500_000:
                    add()
                    held.clear()
                    n = 0
        add()
        for i in range(0, size, block):
            part = total[i : i + block]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([part.astype("<u4").tobytes()], pa.binary())], names=["at", "counts"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, "<u4").astype(np.uint64)
                sums[at] = sums[at] + x if at in sums else x
        for at, x in sums.items():
            x = np.minimum(x, 2**32 - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "counts"])

    schema = "at long, counts binary"
    spread = max(1, min(size // block, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    with small_batches(texts.sparkSession):
        rows = texts.mapInArrow(count, schema).repartition(spread, "at").mapInArrow(merge, schema).collect()
    out = np.zeros(size, dtype=np.uint32)
    for r in rows:
        out[r["at"] : r["at"] + block] += np.frombuffer(bytes(r["counts"]), "<u4")
    return out


def bitmap_words(n: int) -> int:
    """64-bit words of the bitmap of a set of ``n``: at least two bits an element."""
    return 1 << max(0, math.ceil(math.log2(max(n, 1) / 32)))


def bitmap(s: np.ndarray) -> np.ndarray:
    w = bitmap_words(len(s))
    at = ((s >> np.uint64(20)) & np.uint64(w * 64 - 1)).astype(np.int64)
    flags = np.zeros(w * 64, dtype=np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """The most elements that two sets can share, from their bitmaps."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return (na + nb - int(np.bitwise_count(a ^ b).sum())) // 2


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, bits: int) -> DataFrame:
    """uid, id, size, digest, prefix shingles in rarest-first order, length of the
    index prefix and bitmap, one row per row of ``docs``."""
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(sketch(src.select("text"), words, bits))
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in _slices(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingle_set(_raw(text), words)
                n = len(s)
                if not n:
                    row = (0, 0, 0, [], 0, b"")
                else:
                    p = n - (-(-num * n // den)) + 1
                    order = np.lexsort((s, table[(s & mask).astype(np.int64)]))[:p]
                    ip = n - (-(-2 * num * n // (den + num))) + 1
                    row = (n, *digest(s), s[order].view(np.int64), ip, bitmap(s).tobytes())
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n", "d1", "d2", "keys", "ip", "bits"]
            )

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, keys array<long>, ip int, bits binary")
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "ngram-profiles")


def bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b, na, nb, abits, bbits) with ``maybe`` (the bound allows a
    link) and ``far`` (no member linked to one can be linked to the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            maybe, far = [], []
            for n1, n2, p, q in zip(na, nb, x, y):
                o = overlap_bound(np.frombuffer(p, "<u8"), n1, np.frombuffer(q, "<u8"), n2)
                union = n1 + n2 - o
                maybe.append(den * o >= num * union)
                # distance over twice the largest linked distance: 1 - o/union > 2 (1 - num/den)
                far.append(den * (union - o) > 2 * (den - num) * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maybe), pa.array(far)], names=["a", "b", "maybe", "far"])

    return pairs.select("a", "b", "na", "nb", "abits", "bbits").mapInArrow(run, "a long, b long, maybe boolean, far boolean")


def with_bitmaps(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    side = reps.select("uid", "n", "bits")
    return pairs.join(side.toDF("a", "na", "abits"), "a").join(side.toDF("b", "nb", "bbits"), "b")


def exact(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), by intersecting sorted arrays.

    Arrays are recomputed from the texts of the documents in question. Pairs are
    laid out by ``a`` (split where it has many) with its array ahead of theirs,
    so an array travels once per document and pair, and a task holds two.
    """
    nodes = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    wanted = materialize(reps.join(nodes, "uid", "left_semi").select("uid", "id", "d1", "d2"), "ngram-wanted")
    bucket = F.pmod(F.xxhash64(F.col("id")), F.lit(FILTER_BUCKETS))
    buckets = wanted.select(bucket.alias("bucket")).distinct()
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("bucket", bucket)
    # At most FILTER_BUCKETS rows of one number each.
    texts = src.join(F.broadcast(buckets), "bucket", "left_semi").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(_raw(t), words) for t in batch.column(1).to_pylist()]
            marks = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["id", "d1", "d2", "items"])

    kind = src.schema["id"].dataType.simpleString()
    sets = (
        texts.mapInArrow(run, f"id {kind}, d1 long, d2 long, items binary").alias("s")
        .join(wanted.alias("w"), (F.col("s.d1") == F.col("w.d1")) & (F.col("s.d2") == F.col("w.d2")) & F.col("s.id").eqNullSafe(F.col("w.id")))
        .select("uid", "items")
    )
    sets = materialize(sets, "ngram-sets")
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(LEADER_PAIRS)).cast("int").alias("parts"))
    laid = (
        pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(sets.withColumnRenamed("uid", "b"), "b").select("a", "part", "b", "items")
    )
    heads = (
        degree.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(sets.withColumnRenamed("uid", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "items")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, items = None, None
        for batch in batches:
            out = []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = np.frombuffer(raw.as_buffer(), "<u8")
                if b is None:
                    head, items = a, x.copy()
                elif head == a:
                    inter = len(np.intersect1d(items, x, assume_unique=True))
                    if den * inter >= num * (len(items) + len(x) - inter):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = (
        heads.unionByName(laid).repartition(spread, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        .mapInArrow(meet, "a long, b long")
    )
    linked = materialize(linked, "ngram-linked")
    drop_scratch(sets, wanted)
    return linked


def components(edges: DataFrame) -> DataFrame:
    """(uid, comp): the least uid reachable, for every node of ``edges`` (a, b)."""
    found = graph.components(edges.toDF("src", "dst"), keep=lambda df: materialize(df, "ngram-links"))
    return materialize(found.toDF("uid", "comp"), "ngram-labels")


def _tiles(reps: DataFrame) -> DataFrame:
    """A row per prefix shingle of each representative: key, uid, and size and
    position in one number (the rows are many and shuffled twice)."""
    rows = reps.select("uid", "n", F.posexplode("keys").alias("pos", "key"))
    return rows.select("key", "uid", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))


def _spread(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Tile rows with size, position, band and whether the shingle is in the
    shorter prefix that the smaller side of a pair needs."""
    n = F.shiftright("np", 32)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    index = F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(den + num)) + 1
    return rows.select("key", "uid", n.alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")).withColumns({"band": band, "idx": F.col("pos") < index})


def _enough(na: str, pa: str, nb: str, pb: str, num: int, den: int):
    """Sizes fit, and the elements from the shared shingle on can make the overlap.

    At the first shingle that two linked sets share this always holds.
    """
    a, b = F.col(na), F.col(nb)
    rest = F.least(a - F.col(pa), b - F.col(pb))
    return (a * den >= b * num) & (b * den >= a * num) & (rest * (den + num) >= (a + b) * num)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN,
         sketch_bits: int = SKETCH_BITS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: uid, id, size of the set and component
    (the least id linked with it, directly or not)."""
    prof = profiles(docs, id_col, text_col, words, num, den, sketch_bits)
    some = prof.filter("n > 0")
    classes = some.groupBy("d1", "d2").agg(F.min("uid").alias("rep"), F.min("id").alias("least"))
    reps = some.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    tiles = _tiles(reps)
    # Keys of two or more representatives; counted before the shuffle.
    shared = tiles.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    rows = _spread(materialize(tiles.join(shared, "key"), "ngram-tiles"), num, den)
    del tiles, shared
    release(docs.sparkSession)
    total = prof.count()
    edges = None
    comp = None
    fars: list[DataFrame] = []
    open_rows = rows.withColumn("comp", F.col("uid"))
    for r in range(rounds):
        # Leaders of every tile and of the tile one band up: first those with the fewest
        # rarer shingles, which stand nearest to what the tile shares; then by a hash.
        rank = F.col("pos") if r == 0 else F.lit(0)
        lead = open_rows.groupBy("key", "band").agg(
            F.min(F.struct(rank.alias("r"), F.xxhash64(F.lit(r), F.col("uid")).alias("h"), F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))).alias("l")
        )
        lead = lead.select("key", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "l")
        met = open_rows.join(lead, ["key", "band"]).filter((F.col("uid") != F.col("l.b")) & (F.col("comp") != F.col("l.cb")))
        met = met.select(F.col("uid").alias("a"), "n", "pos", "l").filter(_enough("n", "pos", "l.nb", "l.pb", num, den))
        pairs = met.groupBy("a").agg(F.min("l").alias("l")).select("a", F.col("l.b").alias("b"))
        seen = materialize(bounded(with_bitmaps(pairs, reps), num, den), "ngram-bounded")
        # Laid out by the leader, of which there are fewer.
        linked = exact(seen.filter("maybe").select(F.col("b").alias("a"), F.col("a").alias("b")), reps, docs, id_col, text_col, words, num, den)
        fars.append(seen.filter("far").select("a", "b"))
        edges = linked if edges is None else edges.unionByName(linked)
        comp = components(edges)
        open_rows = rows.join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
        mixed = open_rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        open_rows = materialize(open_rows.join(mixed, "key").select(*rows.columns, "comp"), "ngram-open")
        release(docs.sparkSession)
        # Few enough pairs left to compare them all at once.
        sizes = open_rows.groupBy("key", "band", "comp").agg(F.count("*").alias("c")).groupBy("key", "band").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("s"))
        left = sizes.agg(F.sum(F.col("t") * F.col("t") - F.col("s"))).first()[0] or 0
        if left <= PAIRS_PER_ROW * total or linked.isEmpty():
            break
    # What still shares a tile across components, pair by pair. Each pair is
    # formed in the band of its smaller side; equal sizes order by uid.
    small = open_rows.filter("idx").select("key", "band", F.col("uid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    large = open_rows.select(
        "key", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb")
    )
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    rest = small.join(large, ["key", "band"]).filter((F.col("ca") != F.col("cb")) & order & _enough("na", "pa", "nb", "pb", num, den))
    rest = rest.select("a", "b").distinct()
    # Both sides of a pair against the leaders that one is linked to and the other far from.
    near = edges.select(F.col("a").alias("leader"), F.col("b").alias("x"))
    far = None
    for f in fars:
        f = f.select(F.col("a").alias("y"), F.col("b").alias("leader"))
        far = f if far is None else far.unionByName(f)
    one_far = rest.join(far.withColumnRenamed("y", "a"), "a").join(near.withColumnRenamed("x", "b"), ["b", "leader"], "left_semi").select("a", "b")
    other = rest.join(far.withColumnRenamed("y", "b"), "b").join(near.withColumnRenamed("x", "a"), ["a", "leader"], "left_semi").select("a", "b")
    rest = materialize(rest.join(one_far.unionByName(other).distinct(), ["a", "b"], "left_anti"), "ngram-rest")
    if not rest.isEmpty():
        maybe = materialize(bounded(with_bitmaps(rest, reps), num, den).filter("maybe").select("a", "b"), "ngram-bounded")
        if not maybe.isEmpty():
            edges = edges.unionByName(exact(maybe, reps, docs, id_col, text_col, words, num, den))
            comp = components(edges)
    return _labelled(prof, classes, comp)


def _labelled(prof: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    named = classes.join(comp.select(F.col("uid").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("comp").alias("first_uid"))
    named = named.join(least, "comp").select("d1", "d2", "component_id", "comp")
    rows = prof.select("uid", "id", "n", "d1", "d2")
    return rows.join(named, ["d1", "d2"], "left").select(
        "uid", "id", "d1", "d2", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("uid")).alias("comp"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    with scratch() as keep:
        rows = keep(materialize(join(docs, id_col, **options).select(F.col("id").alias(id_col), "n_shingles", "component_id"), "ngram-components"))
    return rows


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """All columns of one row per component: a row of its least id. Wordless rows
    stay. Rows that share an id are told apart by the digest of their sets."""
    with scratch() as keep:
        linked = keep(materialize(join(docs, id_col, text_col, words=words, num=num, den=den), "ngram-components"))
    first = linked.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("uid"))).alias("m"))
    kept = linked.join(first.select(F.col("m.uid").alias("uid")), "uid", "left_semi")
    kept = kept.groupBy("id", "d1", "d2").agg(F.count("*").alias("keep"))
    per_id = linked.groupBy("id").agg(F.count("*").alias("n"))
    counts = kept.groupBy("id").agg(F.sum("keep").alias("k")).join(per_id.withColumnRenamed("id", "id2"), F.col("id").eqNullSafe(F.col("id2")))
    whole = counts.filter("k = n").select(F.col("id").alias("__wg_id"))
    split = materialize(counts.filter("k < n").select(F.col("id").alias("__wg_id")), "ngram-split-ids")
    names = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(id_col).eqNullSafe(F.col("__wg_id"))
    out = docs.join(whole, same, "left_semi").select(*names)
    if split.isEmpty():
        return out
    @F.pandas_udf("d1 long, d2 long")
    def mark(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(_raw(t), words) for t in texts]
        return pd.DataFrame([digest(s) if len(s) else (0, 0) for s in sets], columns=["d1", "d2"])

    some = docs.join(split, same, "left_semi").withColumn("__wg_d", mark(text_or_empty(text_col)))
    nth = F.row_number().over(Window.partitionBy(F.col(id_col), "__wg_d.d1", "__wg_d.d2").orderBy(F.xxhash64(F.col(text_col))))
    some = some.withColumn("__wg_nth", nth).alias("x").join(
        kept.alias("k"),
        F.col(f"x.{id_col}").eqNullSafe(F.col("k.id")) & (F.col("__wg_d.d1") == F.col("k.d1")) & (F.col("__wg_d.d2") == F.col("k.d2")),
    )
    some = some.filter("__wg_nth <= keep").select(*[F.col(f"x.`{c}`") for c in docs.columns])
    return out.unionByName(some)

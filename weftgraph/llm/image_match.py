"""Media columns: local image descriptors that find cropped or edited copies.

Greyscale images (binary PGM) get corners on several scales, each with an
orientation from its intensity centroid and 256 binary intensity tests turned by
it. Every corner that is the strongest within ``APART`` pixels of its scale is
kept, whatever their number. Each of ``TABLES`` tables takes ``KEY_BITS`` of the
256 bits as a key; images that meet a query in any key of any table are
candidates. Not every near pair of corners meets (the README gives the recall), but a
copy has many corners and one meeting is enough. A candidate's corners are then
all compared: those within ``MAX_BITS`` bits match, matches vote
on a similarity transform, and the pair counts if enough of them agree on one.

Keys of the index that no query has are left out before the shuffle by a bitmap of
fixed size, which never drops a key that a query has. No table, key or bucket is
capped; a frequent key is left to the engine's skew join, as its rows are pairs of
numbers. Images of equal content are indexed once. Near copies among the images form
classes without all their pairs: an image meets the leader that it shares most keys
with (of a key the first image in two hash orders leads), agreeing corners link the
two, and linked images are one class. A query then meets, for every key, one member
of each class, so the rows grow with queries and classes, not with their pairs.

Null or unreadable media have no descriptors and form a class of their own
kind; they match nothing. Flat images match by equal content only. Ties between
classes of equal consensus are all returned; repeated rows count as members of
their class; columns besides id and vector (or media) are ignored, whatever their
names; an image of any size is read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .common import drop_scratch, materialize, release, scratch

SIDE = 96
SCALES = (1.0, 1.5, 2.25)
#: A corner is the strongest within this many pixels of its scale.
APART = 4
RADIUS = 9
MAX_BITS = 30
#: Tables, and descriptor bits in a key.
TABLES, KEY_BITS = 24, 46
MIN_INLIERS = 5
#: Images that a task holds at once.
BLOCK_IMAGES = 8_192
#: Bits of the bitmap of query keys, and of one of its blocks.
FILTER_BITS, FILTER_BLOCK = 26, 20
#: One in so many keys elects leaders.
LEADER_KEYS = 8
#: Numbers in one step of the consensus.
STEP_CELLS = 1 << 20
#: Dimensions that have a texture of their own; further ones are folded onto these.
TEXTURES = 256
#: Rows with an id divisible by this are the queries.
QUERY_STEP = 20


def _tests(n: int = 256, apart: float = 2.0) -> np.ndarray:
    """Pairs of points (x, y, x, y) within a corner's radius, not too near each other."""
    p = np.random.default_rng(3).uniform(-RADIUS, RADIUS, (8 * n, 4))
    inside = (np.hypot(p[:, 0], p[:, 1]) <= RADIUS) & (np.hypot(p[:, 2], p[:, 3]) <= RADIUS)
    return np.rint(p[inside & (np.hypot(p[:, 0] - p[:, 2], p[:, 1] - p[:, 3]) >= apart)][:n])


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """The bits that each table's key takes from a descriptor, and odd factors to mix them."""
    rng = np.random.default_rng(7)
    flags = np.zeros((TABLES, 256), dtype=np.uint8)
    for row in flags:
        row[rng.choice(256, KEY_BITS, replace=False)] = 1
    return np.packbits(flags, axis=1, bitorder="little").view("<u8"), rng.integers(1, 2**63, (TABLES, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


TESTS = _tests()
MASKS, FACTORS = _masks()
_yy, _xx = np.mgrid[-7:8, -7:8]
_round = (_yy**2 + _xx**2) <= 49
DISC_Y, DISC_X = _yy[_round], _xx[_round]


def to_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def from_pgm(raw: bytes | None) -> np.ndarray | None:
    """The image, or None if the bytes are no whole binary greymap."""
    try:
        head, at = [], 0
        while len(head) < 4:
            while raw[at : at + 1].isspace():
                at += 1
            if raw[at : at + 1] == b"#":
                at = raw.index(b"\n", at)
                continue
            end = at
            while not raw[end : end + 1].isspace():
                end += 1
                if end > len(raw):
                    return None
            head.append(raw[at:end])
            at = end
        w, h = int(head[1]), int(head[2])
        if head[0] != b"P5" or int(head[3]) > 255 or len(raw) < at + 1 + w * h:
            return None
        return np.frombuffer(raw, np.uint8, w * h, at + 1).reshape(h, w).astype(np.float32)
    except (ValueError, IndexError, TypeError, AttributeError):
        return None


@lru_cache(maxsize=2)
def _textures(n: int) -> np.ndarray:
    """A fixed soft texture for each of ``n`` dimensions, of deviation 1."""
    coarse = np.random.default_rng(47).normal(size=(n, SIDE // 4, SIDE // 4))
    fine = np.array([_box(np.kron(c, np.ones((4, 4))), 1) for c in coarse], dtype=np.float32)
    return (fine / fine.std()).reshape(n, SIDE * SIDE)


def render(vectors: np.ndarray) -> np.ndarray:
    """An image of each vector (a row each): the sum of the dimensions' textures
    weighted by its values, so near vectors give near images. A vector without a
    direction gives a flat image."""
    v = np.nan_to_num(np.asarray(vectors, dtype=np.float32), posinf=0.0, neginf=0.0)
    n = v.shape[1]
    if n > TEXTURES:
        signs = np.random.default_rng(48).choice(np.array([-1, 1], dtype=np.float32), n)
        v = np.pad(v * signs, ((0, 0), (0, -n % TEXTURES))).reshape(len(v), -1, TEXTURES).sum(1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    field = unit @ _textures(v.shape[1]) if v.shape[1] else np.zeros((len(v), SIDE * SIDE))
    return np.rint(np.clip(128 + 45 * field, 0, 255)).reshape(len(v), SIDE, SIDE)


def edit(image: np.ndarray, seed: int) -> np.ndarray:
    """A cropped copy with other contrast, brightness and some noise; some are also
    turned by quarters or by a few degrees, or resized."""
    rng = np.random.default_rng(seed)
    h, w = image.shape
    keep_h, keep_w = (int(x * rng.uniform(0.72, 0.9)) for x in (h, w))
    y, x = rng.integers(0, h - keep_h + 1), rng.integers(0, w - keep_w + 1)
    kind = rng.integers(0, 5)
    angle = rng.uniform(-0.17, 0.17) if kind == 1 else 0.0
    by = rng.uniform(0.85, 1.2) if kind == 2 else 1.0
    out = _sampled(image, y, x, keep_h, keep_w, angle, by) if kind in (1, 2) else image[y : y + keep_h, x : x + keep_w]
    if kind == 3:
        out = np.rot90(out, int(rng.integers(1, 4)))
    out = out * rng.uniform(0.8, 1.15) + rng.uniform(-15, 15) + rng.normal(0, rng.uniform(0, 3), out.shape)
    return np.clip(np.rint(out), 0, 255)


def _sampled(a: np.ndarray, y: int, x: int, h: int, w: int, angle: float, by: float) -> np.ndarray:
    """The window (y, x, h, w) of an image, turned about its middle and resized."""
    oh, ow = max(1, round(h * by)), max(1, round(w * by))
    yy, xx = np.mgrid[:oh, :ow]
    dy, dx = (yy + 0.5) / by - h / 2, (xx + 0.5) / by - w / 2
    sy = (y + h / 2 - 0.5 + np.sin(angle) * dx + np.cos(angle) * dy).clip(0, a.shape[0] - 1)
    sx = (x + w / 2 - 0.5 + np.cos(angle) * dx - np.sin(angle) * dy).clip(0, a.shape[1] - 1)
    y0, x0 = sy.astype(int), sx.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = sy - y0, sx - x0
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2r + 1, edges repeated."""
    k = 2 * r + 1
    p = np.pad(a.astype(np.float64), r + 1, mode="edge")
    c = p.cumsum(0).cumsum(1)
    return ((c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) / (k * k))[: a.shape[0], : a.shape[1]]


def _highest(a: np.ndarray, k: int) -> np.ndarray:
    """Maximum of every ``k`` rows on end, by doubling."""
    have = 1
    while have < k:
        step = min(have, k - have)
        a = np.maximum(a[:-step], a[step:])
        have += step
    return a


def _resize(a: np.ndarray, by: float) -> np.ndarray:
    h, w = (max(1, int(round(x / by))) for x in a.shape)
    y, x = np.minimum((np.arange(h) + 0.5) * by - 0.5, a.shape[0] - 1).clip(0), np.minimum((np.arange(w) + 0.5) * by - 0.5, a.shape[1] - 1).clip(0)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = a[np.ix_(y0, x0)] * (1 - fx) + a[np.ix_(y0, x1)] * fx
    low = a[np.ix_(y1, x0)] * (1 - fx) + a[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in image coordinates and 4 x 64 bits each."""
    points, bits = [], []
    for by in SCALES:
        a = _resize(image, by) if by != 1 else image
        if min(a.shape) < 2 * RADIUS + 8:
            continue
        soft = _box(a, 1)
        gy, gx = np.gradient(soft)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = RADIUS + 3
        inner = r[edge:-edge, edge:-edge]
        if not inner.size or inner.max() <= 1e-6:
            continue
        view = r[edge - APART : r.shape[0] - edge + APART, edge - APART : r.shape[1] - edge + APART]
        around = _highest(_highest(view, 2 * APART + 1).T, 2 * APART + 1).T
        ys, xs = np.nonzero((inner == around) & (inner > 0.01 * inner.max()))
        ys, xs = ys + edge, xs + edge
        patch = soft[ys[:, None] + DISC_Y, xs[:, None] + DISC_X]
        angle = np.arctan2((patch * DISC_Y).sum(1), (patch * DISC_X).sum(1))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def at(dx: np.ndarray, dy: np.ndarray, ys=ys, xs=xs, c=c, s=s, soft=soft) -> np.ndarray:
            x = np.rint(c * dx - s * dy).astype(int) + xs[:, None]
            y = np.rint(s * dx + c * dy).astype(int) + ys[:, None]
            return soft[y.clip(0, soft.shape[0] - 1), x.clip(0, soft.shape[1] - 1)]

        flags = at(TESTS[:, 0], TESTS[:, 1]) < at(TESTS[:, 2], TESTS[:, 3])
        bits.append(np.packbits(flags, axis=1, bitorder="little").view("<i8"))
        points.append(np.stack([(xs + 0.5) * by - 0.5, (ys + 0.5) * by - 0.5, np.full(len(xs), by), angle], axis=1))
    if not points:
        return np.empty((0, 4)), np.empty((0, 4), dtype="<i8")
    return np.concatenate(points), np.concatenate(bits)


def consensus(matches: np.ndarray) -> tuple[int, float, float]:
    """Most matches that agree on one similarity transform, its scale and angle.

    ``matches``: x, y, scale, angle of one image, then of the other. Each match
    proposes a transform; places of the first image count once. Ties go to the
    earlier match in the order of those places.
    """
    _, place = np.unique(np.rint(matches[:, :2]), axis=0, return_inverse=True)
    order = np.argsort(place.ravel(), kind="stable")
    matches, place = matches[order], place.ravel()[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    p, q = matches[:, :2], matches[:, 4:6]
    scale, turn = matches[:, 6] / matches[:, 2], matches[:, 7] - matches[:, 3]
    best = (0, 1.0, 0.0)
    step = max(1, STEP_CELLS // len(p))
    for lo in range(0, len(p), step):
        s, t = scale[lo : lo + step, None], turn[lo : lo + step, None]
        dx, dy = p[:, 0] - p[lo : lo + step, :1], p[:, 1] - p[lo : lo + step, 1:]
        c, d = s * np.cos(t), s * np.sin(t)
        off_x = q[:, 0] - q[lo : lo + step, :1] - (c * dx - d * dy)
        off_y = q[:, 1] - q[lo : lo + step, 1:] - (d * dx + c * dy)
        lean = np.abs((turn - t + np.pi) % (2 * np.pi) - np.pi)
        ok = (off_x**2 + off_y**2 < 25.0) & (lean < 0.4) & (np.abs(np.log(scale / s)) < 0.3)
        counts = (np.add.reduceat(ok, starts, axis=1) > 0).sum(1)
        i = int(counts.argmax())
        if counts[i] > best[0]:
            best = (int(counts[i]), float(s[i, 0]), float(t[i, 0]))
    return best


def agreement(points: np.ndarray, bits: np.ndarray, points2: np.ndarray, bits2: np.ndarray) -> tuple[int, float, float] | None:
    """Inliers, scale and angle of two images' corners, or None where too few agree."""
    near = np.zeros((len(bits), len(bits2)), dtype=np.uint8)
    for k in range(bits.shape[1]):
        # At most 256 in sum; the sum 256 wraps to 0 in a byte, so it is capped first.
        near += np.minimum(np.bitwise_count(bits[:, k, None] ^ bits2[None, :, k]), 63)
    x, y = np.nonzero(near <= MAX_BITS)
    if len(np.unique(x)) < MIN_INLIERS:
        return None
    found = consensus(np.concatenate([points[x], points2[y]], 1))
    return found if found[0] >= MIN_INLIERS else None


def descriptors(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per image that has corners: id, their places (four floats each) and
    their bits (32 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, points, bits = [], [], []
            for i, raw in enumerate(batch.column(1)):
                image = from_pgm(raw.as_py())
                if image is not None:
                    p, b = describe(image)
                    if len(p):
                        ids.append(i)
                        points.append(p.astype("<f4").tobytes())
                        bits.append(b.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids)), pa.array(points, pa.binary()), pa.array(bits, pa.binary())], names=["id", "points", "bits"])

    kind = dict(media.dtypes)[id_col]
    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(run, f"id {kind}, points binary, bits binary")


def _corners(points: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(points, "<f4").reshape(-1, 4).astype(float), np.frombuffer(bits, "<u8").reshape(-1, 4)


def table_keys(bits: bytes) -> np.ndarray:
    """The distinct keys of an image, a 64-bit hash of the table and its bits each."""
    words = np.frombuffer(bits, "<u8").reshape(-1, 1, 4)
    x = ((words & MASKS) * FACTORS).sum(2, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(x ^ (x >> np.uint64(29))).view(np.int64)


def _slot(keys: np.ndarray) -> np.ndarray:
    """A key's place in the bitmap."""
    return keys & ((1 << FILTER_BITS) - 1)


def key_bitmap(corners: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of all keys of ``corners``. Tasks emit the blocks that
    they have set; blocks are united by number, so only the bitmap reaches the driver."""
    size = 1 << FILTER_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for batch in batches:
            for bits in batch.column(0).to_pylist():
                slots = _slot(table_keys(bits))
                np.bitwise_or.at(flags, slots >> 3, np.uint8(128) >> (slots & 7).astype(np.uint8))
        for at in range(0, 1 << FILTER_BITS, size):
            part = flags[at >> 3 : (at + size) >> 3]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                sums[at] = sums[at] | x if at in sums else x
        for at, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "part"])

    schema = "at long, part binary"
    spread = 1 << (FILTER_BITS - FILTER_BLOCK)
    rows = corners.select("bits").mapInArrow(run, schema).repartition(spread, "at").mapInArrow(unite, schema).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in rows:
        out[r["at"] >> 3 : (r["at"] + size) >> 3] = np.frombuffer(bytes(r["part"]), np.uint8)
    return out


def key_rows(corners: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(key, id) of every distinct key of every image, those that ``only`` has not set left out."""
    held = corners.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys, counts = [], []
                for bits in part.column(1).to_pylist():
                    k = table_keys(bits)
                    if held is not None:
                        s = _slot(k)
                        k = k[(held.value[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1]
                    keys.append(k)
                    counts.append(len(k))
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(rows)], names=["key", "id"])

    return corners.select("id", "bits").mapInArrow(run, f"key long, id {dict(corners.dtypes)['id']}")


def compare(pairs: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """Those ``pairs`` (query, image) whose corners agree, with inliers, scale and
    angle. Corners are compared in blocks of images of bounded size: a block gets
    each of its images once, and a query once if it has pairs there."""
    # Written first, so that a small set of images is sent to the corners and not the reverse.
    wanted = materialize(pairs.select(F.col("image").alias("id")).distinct(), "image-wanted")
    blocks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // BLOCK_IMAGES))
    kind = dict(pairs.dtypes)["image"]

    def part(of: str):
        return F.pmod(F.xxhash64(of), F.lit(blocks)).cast("int").alias("part")

    lists = pairs.groupBy(part("image"), "query").agg(F.collect_list("image").alias("images"))
    laid = (
        known.join(wanted, "id", "left_semi")
        .select(part("id"), F.lit(0).alias("side"), "id", "points", "bits", F.lit(None).cast(f"array<{kind}>").alias("images"))
        .unionByName(lists.join(asked, lists["query"] == asked["id"]).select("part", F.lit(1).alias("side"), "id", "points", "bits", "images"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, {}
        for batch in batches:
            out = []
            for p, side, i, points, bits, images in zip(*(c.to_pylist() for c in batch.columns)):
                if p != current:
                    current, block = p, {}
                if not side:
                    block[i] = (points, bits)
                    continue
                mine = _corners(points, bits)
                for image in images:
                    found = agreement(*mine, *_corners(*block[image]))
                    if found:
                        out.append((i, image, *found))
            if out:
                q, m, n, s, t = zip(*out)
                kind_ = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, kind_), pa.array(m, kind_), pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(t, pa.float64())],
                    names=["query", "image", "inliers", "scale", "angle"])

    laid = laid.repartitionById(blocks, F.col("part")).sortWithinPartitions("part", "side")
    found = laid.mapInArrow(run, f"query {kind}, image {kind}, inliers long, scale double, angle double")
    found = materialize(found, "image-found")
    release(pairs.sparkSession)
    return found


def near_classes(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(image, near) of the images that some other image of ``keys`` (key, image)
    agrees with: ``near`` is the least image linked with it."""
    pairs = None
    # Some of the keys are enough to find a leader; which ones depends on the keys alone.
    keys = materialize(keys.filter(F.col("key") % LEADER_KEYS == 0), "image-leader-keys")
    for order in (1, 2):
        first = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(order), "image").alias("h"), F.col("image").alias("leader"))).alias("l"))
        leaders = first.filter("n > 1").select("key", "l.leader")
        met = keys.join(leaders, "key").filter(F.col("image") != F.col("leader")).groupBy("image", "leader").count()
        one = met.groupBy("image").agg(F.max(F.struct("count", "leader")).alias("m")).select(F.col("m.leader").alias("query"), "image")
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = materialize(pairs.distinct(), "image-leaders")
    linked = compare(pairs, known, known)
    found = graph.components(linked.select("query", "image").toDF("src", "dst"), keep=lambda df: materialize(df, "image-links"))
    return materialize(found.toDF("image", "near"), "image-near")


def match(queries: DataFrame, media: DataFrame, id_col: str, media_col: str) -> tuple[DataFrame, DataFrame]:
    """(query, near, image, inliers, scale, angle): for every query and class of near
    copies that agree geometrically the member that agrees best (then the least);
    and (image, near) of the images that share a class with others. An image that
    shares none is a class of its own."""
    with scratch() as keep:
        asked = materialize(descriptors(queries, id_col, media_col), "image-query-corners")
        known = materialize(descriptors(media, id_col, media_col), "image-corners")
        mine = materialize(key_rows(asked).withColumnRenamed("id", "query"), "image-query-keys")
        # What the bitmap lets through by chance goes here.
        theirs = key_rows(known, key_bitmap(asked)).withColumnRenamed("id", "image").join(mine.select("key").distinct(), "key", "left_semi")
        theirs = materialize(theirs, "image-keys")
        near = keep(near_classes(theirs, known))
        release(media.sparkSession)
        # Of a class with many members one stands for it at each key.
        ahead = theirs.join(near, "image", "left").groupBy("key", F.coalesce("near", "image").alias("near")).agg(F.min("image").alias("image"))
        pairs = mine.join(ahead, "key").select("query", "image").distinct()
        pairs = materialize(pairs, "image-pairs")
        found = compare(pairs, asked, known).join(near, "image", "left").withColumn("near", F.coalesce("near", "image"))
        best = F.max(F.struct("inliers", (-F.col("image")).alias("i"), "image", "scale", "angle")).alias("m")
        found = keep(materialize(found.groupBy("query", "near").agg(best).select("query", "near", "m.image", "m.inliers", "m.scale", "m.angle"), "image-best"))
    return found, near


def _drawn(vectors: pa.Array) -> Iterator[bytes | None]:
    """The drawing of each vector, null where there is none, a few at a time."""
    for lo in range(0, len(vectors), 256):
        part = [None if v is None else [np.nan if e is None else e for e in v] for v in vectors.slice(lo, 256).to_pylist()]
        out: list[bytes | None] = [None] * len(part)
        for n in {len(v) for v in part if v is not None}:
            at = [i for i, v in enumerate(part) if v is not None and len(v) == n]
            for i, image in zip(at, render(np.array([part[i] for i in at], dtype=np.float32).reshape(len(at), n))):
                out[i] = to_pgm(image)
        yield from out


def draw(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """An image per row, drawn from its vector: id, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(_drawn(part.column(1))), pa.binary())], names=["id", "media"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(run, "id long, media binary")


def marked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector and a 128-bit digest of the drawn image (null without one)."""
    kind = dict(vectors.dtypes)[vector_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [None if m is None else hashlib.blake2b(m, digest_size=16).digest() for m in _drawn(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], names=["id", "v", "mark"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id long, v {kind}, mark binary")


def edited(media: DataFrame) -> DataFrame:
    """Edited copies of a (id, media) table; the edit follows the content alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                image = from_pgm(raw)
                out.append(None if image is None else to_pgm(edit(image, zlib.crc32(raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "media"])

    return media.mapInArrow(run, "id long, media binary")


def copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", step: int = QUERY_STEP) -> DataFrame:
    """Search an edited copy of every row whose id is divisible by ``step`` among
    the images of all rows. A row of kind ``match`` is a query's agreement with a
    class of copies: query id, class id (the least id of the class), id of the
    content that agrees best, inliers, scale and angle; a query without a match has
    none. A row of kind ``member`` gives the class of an image, for every row that
    has one. Only vectors and digests are shuffled; images are drawn where needed."""
    with scratch() as keep:
        marks = materialize(marked(vectors, id_col, vector_col), "image-marks")
        known = marks.filter(F.col("id").isNotNull() & F.col("mark").isNotNull())
        # Contents are numbered by their least id.
        classes = materialize(known.groupBy("mark").agg(F.min("id").alias("content"), F.min_by("v", "id").alias("v")), "image-classes")
        rows = keep(materialize(known.select("id", "mark").join(classes.select("mark", "content"), "mark").select("id", "content"), "image-contents"))
        drop_scratch(marks)
        asked = rows.filter(F.col("id") % step == 0)
        queries = classes.join(asked.select("content").distinct(), "content", "left_semi")
        found, near = match(edited(draw(queries, "content", "v")), draw(classes, "content", "v"), "id", "media")
        keep(found), keep(near)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("match_id", "long"), ("inliers", "long"), ("scale", "double"), ("angle", "double"))]
    members = rows.join(near.toDF("content", "near"), "content", "left").select(
        F.lit("member").alias("kind"), F.col("id").alias(id_col), F.coalesce("near", "content").alias("class_id"), *none)
    matches = asked.join(found.withColumnRenamed("query", "content"), "content").select(
        F.lit("match").alias("kind"), F.col("id").alias(id_col), F.col("near").alias("class_id"), F.col("image").alias("match_id"),
        "inliers", F.round("scale", 3).alias("scale"), F.round("angle", 3).alias("angle"))
    return matches.unionByName(members)

"""Media columns: local image descriptors that find cropped or edited copies.

Method: corners at several scales, each with a binary code of brightness tests turned to the corner's orientation. Codes
are cut into keys; corners of two images with an equal key are candidates (Hamming tables), those whose codes differ in
few bits are matches, and matches that agree on one scale, turn and shift are a copy. Images with equal pixels are one
node, so groups of exact copies cost one image. Query images and all images are dealt in chunks, each chunk of the one
meets each of the other in a task, and there every pair of corners with an equal key is compared, however many have it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Scales, corners of an image at each, bits of a code, half a patch, and keys of a code.
SCALES, CORNERS, BITS, HALF, KEYS = (1.0, 0.75, 0.5), (16, 10, 6), 256, 9, 6
#: How many times longer a test is across a corner's direction than along it, and its least length across.
ACROSS, LEAST = 4, 2
#: Bits that may differ, corners that must agree.
FAR, AGREE = 52, 6
#: Images of a chunk at most, image pairs of two chunks that are worth a task, and corner pairs that are held at a time.
CHUNK, WORTH, HELD = 1 << 14, 100_000, 1 << 20


@functools.lru_cache(1)
def _tests() -> np.ndarray:
    """For each of 32 turns the two places (y, x) of each brightness test.

    All tests run across the corner's direction: a corner is turned until it grows brighter along it, so tests along it
    come out alike at all corners and make codes of unlike pictures close.
    """
    rng = np.random.default_rng(11)
    p = np.clip(rng.normal(0, HALF / 2.2, (40 * BITS, 2, 2)), -HALF + 2, HALF - 2)
    long = np.abs(p[:, 0] - p[:, 1])
    p = p[(long[:, 0] > ACROSS * long[:, 1]) & (long[:, 0] > LEAST)][:BITS]
    out = []
    for t in range(32):
        a = 2 * np.pi * t / 32
        turned = p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        out.append(np.clip(np.rint(turned), -HALF, HALF).astype(np.int64))
    return np.stack(out)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1, same size, edges repeated."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    k = 2 * r + 1
    return p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]


def _scaled(x: np.ndarray, s: float) -> np.ndarray:
    if s == 1:
        return x
    h, w = int(x.shape[1] * s), int(x.shape[2] * s)
    y, z = (np.arange(h) + 0.5) / s - 0.5, (np.arange(w) + 0.5) / s - 0.5
    y0, z0 = np.clip(y.astype(int), 0, x.shape[1] - 2), np.clip(z.astype(int), 0, x.shape[2] - 2)
    fy, fz = np.clip(y - y0, 0, 1)[None, :, None], np.clip(z - z0, 0, 1)[None, None, :]
    top = x[:, y0][:, :, z0] * (1 - fz) + x[:, y0][:, :, z0 + 1] * fz
    low = x[:, y0 + 1][:, :, z0] * (1 - fz) + x[:, y0 + 1][:, :, z0 + 1] * fz
    return top * (1 - fy) + low * fy


def describe(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Images of one size (n, height, width): image, y, x, turn (radians), scale and packed code of each corner."""
    found = []
    for s, limit in zip(SCALES, CORNERS):
        x = _scaled(images.astype(np.float64), s)
        if min(x.shape[1:]) <= 2 * HALF + 2:
            continue
        x = _box(x, 1) / 9
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        r = r[:, HALF:-HALF, HALF:-HALF]
        wide = np.pad(r, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        peak = np.ones_like(r, bool)
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    other = wide[:, dy : dy + r.shape[1], dx : dx + r.shape[2]]
                    peak &= (r > other) if (dy, dx) < (1, 1) else (r >= other)
        r = np.where(peak & (r > 1e-3), r, -np.inf).reshape(len(x), -1)
        top = np.argsort(-r, axis=1, kind="stable")[:, :limit]
        image, nth = np.nonzero(np.isfinite(np.take_along_axis(r, top, 1)))
        width = x.shape[2] - 2 * HALF
        y, z = np.divmod(top[image, nth], width)
        y, z = y + HALF, z + HALF
        d = np.arange(-HALF, HALF + 1)
        disc = (d[:, None] ** 2 + d[None, :] ** 2 <= HALF**2).astype(float)
        patch = x[image[:, None, None], y[:, None, None] + d[None, :, None], z[:, None, None] + d[None, None, :]] * disc
        turn = np.arctan2((patch * d[None, :, None]).sum((1, 2)), (patch * d[None, None, :]).sum((1, 2)))
        t = _tests()[np.rint(turn / (2 * np.pi) * 32).astype(int) % 32]
        one = x[image[:, None], y[:, None] + t[:, :, 0, 0], z[:, None] + t[:, :, 0, 1]]
        two = x[image[:, None], y[:, None] + t[:, :, 1, 0], z[:, None] + t[:, :, 1, 1]]
        found.append((image, y / s, z / s, turn, np.full(len(y), s), np.packbits(one < two, axis=1)))
    if not found:
        return tuple(np.zeros(0) for _ in range(5)) + (np.zeros((0, BITS // 8), np.uint8),)
    return tuple(np.concatenate(c) for c in zip(*found))


PLACE = ("corner", "y", "x", "turn", "scale", "code")
CORNERS_OF = "image_id long, pixel_key string, corners array<struct<corner: int, y: float, x: float, turn: float, scale: float, code: binary>>"


def corners(images: DataFrame) -> DataFrame:
    """image_id, pixel_key, corners: one row for each image (image_id, pixel_key, height, width, pixels: rows of 8-bit
    brightness). Images of no or too few pixels, or whose pixels aren't height times width, have an empty list."""

    def work(batch):
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            h, w = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("height", "width"))
            data, off = C.text_bytes(part.column("pixels"))
            fits = (np.diff(off) == h * w) & (np.minimum(h, w) > 2 * HALF + 2)
            found = [describe(np.zeros((0, 1, 1)))]
            for size in {(int(y), int(x)) for y, x in zip(h[fits], w[fits])}:
                own = np.flatnonzero(fits & (h == size[0]) & (w == size[1]))
                image, *rest = describe(np.stack([data[off[i] : off[i + 1]].reshape(size) for i in own]))
                found.append((own[image.astype(np.int64)], *rest))
            image, *rest = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(image, kind="stable")
            image, (y, x, turn, scale, code) = image[order].astype(np.int64), (c[order] for c in rest)
            begin = np.searchsorted(image, np.arange(part.num_rows + 1)).astype(np.int32)
            nth = np.arange(len(image)) - begin[image]
            lists = pa.StructArray.from_arrays([pa.array(nth.astype(np.int32)), *(pa.array(v.astype(np.float32)) for v in (y, x, turn, scale)), pa.array([c.tobytes() for c in code], pa.binary())], PLACE)
            yield pa.RecordBatch.from_arrays([part.column("image_id"), part.column("pixel_key"), pa.ListArray.from_arrays(begin, lists)], ["image_id", "pixel_key", "corners"])

    return C.per_batch(images.select("image_id", "pixel_key", F.col("height").cast("int"), F.col("width").cast("int"), "pixels"), work, CORNERS_OF)


SIDE = ("node", "y", "x", "turn", "scale", "code")
LINKS = "node_a long, node_b long, agree int"


def _side(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes, and for each corner its image (a place in nodes), y, x, turn, scale and code as four numbers."""
    table = table.combine_chunks()
    lists = [table.column(c).combine_chunks() for c in SIDE]
    image = np.repeat(np.arange(table.num_rows), lists[1].value_lengths().to_numpy(zero_copy_only=False))
    code = C.text_bytes(lists[5].flatten())[0].reshape(-1, BITS // 8)
    return lists[0].to_numpy(), image, *(c.flatten().to_numpy() for c in lists[1:5]), np.ascontiguousarray(code).view(np.uint64)


def _part(side: tuple[np.ndarray, ...], a: int, z: int) -> tuple[np.ndarray, ...]:
    """The images from a to z of a side."""
    i, j = np.searchsorted(side[1], (a, z))
    return side[0][a:z], side[1][i:j] - a, *(c[i:j] for c in side[2:])


def _keys(code: np.ndarray) -> np.ndarray:
    """The KEYS keys of three bytes of each code."""
    b = code.view(np.uint8).reshape(-1, BITS // 8)[:, : 3 * KEYS].reshape(-1, KEYS, 3).astype(np.int32)
    return (b[:, :, 0] << 16 | b[:, :, 1] << 8 | b[:, :, 2]).T


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """For each row the number of its combination of values."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting: np.unique hashes, which takes several times as long here."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def agreement(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Images of a and b, and the corners that agree, of image pairs with enough of the matches (corner i of a, j of b)."""
    i, j = np.divmod(_distinct(i * len(b[1]) + j), len(b[1]))
    pair = a[1][i] * len(b[0]) + b[1][j]
    pairs, pair, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = count[pair] >= AGREE
    i, j, pair = i[enough], j[enough], pair[enough]
    # each match proposes a scale and a turn, and with them where the origin of one image lies in the other
    (ya, xa, ta, sa), (yb, xb, tb, sb) = ([c[k] for c in side[2:6]] for side, k in ((a, i), (b, j)))
    s, t = sa.astype(float) / sb, (tb - ta).astype(float)
    dx, dy = xb - s * (np.cos(t) * xa - np.sin(t) * ya), yb - s * (np.sin(t) * xa + np.cos(t) * ya)
    scale = np.rint(np.log2(s) * 2).astype(np.int64)
    best = np.zeros(len(pairs), np.int64)
    for o, p in ((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)):
        cell = _numbered(pair, scale, np.floor(dx / 12 + o), np.floor(dy / 12 + p))
        sides = [np.bincount(_distinct(cell * len(side[1]) + k) // len(side[1]), minlength=1) for side, k in ((a, i), (b, j))]
        np.maximum.at(best, pair, np.minimum(*sides)[cell])
    good = np.flatnonzero(best >= AGREE)
    return *np.divmod(pairs[good], len(b[0])), best[good]


def links(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]):
    """Nodes of a and b and the corners that agree, for the image pairs of two sides that are copies: every pair of corners
    with an equal key is compared, about HELD of them at a time."""
    keys, begin, size = _keys(b[6]), [], []
    order = [np.argsort(k, kind="stable") for k in keys]
    images = [b[1][o] for o in order]
    for own, k, o in zip(_keys(a[6]), keys, order):
        begin.append(np.searchsorted(k[o], own))
        size.append(np.searchsorted(k[o], own, side="right") - begin[-1])
    held = np.cumsum(np.bincount(a[1], sum(size), len(a[0])))
    first = 0
    while first < len(a[0]):
        done = held[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(held, done + HELD, side="right")))
        if held[last - 1] - done > HELD and len(b[0]) > 1:
            half = len(b[0]) // 2
            for part in (_part(b, 0, half), _part(b, half, len(b[0]))):
                yield from links(_part(a, first, last), part)
        else:
            own = slice(*np.searchsorted(a[1], (first, last)))
            at = np.arange(own.start, own.stop)
            row = (a[1][own] - first) * len(b[0])
            spans = [(s[own], n[own]) for s, n in zip(begin, size)]
            pair = np.concatenate([np.repeat(row, n) + image[C.spread(s, n)] for image, (s, n) in zip(images, spans)])
            count = np.bincount(pair, minlength=(last - first) * len(b[0]))
            kept = np.flatnonzero((count >= AGREE)[pair])  # fewer equal keys than corners that must agree: no link
            i = np.concatenate([np.repeat(at, n) for _, n in spans])[kept]
            j = np.concatenate([o[C.spread(s, n)] for o, (s, n) in zip(order, spans)])[kept]
            far = np.bitwise_count(a[6][i] ^ b[6][j]).sum(1)
            close = (far <= FAR) & (a[0][a[1][i]] != b[0][b[1][j]])
            pair = pair[kept]
            close &= (np.bincount(pair[close], minlength=len(count)) >= AGREE)[pair]
            one, two, agree = agreement(a, b, i[close], j[close])
            yield a[0][one], b[0][two], agree
        first = last


def compared(images: DataFrame) -> DataFrame:
    """node_a, node_b, agree of each query image and each other image that is a copy. images: node, asks and by corner
    y, x, turn, scale, code; a table, as it is read twice.

    Queries are dealt to a few chunks and images to more, so that both sides are sent about as often; the work is that
    of all pairs of chunks.
    """
    n, asked = images.agg(F.count("*"), F.count_if("asks")).first()
    tasks = max(1, min(8 * images.sparkSession.sparkContext.defaultParallelism, n * asked // WORTH))
    few = max(-(-asked // CHUNK), round((tasks * asked / max(n, 1)) ** 0.5), 1)
    many = max(-(-n // CHUNK), -(-tasks // few))
    chunk = lambda parts: F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asking = images.filter("asks").select(chunk(few).alias("ask"), every(many).alias("chunk"), *SIDE)
    others = images.select(every(few).alias("ask"), chunk(many).alias("chunk"), *SIDE)

    def work(left, right):
        if not (left.num_rows and right.num_rows):
            return pa.schema([("node_a", pa.int64()), ("node_b", pa.int64()), ("agree", pa.int32())]).empty_table()
        one, two, agree = (np.concatenate(c) for c in zip(*links(_side(left), _side(right))))
        return pa.table({"node_a": one, "node_b": two, "agree": agree.astype(np.int32)})

    dealt = [df.repartition(few * many, "ask", "chunk").groupBy("ask", "chunk") for df in (asking, others)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(work, LINKS)


def copies(images: DataFrame, queries) -> DataFrame:
    """One row for each row of images (image_id, height, width, pixels): class_id (the least image_id with the same
    pixels), and matches: for classes of query images (a condition on image_id) the other classes of which they are a
    cropped or edited copy, with the agreeing corners. Null or odd images are classes of their own without matches;
    rows that are repeated fall in one class and get a row each. Different pictures under one image_id are classes with
    one number; of those the picture with the least pixel hash is compared.

    Images are compared in pairs of chunks, see compared; no key is too common to be looked at.
    """
    images = images.select(F.col("image_id").cast("long").alias("image_id"), "height", "width", "pixels")
    named = images.filter("image_id is not null")
    nothing = F.col("pixels").isNull() | F.col("height").isNull() | F.col("width").isNull()
    key = F.when(nothing, F.concat(F.lit("none"), F.col("image_id"))).otherwise(F.md5(F.concat_ws(",", "height", "width", F.md5("pixels"))))
    drawn = C.written(corners(named.withColumn("pixel_key", key)), "drawn")
    named_keys = drawn.select("image_id", "pixel_key")
    classes = C.written(named_keys.groupBy("pixel_key").agg(F.min("image_id").alias("node"), F.max(queries("image_id")).alias("asks")), "classes")
    every = drawn.filter(F.size("corners") > 0).join(classes, ["pixel_key"]).filter("image_id = node")
    least = every.groupBy("node").agg(F.max("asks").alias("asks"), F.min_by("corners", "pixel_key").alias("corners"))
    good = compared(C.written(least.select("node", "asks", *(F.col(f"corners.{c}").alias(c) for c in SIDE[1:])), "corners"))
    lists = good.groupBy("node_a").agg(F.array_sort(F.collect_list(F.struct(F.col("node_b").alias("class_id"), F.col("agree").alias("corners")))).alias("matches"))
    per_class = classes.join(C.written(lists, "matches"), F.col("node") == F.col("node_a"), "left").select("pixel_key", F.col("node").alias("class_id"), "matches")
    out = named_keys.join(per_class, "pixel_key").select("image_id", "class_id", "matches")
    return out.unionByName(images.filter("image_id is null").select("image_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast(out.schema["matches"].dataType).alias("matches")))


# ---------------------------------------------------------------- images from the tables


def pictures(vectors: DataFrame, size: int = 80) -> DataFrame:
    """image_id, height, width, pixels: a picture of each vector (vec_id, embedding), and for every tenth one a cropped
    and brightened copy as well. image_id is 2 vec_id for the picture and 2 vec_id + 1 for the copy."""
    rng = np.random.default_rng(5)
    count = 90
    where, spread_, pick = rng.random((count, 2)), rng.uniform(1.2, 5, count), rng.integers(0, 1 << 30, (count, 3))

    def draw(v: np.ndarray) -> np.ndarray:
        """Spots whose place, size and brightness follow the vector."""
        n = v.shape[1]
        unit = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-9)
        shift = unit[:, pick % n]
        cy, cx = ((where[None, :, i] + 0.9 * shift[:, :, i]) % 1 * size for i in (0, 1))
        grid = np.arange(size)
        wide = spread_[None, :] * (1 + 0.5 * shift[:, :, 2])
        ky = np.exp(-(((grid[None, None, :] - cy[:, :, None]) / wide[:, :, None]) ** 2))
        kx = np.exp(-(((grid[None, None, :] - cx[:, :, None]) / wide[:, :, None]) ** 2))
        sign = np.where(pick[None, :, 0] % 2 == 0, 1.0, -1.0) * (0.6 + 0.4 * np.abs(shift[:, :, 1]))
        return np.clip(127 + 90 * np.einsum("ns,nsy,nsx->nyx", sign, ky, kx), 0, 255).astype(np.uint8)

    def work(batch):
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            lists = part.column("embedding")
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            begin = np.cumsum(length) - length
            out = []
            for n in np.unique(length[length > 0]):
                own = np.flatnonzero(length == n)
                for i, px in zip(own, draw(np.nan_to_num(flat[C.spread(begin[own], length[own])].reshape(len(own), n)))):
                    out.append((2 * int(ids[i]), size, size, px.tobytes()))
                    if ids[i] % 10 == 0:
                        cut = np.clip(px[8:, 6:].astype(float) * 0.9 + 20, 0, 255).astype(np.uint8)
                        out.append((2 * int(ids[i]) + 1, *cut.shape, cut.tobytes()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["image_id", "height", "width", "pixels"])

    return C.per_batch(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null"), work, "image_id long, height int, width int, pixels binary")


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Pictures of all vectors and their edited copies; the queries are those whose image_id is divisible by 20."""
    images = pictures(C.table(spark, sf_dir, "embeddings"))
    found = copies(images, lambda c: F.col(c) % 20 == 0)
    return found.select("image_id", "class_id", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"), F.array_join(F.transform("matches", lambda m: m.class_id.cast("string")), ",").alias("matched"))

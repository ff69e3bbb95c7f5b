"""Media columns (operator 2): cropped and edited copies of images by local descriptors.

An image (binary PGM, PPM, BMP or PNG) becomes key points: the strongest corners of each cell of a grid, at scales
STEP apart down to the smallest usable size, with an orientation. So their number grows with the area. Each has 256 binary
tests, read between pixels in its turned patch. The first 240 bits are cut into five tables of 48 bits: key points that agree
in one table meet there (Hamming tables), behind a check of 128 other bits. Keys are counted with ids only; rows with place
and check follow for keys of several images. Of two images' meeting key points those that follow one turn, scale and shift must number MATCHES at least, and more
than chance explains; pairs with WEAK of them, but fewer than that, are decided by all their key points.
Identical files are one node. A bucket's images first meet its smallest id only; after components are labelled, all pairs of
a bucket with different labels meet in tiles of bounded size.
"""

from __future__ import annotations

import itertools
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, dropped, lean, table, written
from .linking import components, tiles, whole_runs

STEP, CELL, POINTS, RADIUS, BITS, TABLES, KEY_BYTES = 2 ** (1 / 3), 48, 24, 7, 256, 5, 6
MATCHES, WEAK, TOLERANCE, NEAR, NEAR_128 = 6, 2, 2.5, 40, 8
#: Bucket keys and labels that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Images in a file of key points: a task that counts their keys holds a hash map of all its keys.
FILE_ROWS = 4000
#: Pixels of images of one shape that are treated at a time (a larger image alone).
STACK_PIXELS = 1 << 16
_rng = np.random.default_rng(20)
TESTS = np.clip(np.rint(_rng.normal(0, RADIUS / 2.2, (BITS, 4))), -RADIUS + 1, RADIUS - 1)


def png(data: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if not head or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    w, h, _, colour, *_ = head
    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), h * (w * c + 1)), np.uint8).reshape(h, w * c + 1)
    out, above = np.zeros((h, w * c), np.int64), np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind == 1:
            line = np.cumsum(line.reshape(w, c), axis=0).reshape(-1) & 255
        elif kind:
            for x in range(w * c):
                a, d = (line[x - c], above[x - c]) if x >= c else (0, 0)
                if kind == 3:
                    p = (a + above[x]) // 2
                else:
                    q = a + above[x] - d
                    p = min((abs(q - a), 0, a), (abs(q - above[x]), 1, above[x]), (abs(q - d), 2, d))[2]
                line[x] = line[x] + p & 255
        out[y] = above = line
    out = out.reshape(h, w, c)
    return out[:, :, :3].mean(axis=2) if c >= 3 else out[:, :, 0].astype(float)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values, or None for null, empty, broken and unknown data."""
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png(data)
        if data[:2] in (b"P5", b"P6"):
            head = data[:100].split(None, 4)
            w, h, most, c = int(head[1]), int(head[2]), int(head[3].split()[0]), 1 if data[:2] == b"P5" else 3
            raw = np.frombuffer(data[len(data) - w * h * c :], np.uint8).reshape(h, w, c)
            return raw.mean(axis=2) * (255 / most)
        if data[:2] == b"BM":
            offset, w, h, depth = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
            step = (w * 3 + 3) // 4 * 4
            raw = np.frombuffer(data, np.uint8, step * abs(h), offset).reshape(abs(h), step)[:, : w * 3].reshape(abs(h), w, 3)
            return None if depth != 24 else raw[:: -1 if h > 0 else 1].mean(axis=2)
    except (ValueError, IndexError, KeyError, OverflowError, MemoryError, struct.error, zlib.error):
        return None
    return None


def box(a: np.ndarray, r: int) -> np.ndarray:
    """The mean over a square of side 2r + 1 in the last two axes, edges repeated."""
    k = 2 * r + 1
    h, w = a.shape[-2:]
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r), (r, r)], mode="edge")
    rows = p[..., :h, :].copy()
    for i in range(1, k):
        rows += p[..., i : i + h, :]
    out = rows[..., :w].copy()
    for i in range(1, k):
        out += rows[..., i : i + w]
    out /= k * k
    return out


def resized(a: np.ndarray, factor: float) -> np.ndarray:
    h, w = (max(1, int(n / factor)) for n in a.shape[-2:])
    y, x = np.minimum(np.arange(h) * factor, a.shape[-2] - 1), np.minimum(np.arange(w) * factor, a.shape[-1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[-2] - 1), np.minimum(x0 + 1, a.shape[-1] - 1)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None, :]
    upper, lower = a[..., y0, :], a[..., y1, :]
    return (upper[..., x0] * (1 - fx) + upper[..., x1] * fx) * (1 - fy) + (lower[..., x0] * (1 - fx) + lower[..., x1] * fx) * fy


def between(a: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The values of images `i` at places between their pixels."""
    h, w = a.shape[1:]
    y, x = np.clip(y, 0, h - 1.001).astype(np.float32), np.clip(x, 0, w - 1.001).astype(np.float32)
    y0, x0 = y.astype(np.int64), x.astype(np.int64)
    fy, fx, flat = y - y0, x - x0, a.ravel()
    at = (i[:, None] * h + y0) * w + x0
    upper, lower = flat[at] * (1 - fx) + flat[at + 1] * fx, flat[at + w] * (1 - fx) + flat[at + w + 1] * fx
    return upper * (1 - fy) + lower * fy


def packed(places: np.ndarray) -> np.ndarray:
    """(x, y, angle, scale) as one integer: quarters of a pixel, 4096 angles, the number of the scale."""
    x, y = (np.rint(places[:, k] * 4).astype(np.int64) & 0xFFFFF for k in (0, 1))
    angle = np.rint(places[:, 2] * (2048 / np.pi)).astype(np.int64) & 0xFFF
    return x << 44 | y << 24 | angle << 12 | np.rint(np.log(places[:, 3]) / np.log(STEP)).astype(np.int64)


def unpacked(p: np.ndarray) -> np.ndarray:
    x, y, angle = (p >> 44 & 0xFFFFF) / 4, (p >> 24 & 0xFFFFF) / 4, (p >> 12 & 0xFFF) * (np.pi / 2048)
    return np.stack([x, y, angle, STEP ** (p & 0xFFF).astype(float)], axis=1)


def stack_points(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key points of images of one shape (n, h, w): image number, (x, y, angle, scale) and 256 bits as 32 bytes of each."""
    owner, places, bits = [np.zeros(0, np.int64)], [np.zeros((0, 4))], [np.zeros((0, BITS // 8), np.uint8)]
    images = images.astype(np.float32)
    span = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = (v.ravel() for v in np.meshgrid(span, span, indexing="ij"))
    inside = dy * dy + dx * dx <= RADIUS * RADIUS
    dy, dx = dy[inside], dx[inside]
    m = RADIUS + 3
    for level in itertools.count():
        scale = STEP**level
        if min(int(n / scale) for n in images.shape[1:]) <= 2 * m + 2:
            break
        a = images if not level else resized(box(images, max(1, round((scale - 1) / 2))) if scale >= 2**0.5 else images, scale)
        a = box(a, 1)
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        h, w = r.shape[1:]
        inner = r[:, m : h - m, m : w - m]
        ok = inner > 1.0
        for i, j in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
            ok &= inner > r[:, m + i : h - m + i, m + j : w - m + j]
        n, y, x = np.nonzero(ok)
        y, x = y + m, x + m
        if not len(n):
            continue
        cell = (n * h + (y - m) // CELL) * w + (x - m) // CELL
        best = np.lexsort((-r[n, y, x], cell))
        cell = cell[best]
        best = best[np.arange(len(n)) - np.searchsorted(cell, cell) < POINTS]  # cells, and so n, are sorted
        x1, y1, x2, y2 = (TESTS[:, k][None] for k in range(4))
        for part in range(0, len(best), 4096):
            some = best[part : part + 4096]
            i, py, px = n[some], y[some], x[some]
            patch = a[i[:, None], py[:, None] + dy, px[:, None] + dx].astype(float)
            angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
            c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
            grey = [between(a, i, py[:, None] + s * u + c * v, px[:, None] + c * u - s * v) for u, v in ((x1, y1), (x2, y2))]
            owner.append(i)
            bits.append(np.packbits(grey[0] < grey[1], axis=1))
            places.append(np.stack([px * scale, py * scale, angle, np.full(len(px), scale)], axis=1))
    return np.concatenate(owner), np.concatenate(places), np.concatenate(bits)


def keypoints(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(x, y, angle, scale) and 256 bits as 32 bytes of each key point, for each image; images of one shape go together."""
    shapes: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        if image is not None and image.size:
            shapes.setdefault(image.shape, []).append(k)
    out = [(np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))] * len(images)
    for shape, members in shapes.items():
        step = max(1, STACK_PIXELS // (shape[0] * shape[1]))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            owner, places, bits = stack_points(np.stack([images[k] for k in some]))
            for i, k in enumerate(some):
                out[k] = places[owner == i], bits[owner == i]
    return out


def needed(q: np.ndarray) -> int:
    """How many of these matches must follow one movement: MATCHES, and more where as many are likely by chance, as many
    matches in a small area make it (a Poisson tail over all movements tried)."""
    area = max(float(np.prod(np.ptp(q[:, :2], axis=0) + 2 * TOLERANCE)), 1.0)
    mean = (len(q) - 1) * math.pi * TOLERANCE**2 / area
    k, term, below_ = 0, math.exp(-mean), 0.0
    while 4 * len(q) * (1 - below_) > 1e-3 and k < len(q):
        below_ += term
        k += 1
        term *= mean / k
    return max(MATCHES, k + 1)


def consensus(p: np.ndarray, q: np.ndarray) -> int:
    """The greatest number of key points (distinct on both sides) that one turn, scale and shift of a match carries along."""
    best = 0
    spots = [np.unique(np.rint(v[:, :2] / 2), axis=0, return_inverse=True)[1].ravel() for v in (p, q)]
    s = q[:, 3] / p[:, 3]
    for turn, scale in ((1, 1), (0, 0), (0, 1), (1, 0)):
        theta = (q[:, 2] - p[:, 2]) * turn  # also the upright, unscaled copy, whose angles may be noisy
        z = s if scale else np.ones(len(s))
        c, n = z * np.cos(theta), z * np.sin(theta)
        tx, ty = q[:, 0] - (c * p[:, 0] - n * p[:, 1]), q[:, 1] - (n * p[:, 0] + c * p[:, 1])
        for k in range(0, len(p), 64):
            h = slice(k, k + 64)
            ex = c[h, None] * p[None, :, 0] - n[h, None] * p[None, :, 1] + tx[h, None] - q[None, :, 0]
            ey = n[h, None] * p[None, :, 0] + c[h, None] * p[None, :, 1] + ty[h, None] - q[None, :, 1]
            carried = ex * ex + ey * ey <= TOLERANCE**2
            size = carried.sum(axis=1)
            for r in np.argsort(-size, kind="stable").tolist():
                if size[r] <= best:
                    break
                best = max(best, min(len(np.unique(v[carried[r]])) for v in spots))
    return best


def alike(p: np.ndarray, q: np.ndarray, u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two images are copies, by all their key points: the nearest of q to each of p within NEAR bits may match."""
    i, j = [], []
    for k in range(0, len(u), 256):
        apart = np.bitwise_count(u[k : k + 256, None] ^ v[None]).sum(axis=2, dtype=np.int64)
        near = apart.argmin(axis=1)
        own = np.flatnonzero(apart[np.arange(len(near)), near] <= NEAR)
        i.append(own + k)
        j.append(near[own])
    i, j = np.concatenate(i), np.concatenate(j)
    return len(i) >= MATCHES and consensus(p[i], q[j]) >= needed(q[j])


def differing(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The number of differing bits of 64-bit integers (numpy counts those of the absolute value, where types have a sign)."""
    return np.bitwise_count((u ^ v).view(np.uint64))


def match_media(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id, n_keypoints, component_id), one row per image: component_id is the smallest id that copies lead to.

    Images that can't be decoded or lack corners are linked with byte-identical ones only; null and empty bytes and null ids
    with nothing (a null id gets a null component). Of rows that share an id the first file by its hash stands for it; an
    empty table gives no rows; other columns are left out."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(bytes_col).alias("data"))
    keyed = rows.select("id", F.when(F.octet_length("data") > 0, F.sha2("data", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"), "data")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 50):
                c = b.slice(k, 50)
                got = keypoints([decode(data) for data in c.column(3).to_pylist()])
                n, xs, bits = [len(p) for p, _ in got], [packed(p).tobytes() for p, _ in got], [d.tobytes() for _, d in got]
                yield pa.RecordBatch.from_arrays([*c.columns[:3], pa.array(n, pa.int64()), pa.array(xs, pa.binary()), pa.array(bits, pa.binary())], ["id", "sha", "row", "n_keypoints", "places", "bits"])

    found = written(keyed.mapInArrow(lean(points), "id long, sha string, row long, n_keypoints long, places binary, bits binary"), "keypoints", FILE_ROWS)
    files = found.where("sha is not null and id is not null").groupBy("sha").agg(F.min("id").alias("rep"))
    first = found.where("n_keypoints > 0 and id is not null").groupBy("id").agg(F.min(F.struct("sha", "row")).alias("f")).select("id", "f.sha", "f.row")
    chosen = written(first.join(files, "sha").where("id = rep").select("row"), "chosen")
    # Key points are most of all bytes: rows are chosen by number, so that these stay where they lie.
    n = chosen.count()
    reps = found.join(bounded_broadcast(chosen, n, BROADCAST_ROWS), "row", "left_semi").select("id", "places", "bits")
    reps = reps if n <= BROADCAST_ROWS else written(reps, "images")

    def keyed_points(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for k in range(0, b.num_rows, 200):
            c = b.slice(k, 200)
            bits = np.frombuffer(b"".join(c.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            for t in range(TABLES):
                wide = np.zeros((len(bits), 8), np.uint8)
                wide[:, :KEY_BYTES], wide[:, 7] = bits[:, t * KEY_BYTES : (t + 1) * KEY_BYTES], t
                other = np.delete(bits, np.s_[t * KEY_BYTES : (t + 1) * KEY_BYTES], axis=1)
                yield c, wide.view(np.int64)[:, 0], other

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, key, _ in keyed_points(b):
                owner = np.repeat(c.column(0).to_numpy(), [len(x) // 8 for x in c.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner)], ["key", "id"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, key, other in keyed_points(b):
                places = c.column(1).to_pylist()
                checks = [np.ascontiguousarray(other[:, k : k + 8]).view(np.int64)[:, 0] for k in (0, 18)]
                owner = np.repeat(c.column(0).to_numpy(), [len(x) // 8 for x in places])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(np.frombuffer(b"".join(places), np.int64)), *map(pa.array, checks)], ["key", "id", "place", "c1", "c2"])

    counts = reps.mapInArrow(lean(keys_only), "key long, id long").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    keys = written(counts.where("lo <> hi").select("key"), "keys")
    post = reps.mapInArrow(lean(spread), "key long, id long, place long, c1 long, c2 long")
    held = written(post.join(bounded_broadcast(keys, keys.count(), BROADCAST_ROWS), "key", "left_semi"), "hits")
    dropped(keys)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by key and then by all else: each meets the first of its key, which later batches get handed on.
        head = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(x).to_numpy() for x in ("key", "id", "place", "c1", "c2")]
            rows = [np.append(f, x) for f, x in zip(head, rows, strict=True)] if head else rows
            key, i, place, u, v = rows
            f = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0))
            near = np.flatnonzero((i != i[f]) & (differing(u, u[f]) + differing(v, v[f]) <= NEAR_128))
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (i[f[near]], i[near], place[f[near]], place[near])], ["a", "b", "p", "q"])
            head = [x[f[-1]] for x in rows]

    dealt = held.repartition("key").sortWithinPartitions("key", "id", "place", "c1", "c2")
    links = linked(dealt.mapInArrow(lean(star), "a long, b long, p long, q long"), reps)
    label = written(components(links), "labels")

    label = bounded_broadcast(label, label.count(), BROADCAST_ROWS)
    seen = held.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = written(seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("key", "rows"), "mixed")
    seen = seen.join(bounded_broadcast(mixed, mixed.count(), BROADCAST_ROWS), "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row k meets row k + step of its tile, for all rows at once.
        for t, ends in whole_runs(batches, ["key", "t1", "t2"]):
            i, c, side, t1, t2, u, v, place = (t.column(x).to_numpy() for x in ("id", "component", "side", "t1", "t2", "c1", "c2", "place"))
            k, step = np.arange(len(i)), 1
            while len(k := k[k + step < ends[k]]):
                x = k[(c[k] != c[k + step]) & ((t1[k] == t2[k]) | (side[k] != side[k + step]))]
                x = x[differing(u[x], u[x + step]) + differing(v[x], v[x + step]) <= NEAR_128]
                step, y = step + 1, x + step
                if len(x):
                    lo, hi = np.where(i[x] < i[y], x, y), np.where(i[x] < i[y], y, x)
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (i[lo], i[hi], place[lo], place[hi])], ["a", "b", "p", "q"])

    tiled = tiles(seen, ["key"]).select("key", "t1", "t2", "side", "id", "component", "place", "c1", "c2")
    more = linked(tiled.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").mapInArrow(lean(meet), "a long, b long, p long, q long"), reps)
    for done in (held, mixed):
        dropped(done)
    final = components(links.unionByName(more))
    nodes = files.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("sha", F.coalesce("component", "rep").alias("component"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select("id", "sha", "n_keypoints").join(nodes, "sha", "left").select("id", "n_keypoints", own.alias("component_id"))


def linked(matches: DataFrame, images: DataFrame) -> DataFrame:
    """The written pairs (a, b) of images that are copies: by the movement of their matches (a, b, p, q), or, where only a few
    of these agree, by all key points."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in whole_runs(batches, ["a", "b"]):
            stops = np.unique(ends)
            starts = np.append(0, stops[:-1])
            p, q = (t.column(x).to_numpy() for x in ("p", "q"))
            sure, at = [], []
            many = stops - starts >= WEAK
            for i, j in zip(starts[many].tolist(), stops[many].tolist(), strict=True):
                both = np.unique(np.stack([p[i:j], q[i:j]], axis=1), axis=0)  # matches that agree in several tables
                x, y = unpacked(both[:, 0]), unpacked(both[:, 1])
                if (n := consensus(x, y)) >= WEAK:
                    at.append(i)
                    sure.append(n >= needed(y))
            yield pa.RecordBatch.from_arrays([*(t.column(x).combine_chunks().take(pa.array(at, pa.int64())) for x in ("a", "b")), pa.array(sure, pa.bool_())], ["a", "b", "sure"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for p, q, u, v in zip(*(b.column(x).to_pylist() for x in ("pa", "pb", "ua", "ub")), strict=True):
                p, q = (unpacked(np.frombuffer(x, np.int64)) for x in (p, q))
                u, v = (np.frombuffer(x, np.uint64).reshape(-1, BITS // 64) for x in (u, v))
                kept.append(alike(p, q, u, v))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(kept, pa.bool_())), b.column("b").filter(pa.array(kept, pa.bool_()))], ["a", "b"])

    voted = written(matches.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(lean(vote), "a long, b long, sure boolean"), "votes")
    both = voted.where("not sure").select("a", "b")
    asked = written(both.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    images = images.join(bounded_broadcast(asked, asked.count(), BROADCAST_ROWS), "id", "left_semi")
    for side in ("a", "b"):
        both = both.join(images.select(F.col("id").alias(side), F.col("places").alias(f"p{side}"), F.col("bits").alias(f"u{side}")), side)
    return written(voted.where("sure").select("a", "b").unionByName(both.mapInArrow(lean(decide), "a long, b long")), "links")


def drawn(vector: Column, side: int = 64) -> Column:
    """A PGM image of a vector: its values weigh fixed plane waves. Stands in for a media column; null for null and empty."""

    @F.arrow_udf("binary")
    def draw(a: pa.Array) -> pa.Array:
        out, waves = [], np.zeros((0, side * side))
        y, x = (v.ravel() for v in np.mgrid[:side, :side])
        for v in a.to_pylist():
            if not v:
                out.append(None)
                continue
            if len(v) > len(waves):
                rng = np.random.default_rng(7)
                turn, length, phase = (rng.uniform(lo, hi, len(v))[:, None] for lo, hi in ((0, np.pi), (5, 16), (0, 2 * np.pi)))
                waves = np.cos((np.cos(turn) * x + np.sin(turn) * y) * 2 * np.pi / length + phase)
            values = np.nan_to_num(np.array([0.0 if z is None else z for z in v]))
            field = values @ waves[: len(v)]
            grey = np.clip(128 + 50 * field / (field.std() + 1e-9), 0, 255).astype(np.uint8)
            out.append(b"P5 %d %d 255\n" % (side, side) + grey.tobytes())
        return pa.array(out, pa.binary())

    return draw(vector)


def op2_media_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no images, so each embedding is drawn as one."""
    vectors = table(spark, sf_dir, "embeddings")
    return match_media(vectors.select("vec_id", drawn(F.col("embedding")).alias("image")), "vec_id", "image").withColumnRenamed("id", "vec_id")

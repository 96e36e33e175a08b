"""Per-pixel statistics by tiles: what is shuffled is one small table for each task and tile, never a row for a pixel and frame.

A tile is a run of pixels in scan order.  A task folds its frames into counting tables, (pixel, value) with the number of frames, which are merged by
tile.  From a merged table follow exact medians and other order statistics by counting, deviations and histograms, without
another look at the frames.  The greatest values of a pixel are folded the same way, as lists of no more than k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Geometry, _frames, _pair

#: Pixels of a tile.
TILE = 1024
#: Bytes of frames that a task counts at once, and entries of tables that it holds before it sends them on.
BLOCK_BYTES, HELD = 16 << 20, 4 << 20
_LOW = 1 << 31
_PACKED = "tile int, payload binary"


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["tile", "payload"])


def _narrow(x: np.ndarray, kinds: tuple[str, ...]) -> tuple[int, np.ndarray]:
    """The first of the kinds that holds all of x."""
    for i, k in enumerate(kinds):
        if not len(x) or (int(x.min()) >= np.iinfo(k).min and int(x.max()) <= np.iinfo(k).max):
            return i, x.astype(k)
    raise ValueError("a value is out of range")


_VALUES, _COUNTS = ("<u1", "<u2", "<i4", "<i8"), ("<u1", "<u2", "<i8")


def encode(pixel: np.ndarray, value: np.ndarray, count: np.ndarray | None = None) -> bytes:
    """Entries (pixel in its tile, value, count), sorted, in as few bytes as their ranges need."""
    pk, p = _narrow(pixel, _VALUES)
    vk, v = _narrow(value, _VALUES)
    ck, c = _narrow(count, _COUNTS) if count is not None else (0, np.zeros(0, "<u1"))
    return np.array([len(p), pk, vk, ck, count is not None], "<i8").tobytes() + p.tobytes() + v.tobytes() + c.tobytes()


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, pk, vk, ck, counted = np.frombuffer(blob, "<i8", 5).tolist()
    at, out = 40, []
    for kind in (_VALUES[pk], _VALUES[vk], _COUNTS[ck]) if counted else (_VALUES[pk], _VALUES[vk]):
        out.append(np.frombuffer(blob, kind, n, at).astype(np.int64))
        at += n * np.dtype(kind).itemsize
    return (*out, np.ones(n, np.int64))[:3]


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their summed counts."""
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key, kind="stable")
    key, count = key[order], np.concatenate([c for _, c in parts])[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[head], np.add.reduceat(count, head) if len(head) else count


def _key(pixel: np.ndarray, value: np.ndarray) -> np.ndarray:
    return pixel.astype(np.uint64) << np.uint64(32) | (value.astype(np.int64) + _LOW).astype(np.uint64)


def _parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64) - _LOW


def _by_tile(packed: DataFrame, settle) -> DataFrame:
    """Payloads of each tile, one after another, folded by ``settle`` (a fresh folder for each tile: add(payload), result())."""

    def run(it):
        tile, folder = None, None
        for b in it:
            for t, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t != tile and folder is not None:
                    yield _batch([(tile, folder.result())])
                    folder = None
                if folder is None:
                    tile, folder = t, settle()
                folder.add(blob)
        if folder is not None:
            yield _batch([(tile, folder.result())])

    return packed.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, _PACKED)


class _Counts:
    """Tables of one tile, combined whenever what came since is as much as what there was."""

    def __init__(self):
        self.parts, self.fresh, self.floor = [], 0, 0

    def add(self, blob):
        p, v, c = decode(blob)
        self.parts.append((_key(p, v), c))
        self.fresh += len(p)
        if self.fresh > max(HELD, self.floor):
            self.parts = [_combined(self.parts)]
            self.fresh, self.floor = 0, len(self.parts[0][0])

    def result(self):
        key, count = _combined(self.parts)
        return encode(*_parts(key), count)


def tile_histograms(frames: DataFrame, geom: Geometry, tile: int = TILE) -> DataFrame:
    """(tile, payload): of each tile how often each of its pixels has each value; null frames count for nothing.  Integer pixels of up to 32 bits."""
    if np.dtype(geom.dtype).kind not in "ui" or np.dtype(geom.dtype).itemsize > 4:
        raise ValueError(f"values of type {geom.dtype} can't be counted")
    pixel = np.arange(geom.pixels, dtype=np.int64)

    def run(it):
        block, size, held, n = [], 0, [], 0

        def count():
            stack = np.concatenate([_key(pixel, img) for img in block])
            stack.sort()
            head = np.flatnonzero(np.append(True, stack[1:] != stack[:-1])[: len(stack)])
            return stack[head], np.diff(np.append(head, len(stack)))

        def send():
            key, c = _combined(held) if len(held) > 1 else held[0]
            p, v = _parts(key)
            cuts = np.searchsorted(p, np.arange(0, geom.pixels + tile, tile))
            for t, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < z:
                    yield _batch([(t, encode(p[a:z] - t * tile, v[a:z], c[a:z]))])

        for b in it:
            for _, img in _frames(b, geom):
                block.append(img)
                size += 8 * len(img)
                if size >= BLOCK_BYTES:
                    held.append(count())
                    n += len(held[-1][0])
                    block, size = [], 0
                    if n > HELD:
                        held = [_combined(held)]
                        n = len(held[0][0])
                        if n > HELD // 2:
                            yield from send()
                            held, n = [], 0
        if block:
            held.append(count())
        if held:
            yield from send()

    return _by_tile(_pair(frames).mapInArrow(run, _PACKED), _Counts)


def _cuts(pixel: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, pixel[1:] != pixel[:-1])[: len(pixel)])


def medians(pixel, value, count) -> tuple[np.ndarray, np.ndarray]:
    """(pixel, median) of a decoded table, by counting."""
    head = _cuts(pixel)
    n, ends = np.add.reduceat(count, head), np.cumsum(count)
    base = ends[head] - count[head]
    at = lambda k: value[np.searchsorted(ends, base + k, "right")]
    return pixel[head], (at((n - 1) // 2) + at(n // 2)) / 2.0


def _place(pixel, geom):
    return pa.array((pixel // geom.nx).astype(np.int32)), pa.array((pixel % geom.nx).astype(np.int32))


def _tables(hist: DataFrame, work, schema: str) -> DataFrame:
    def run(it):
        for b in it:
            for t, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield work(t, *decode(blob))

    return hist.mapInArrow(run, schema)


def pixel_stats(hist: DataFrame, geom: Geometry, tile: int = TILE) -> DataFrame:
    """(y, x, med, std): each pixel's median and population deviation over all frames."""

    def work(t, p, v, c):
        where, med = medians(p, v, c)
        head = _cuts(p)
        n, times = np.add.reduceat(c, head), np.diff(np.append(head, len(p)))
        d = v - np.repeat(np.add.reduceat(v * c, head) / n, times)
        std = np.sqrt(np.add.reduceat(c * d * d, head) / n)
        return pa.RecordBatch.from_arrays([*_place(where + t * tile, geom), pa.array(med), pa.array(std)], ["y", "x", "med", "std"])

    return _tables(hist, work, "y int, x int, med double, std double")


def pixel_histograms(hist: DataFrame, geom: Geometry, width: int = 1, tile: int = TILE) -> DataFrame:
    """(y, x, bin, n): counts of each pixel's values by bin of ``width``."""

    def work(t, p, v, c):
        key, n = _combined([(_key(p, np.floor_divide(v, width)), c)])
        where, bins = _parts(key)
        return pa.RecordBatch.from_arrays([*_place(where + t * tile, geom), pa.array(bins.astype(np.int32)), pa.array(n)], ["y", "x", "bin", "n"])

    return _tables(hist, work, "y int, x int, bin int, n long")


def deviations(hist: DataFrame, centre: DataFrame | None = None) -> DataFrame:
    """(d, n): how often values lie so far from their pixel's median; with ``centre`` (histograms of other frames) from the median of these.  A pixel that ``centre`` lacks is left out."""
    rows = hist.select("tile", "payload", F.col("payload").alias("centre")) if centre is None else hist.join(centre.select("tile", F.col("payload").alias("centre")), "tile").select("tile", "payload", "centre")

    def run(it):
        for b in it:
            for blob, other in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                p, v, c = decode(blob)
                where, med = medians(*decode(other))
                at = np.searchsorted(where, p).clip(max=len(where) - 1)
                ok = where[at] == p
                twice, which = np.unique((2 * v[ok] - np.round(2 * med[at[ok]])).astype(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(twice / 2.0), pa.array(np.bincount(which, c[ok], len(twice)).astype(np.int64))], ["d", "n"])

    return rows.mapInArrow(run, "d double, n long").groupBy("d").agg(F.sum("n").alias("n"))


# The greatest values of each pixel
def _topped(pixel: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest values of each pixel, by pixel and falling value."""
    order = np.lexsort((-value, pixel))
    pixel, value = pixel[order], value[order]
    head = _cuts(pixel)
    rank = np.arange(len(pixel)) - np.repeat(head, np.diff(np.append(head, len(pixel))))
    return pixel[rank < k], value[rank < k]


class _Greatest:
    def __init__(self, k):
        self.k, self.parts, self.fresh, self.floor = k, [], 0, 0

    def take(self, pixel, value):
        self.parts.append((pixel, value))
        self.fresh += len(pixel)
        if self.fresh > max(HELD, self.floor):
            self.fold()

    def fold(self):
        self.parts = [_topped(*(np.concatenate(x) for x in zip(*self.parts)), self.k)]
        self.fresh, self.floor = 0, len(self.parts[0][0])
        return self.parts[0]

    def add(self, blob):
        self.take(*decode(blob)[:2])

    def result(self):
        return encode(*self.fold())


def greatest(values: DataFrame, geom: Geometry, k: int, value: str = "v", tile: int = TILE) -> DataFrame:
    """(tile, payload): the k greatest values of each pixel of rows (y, x, value), as a list of no more than k for each task and pixel before they are merged."""

    def run(it):
        top = _Greatest(k)
        for b in it:
            i, v = (b.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
            top.take(i, v)
        if top.parts:
            p, v = top.fold()
            cuts = np.flatnonzero(np.append(True, np.diff(p // tile) > 0)[: len(p)])
            for a, z in zip(cuts, np.append(cuts[1:], len(p))):
                t = int(p[a]) // tile
                yield _batch([(t, encode(p[a:z] - t * tile, v[a:z]))])

    rows = values.select((F.col("y") * geom.nx + F.col("x")).cast("long").alias("i"), F.col(value).cast("long").alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    return _by_tile(rows.mapInArrow(run, _PACKED), lambda: _Greatest(k))


def greatest_of_frames(frames: DataFrame, geom: Geometry, k: int, tile: int = TILE) -> DataFrame:
    """``greatest`` over dense frames: a task keeps an array of its k greatest values by pixel."""

    def run(it):
        top, block, held = None, [], 0

        def fold(arrays):
            stack = np.stack(arrays)
            return stack if len(stack) <= k else np.partition(stack, len(stack) - k, 0)[-k:]

        for b in it:
            for _, img in _frames(b, geom):
                block.append(img)
                held += img.nbytes
                if held >= BLOCK_BYTES:
                    top = fold([*([] if top is None else top), *block])
                    block, held = [], 0
        if block or top is not None:
            top = fold([*([] if top is None else top), *block])
            for t, a in enumerate(range(0, geom.pixels, tile)):
                part = top[:, a : a + tile].astype(np.int64)
                yield _batch([(t, encode(np.tile(np.arange(part.shape[1]), len(part)), part.ravel()))])

    return _by_tile(_pair(frames).mapInArrow(run, _PACKED), lambda: _Greatest(k))


def nth_greatest(top: DataFrame, geom: Geometry, ranks: list[int], tile: int = TILE) -> DataFrame:
    """(y, x, v1, v2, ...): of each pixel in ``top`` the values of these ranks (1 is the greatest), null where it has fewer."""
    names = [f"v{j + 1}" for j in range(len(ranks))]

    def work(t, p, v, _):
        head = _cuts(p)
        n = np.diff(np.append(head, len(p)))
        cols = [pa.array(v[np.minimum(head + r - 1, len(v) - 1)], pa.int64(), mask=n < r) for r in ranks]
        return pa.RecordBatch.from_arrays([*_place(p[head] + t * tile, geom), *cols], ["y", "x", *names])

    return _tables(top, work, "y int, x int, " + ", ".join(f"{n} long" for n in names))

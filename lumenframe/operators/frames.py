"""Dense frames (one row each, pixels as little-endian bytes) and their reductions.

Frames are never exploded before they are thresholded: Arrow kernels turn each batch of frames into sparse rows
or packed records in the scan's own tasks, so no reduction shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, kernels

#: Pixels of the largest calibration frame that goes to the tasks (8 bytes each).
CALIBRATION_PIXELS = 1 << 25
#: Bytes of frames that a kernel works on at once.
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Geometry:
    """Rows, columns and numpy type of a frame's pixels."""

    ny: int
    nx: int
    dtype: str = "<u2"

    @property
    def pixels(self) -> int:
        return self.ny * self.nx

    @property
    def nbytes(self) -> int:
        return self.pixels * np.dtype(self.dtype).itemsize

    def image(self, data) -> np.ndarray:
        flat = np.frombuffer(data, self.dtype)
        if len(flat) != self.pixels:
            raise ValueError(f"a frame has {len(flat)} pixels, not {self.ny} x {self.nx}")
        return flat


def by_slices(work, size: int):
    """A kernel for mapInArrow: the batch that ``work`` makes of each slice of the batches that come, or None for nothing.

    A slice has rows for SLICE_BYTES, at ``size`` bytes each, and one at least: so what a task holds beside the batch that came hangs neither on Spark's
    batches nor on the frames of a task.  A batch is let go before the next is read; what ``work`` gives must hold none of it.
    """
    rows = max(1, SLICE_BYTES // max(1, size))

    def run(it):
        for b in it:
            for a in range(0, b.num_rows, rows):
                out = work(b.slice(a, rows))
                if out is not None:
                    yield out
                out = None
            b = None

    return run


def _sparse_batch(f: list, at: list, v: list, geom: Geometry) -> pa.RecordBatch | None:
    """(frame_id, y, x, v) of lists of arrays, one of each for a frame."""
    if not f:
        return None
    f, at, v = (np.concatenate(o) for o in (f, at, v))
    return pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array((at // geom.nx).astype(np.int32)), pa.array((at % geom.nx).astype(np.int32)), pa.array(v.astype(np.int32))], ["frame_id", "y", "x", "v"])


def _frames(b: pa.RecordBatch, geom: Geometry):
    for f, data in zip(b.column(0).to_pylist(), b.column(1)):
        if data.is_valid:
            yield f, geom.image(data.as_buffer())


def _pair(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("frame_id").cast("long"), F.col("pixels").cast("binary"))


def calibration_array(table: DataFrame, geom: Geometry, column: str = "t") -> np.ndarray:
    """A per-pixel table (y, x, value) as one array; pixels that it lacks are nought.

    Tasks fold their rows into pieces of the array; the driver puts pieces together, not rows.  The array's size is the frame's, which is checked.
    """
    if geom.pixels > CALIBRATION_PIXELS:
        raise ValueError(f"a calibration frame of {geom.pixels} pixels is over the limit of {CALIBRATION_PIXELS}; tile the frames")
    piece = 1 << 16

    def run(it):
        k, held = None, None
        for b in it:
            i, v = b.column(1).to_numpy(), b.column(2).to_numpy()
            which = b.column(0).to_numpy()
            for a, z in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]]))):
                if a == z:
                    continue
                if which[a] != k:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["k", "piece"])
                    k, held = int(which[a]), np.zeros(piece, "<i8")
                held[i[a:z] - k * piece] = v[a:z]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["k", "piece"])

    rows = table.select((F.col("y") * geom.nx + F.col("x")).cast("long").alias("i"), F.col(column).cast("long").alias("v")).where(f"v IS NOT NULL AND i >= 0 AND i < {geom.pixels}")
    pieces = rows.select(F.expr(f"i div {piece}").alias("k"), "i", "v").repartition("k").sortWithinPartitions("k").mapInArrow(run, "k long, piece binary")
    out = np.zeros(-(-geom.pixels // piece) * piece, np.int64)
    for r in pieces.collect():
        out[r.k * piece : (r.k + 1) * piece] = np.frombuffer(r.piece, "<i8")
    return out[: geom.pixels]


def per_pixel(frames: DataFrame, geom: Geometry, how: str = "max") -> DataFrame:
    """(y, x, t): maximum, minimum or sum of each pixel over all frames.

    Tasks first fold their own frames into one array; only these arrays' pixels are shuffled.
    """
    fold = {"max": np.maximum, "min": np.minimum, "sum": np.add}[how]

    def run(it):
        total = None
        for b in it:
            for _, img in _frames(b, geom):
                total = img.astype(np.int64 if how == "sum" else img.dtype) if total is None else fold(total, img, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(geom.pixels, dtype=np.int64)), pa.array(total.astype(np.int64))], ["i", "t"])

    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    folded = _pair(frames).mapInArrow(run, "i long, t long").groupBy("i").agg(agg("t").alias("t"))
    return folded.select(F.expr(f"cast(i div {geom.nx} as int)").alias("y"), F.expr(f"cast(i % {geom.nx} as int)").alias("x"), F.col("t").cast("int" if how != "sum" else "long").alias("t"))


def dark_max(frames: DataFrame, geom: Geometry) -> DataFrame:
    return per_pixel(frames, geom, "max")


def _threshold(dark, eps: int, geom: Geometry):
    t = calibration_array(dark, geom) if isinstance(dark, DataFrame) else np.asarray(dark, np.int64).ravel()
    if t.shape != (geom.pixels,):
        raise ValueError("the calibration frame's shape is not the frames'")
    return Threshold(t + int(eps), geom)


class Threshold:
    """Per-pixel thresholds, also in the pixels' own type: most pixels are background and are only compared, never widened."""

    def __init__(self, t: np.ndarray, geom: Geometry):
        self.t = t
        kind = np.dtype(geom.dtype)
        self.own = None
        if kind.kind in "ui":
            info = np.iinfo(kind)
            if len(t) == 0 or t.min() >= info.min:
                self.own = np.minimum(t, info.max).astype(kind)

    def mask(self, img: np.ndarray) -> np.ndarray:
        return img > (self.own if self.own is not None else self.t)

    def foreground(self, img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the foreground in scan order, and their values above the threshold."""
        at = np.flatnonzero(self.mask(img))
        return at, img[at].astype(np.int64) - self.t[at]


def reduce_l1(frames: DataFrame, dark, eps: int, geom: Geometry) -> DataFrame:
    """(frame_id, y, x, v): pixels strictly above threshold + eps, less that.  Frames without one give no row; null frames neither."""
    t = frames.sparkSession.sparkContext.broadcast(_threshold(dark, eps, geom))

    def work(b):
        out = [[], [], []]
        for f, img in _frames(b, geom):
            at, v = t.value.foreground(img)
            for o, c in zip(out, (np.full(len(at), f), at, v)):
                o.append(c)
        return _sparse_batch(*out, geom)

    return _pair(frames).mapInArrow(by_slices(work, geom.nbytes), "frame_id long, y int, x int, v int")


def frame_stats(frames: DataFrame, dark, eps: int, geom: Geometry) -> DataFrame:
    """(frame_id, n_fg, sum_v, max_v, min_v) of every frame, without making sparse rows."""
    t = frames.sparkSession.sparkContext.broadcast(_threshold(dark, eps, geom))

    def work(b):
        rows = []
        for f, img in _frames(b, geom):
            v = t.value.foreground(img)[1]
            rows.append((f, len(v), int(v.sum()), int(v.max(initial=0)), int(v.min()) if len(v) else 0))
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["frame_id", "n_fg", "sum_v", "max_v", "min_v"])

    return _pair(frames).mapInArrow(by_slices(work, geom.nbytes), "frame_id long, n_fg long, sum_v long, max_v int, min_v int")


def pixel_sums(frames: DataFrame, geom: Geometry) -> DataFrame:
    """(frame_id, n_px, sum_adu, max_adu, moment) of every frame: pixels, their sum, the greatest, and the sum of value times place.  Frames of one id count together; null frames don't."""

    def work(b):
        place = np.arange(geom.pixels)
        rows = [(f, geom.pixels, int(v.sum()), int(v.max()), int(v @ place)) for f, v in ((f, img.astype(np.int64)) for f, img in _frames(b, geom))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["frame_id", "n_px", "sum_adu", "max_adu", "moment"]) if rows else None

    sums = _pair(frames).mapInArrow(by_slices(work, geom.nbytes), "frame_id long, n_px long, sum_adu long, max_adu long, moment long")
    return sums.groupBy("frame_id").agg(*[F.sum(c).alias(c) for c in ("n_px", "sum_adu")], F.max("max_adu").alias("max_adu"), F.sum("moment").alias("moment"))


def events(frames: DataFrame, dark, eps: int, geom: Geometry, border: str = "keep", weights: str = "above") -> DataFrame:
    """Connected components of every frame's foreground, thresholded and labelled in the same pass (see ``components.EVENT``).

    A pixel weighs what it has above threshold and eps, or with ``weights`` "dark" what it has above the dark frame alone.
    """
    from .components import EVENT, event_batch

    more = {"above": 0, "dark": int(eps)}[weights]
    t = frames.sparkSession.sparkContext.broadcast(_threshold(dark, eps, geom))

    def work(b):
        parts = [[], [], []]
        for f, img in _frames(b, geom):
            at, v = t.value.foreground(img)
            for o, c in zip(parts, (np.full(len(at), f), at, v)):
                o.append(c)
        if not parts[0]:
            return None
        f, at, v = (np.concatenate(o) for o in parts)
        return event_batch(kernels.event_rows(f, at // geom.nx, at % geom.nx, v + more, geom.ny, geom.nx, border))

    return _pair(frames).mapInArrow(by_slices(work, geom.nbytes), EVENT)


#: Packed records: the two streams of a frame and their sizes.
RECORD = "frame_id long, level int, n int, bitmap binary, vals binary, bitmap_bytes int, vals_bytes int, packed_bytes int"


def pack_frames(frames: DataFrame, dark, eps: int, geom: Geometry, *, level: int = 1, depth: int = 12, codec: str | None = "zlib", codec_level: int = 1, border: str = "keep", stat: str = "max", rounding: str | None = None, scale: bool = False, centroid: str = "weighted") -> DataFrame:
    """Reduces, packs and compresses every frame to one record.

    Level 1 keeps the foreground bitmap and its values, 2 the bitmap of event centroids and a statistic of each event (``stat``: max, mean, min),
    3 the foreground bitmap, 4 the centroid bitmap.  Events whose centroids round to one pixel collapse: the first by label gives the
    statistic.  ``codec`` None leaves the streams as they are.  Values must fit ``depth`` bits unless ``scale`` is set.
    """
    t = frames.sparkSession.sparkContext.broadcast(_threshold(dark, eps, geom))
    options = dict(level=level, depth=depth, codec=codec, codec_level=codec_level, border=border, stat=stat, rounding=rounding, scale=scale, centroid=centroid)
    packer(None, geom, **options)  # bad options fail here

    def work(b):
        pack = packer(t.value, geom, **options)
        return record_batch([pack(f, img) for f, img in _frames(b, geom)])

    return _pair(frames).mapInArrow(by_slices(work, geom.nbytes), RECORD)


_RECORD_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _RECORD_KINDS)], [c.split()[0] for c in RECORD.split(", ")])


def packer(t: Threshold | None, geom: Geometry, *, level: int = 1, depth: int = 12, codec: str | None = "zlib", codec_level: int = 1, border: str = "keep", stat: str = "max", rounding: str | None = None, scale: bool = False, centroid: str = "weighted"):
    """A function of (frame_id, image) that gives a record's fields."""
    if level not in (1, 2, 3, 4):
        raise ValueError("level must be 1, 2, 3 or 4")
    if codec and codec not in codecs.CODEC_IDS:
        raise ValueError(f"unknown codec {codec!r}")
    rounding = rounding or ("floor" if level == 2 else "half_up")

    def pack(f, img):
        if level == 3:
            mask, vals = t.mask(img), np.zeros(0, np.int64)
        elif level == 1:
            mask = t.mask(img)
            at = np.flatnonzero(mask)
            vals = img[at].astype(np.int64) - t.t[at]
        else:
            at, v = t.foreground(img)
            e = kernels.event_rows(np.full(len(at), f), at // geom.nx, at % geom.nx, v, geom.ny, geom.nx, border)
            cy, cx = centroids(e, centroid, rounding)
            spot, first = np.unique(cy * geom.nx + cx, return_index=True)
            mask = np.zeros(geom.pixels, bool)
            mask[spot] = True
            value = {"max": e["vmax"], "min": e["vmin"], "mean": e["w"] // np.maximum(1, e["area"])}[stat]
            vals = value[first] if level == 2 else np.zeros(0, np.int64)
        n = int(mask.sum())
        packed = kernels.pack_values(kernels.scaled(vals, depth) if scale else vals, depth) if level in (1, 2) else b""
        bitmap = kernels.pack_bits(mask)
        raw = len(packed)
        if codec:
            bitmap, packed = codecs.compress(bitmap, codec, codec_level), codecs.compress(packed, codec, codec_level) if level in (1, 2) else b""
        return f, level, n, bitmap, packed, len(bitmap), len(packed), raw

    return pack


def centroids(e: dict[str, np.ndarray], scheme: str = "weighted", rounding: str = "half_up") -> tuple[np.ndarray, np.ndarray]:
    """Pixel of each event: weighted centre, peak pixel, or the first pixel in scan order ("unweighted" is the peak's alias for constant values)."""
    if scheme == "peak":
        return e["py"], e["px"]
    if scheme != "weighted":
        raise ValueError(f"unknown centroid scheme {scheme!r}")
    w = np.maximum(1, e["w"])
    if rounding == "half_up":
        return (2 * e["wy"] + w) // (2 * w), (2 * e["wx"] + w) // (2 * w)
    if rounding == "floor":
        return e["wy"] // w, e["wx"] // w
    if rounding == "half_even":
        even = lambda s: (q := s // w) + ((2 * (s - q * w) > w) | ((2 * (s - q * w) == w) & (q % 2 == 1)))
        return even(e["wy"]), even(e["wx"])
    raise ValueError(f"unknown rounding {rounding!r}")


def unpack_records(records: DataFrame, geom: Geometry, *, depth: int = 12, codec: str | None = "zlib") -> DataFrame:
    """(frame_id, y, x, v) of packed records of any level; levels without values have v = 1.  A damaged record fails."""

    def work(b):
        out = [[], [], []]
        for f, level, n, bitmap, vals in zip(*(b.column(k).to_pylist() for k in range(5))):
            at = np.flatnonzero(kernels.unpack_bits(codecs.decompress(bitmap, codec) if codec else bitmap, geom.pixels))
            if len(at) != n:
                raise ValueError(f"frame {f}: {len(at)} pixels, not {n}")
            v = kernels.unpack_values(codecs.decompress(vals, codec) if codec else vals, depth, n) if level in (1, 2) else np.ones(n, np.int64)
            for o, c in zip(out, (np.full(n, f), at, v)):
                o.append(c)
        return _sparse_batch(*out, geom)

    return records.select("frame_id", "level", "n", "bitmap", "vals").mapInArrow(by_slices(work, geom.nbytes), "frame_id long, y int, x int, v int")


def dense(l1: DataFrame, geom: Geometry, frames: DataFrame | None = None) -> DataFrame:
    """(frame_id, pixels): sparse rows as whole frames; with ``frames`` (frame_id) also frames without a pixel."""
    rows = l1.groupBy("frame_id").agg(F.collect_list(F.struct((F.col("y") * geom.nx + F.col("x")).cast("int").alias("i"), F.col("v").cast("int").alias("v"))).alias("s"))
    if frames is not None:
        rows = frames.select(F.col("frame_id").cast("long")).distinct().join(rows, "frame_id", "left")

    def work(b):
        ids, out = b.column(0).to_pylist(), []
        for s in b.column(1):
            img = np.zeros(geom.pixels, geom.dtype)
            if s.is_valid:
                flat = s.values
                img[flat.field("i").to_numpy()] = flat.field("v").to_numpy()
            out.append(img.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["frame_id", "pixels"])

    return rows.mapInArrow(by_slices(work, geom.nbytes), "frame_id long, pixels binary")


def recalibrate(l1: DataFrame, old, new, eps: int, geom: Geometry, frames: DataFrame | None = None) -> DataFrame:
    """L1 rows as another calibration frame would give them: v + old - (new + eps) on every pixel, clipped to 16 bits, noughts dropped.

    Where no pixel's threshold falls, pixels that were background stay so, and the sparse rows are enough; else whole
    frames are rebuilt in the kernel.
    """
    a = calibration_array(old, geom) if isinstance(old, DataFrame) else np.asarray(old).ravel()
    b_ = calibration_array(new, geom) if isinstance(new, DataFrame) else np.asarray(new).ravel()
    shift = a - (b_ + int(eps))
    delta = l1.sparkSession.sparkContext.broadcast(shift)
    if (shift < 1).all():

        def sparse(it):
            for b in it:
                y, x, v = (b.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
                v = np.clip(v + delta.value[y * geom.nx + x], 0, 65535)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(v.astype(np.int32))], b.schema.names).filter(pa.array(v > 0))

        return l1.select(F.col("frame_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("v").cast("int")).mapInArrow(sparse, "frame_id long, y int, x int, v int")

    whole = Geometry(geom.ny, geom.nx, "<i4")

    def work(b):
        out = [[], [], []]
        for f, img in _frames(b, whole):
            v = np.clip(img.astype(np.int64) + delta.value, 0, 65535)
            at = np.flatnonzero(v)
            for o, c in zip(out, (np.full(len(at), f), at, v[at])):
                o.append(c)
        return _sparse_batch(*out, geom)

    return dense(l1, whole, frames).mapInArrow(by_slices(work, whole.nbytes), "frame_id long, y int, x int, v int")


def pixels(frames: DataFrame, geom: Geometry) -> DataFrame:
    """(frame_id, y, x, adu): every pixel as a row; for statistics over small frames or a few of them."""

    def run(it):
        index = np.arange(geom.pixels)
        y, x = (index // geom.nx).astype(np.int32), (index % geom.nx).astype(np.int32)
        for b in it:
            for f, img in _frames(b, geom):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(geom.pixels, f)), pa.array(y), pa.array(x), pa.array(img.astype(np.int32))], ["frame_id", "y", "x", "adu"])

    return _pair(frames).mapInArrow(run, "frame_id long, y int, x int, adu int")

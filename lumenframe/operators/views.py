"""Regions of interest, sampling, frame fractionation, doses and spectra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Geometry, by_slices


def frame_range(frames: DataFrame, first: int = 0, count: int = -1) -> DataFrame:
    keep = F.col("frame_id") >= first
    return frames.where(keep if count < 0 else keep & (F.col("frame_id") < first + count))


def every_nth(frames: DataFrame, gap: int) -> DataFrame:
    """Validation frames: those whose absolute index is a multiple of gap; gap <= 0 gives none."""
    return frames.where(F.col("frame_id") % gap == 0) if gap > 0 else frames.where(F.lit(False))


def central_roi(rows: DataFrame, geom: Geometry, size: int = 128) -> tuple[DataFrame, Geometry]:
    """Pixels of the central region of at most size x size, and its geometry; coordinates stay the frame's."""
    h, w = min(size, geom.ny), min(size, geom.nx)
    y0, x0 = (geom.ny - h) // 2, (geom.nx - w) // 2
    return rows.where(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1)), Geometry(h, w, geom.dtype)


def sub_volume(rows: DataFrame, z=None, y=None, x=None) -> DataFrame:
    """Slicing of pixel rows by an index or a slice along each axis, steps included."""
    for col, s in (("frame_id", z), ("y", y), ("x", x)):
        if s is None:
            continue
        if isinstance(s, slice):
            start, step = s.start or 0, s.step or 1
            if start < 0 or (s.stop or 0) < 0 or step < 1:
                raise ValueError("only forward slices of non-negative bounds")
            rows = rows.where(F.col(col) >= start)
            rows = rows.where(F.col(col) < s.stop) if s.stop is not None else rows
            rows = rows.where((F.col(col) - start) % step == 0) if step > 1 else rows
        else:
            rows = rows.where(F.col(col) == s)
    return rows


def roi_counts(l1: DataFrame, rois: DataFrame, limit: int = 10_000) -> DataFrame:
    """(roi_id, frame_id, n): foreground pixels strictly inside each rectangle (roi_id, x0, y0, w, h).

    The rectangles are counted first; up to ``limit`` they go to every task, beyond they are cut to tiles and joined by tile.
    """
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y0") + F.col("h"))
    if rois.count() <= limit:
        joined = l1.join(F.broadcast(rois), inside)
    else:
        tile = 64
        spread = rois.select("*", F.explode(F.sequence(F.expr(f"x0 div {tile}"), F.expr(f"(x0 + w) div {tile}"))).alias("tx")).select("*", F.explode(F.sequence(F.expr(f"y0 div {tile}"), F.expr(f"(y0 + h) div {tile}"))).alias("ty"))
        joined = l1.withColumn("tx", F.expr(f"cast(x div {tile} as bigint)")).withColumn("ty", F.expr(f"cast(y div {tile} as bigint)")).join(spread.withColumn("tx", F.col("tx").cast("long")).withColumn("ty", F.col("ty").cast("long")), ["tx", "ty"]).where(inside)
    return joined.groupBy("roi_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))


def fraction_view(l1: DataFrame, frames_per_bin: int, start: int = 0) -> DataFrame:
    """(bin, y, x, sum_v): sums of every ``frames_per_bin`` frames from ``start`` on."""
    b = F.expr(f"cast((frame_id - {start}) div {frames_per_bin} as int)").alias("bin")
    return l1.where(F.col("frame_id") >= start).groupBy(b, "y", "x").agg(F.sum("v").alias("sum_v"))


def view_percentile(view: DataFrame, geom: Geometry, p: float, bins: DataFrame | None = None) -> DataFrame:
    """(bin, p): interpolated percentile of each dense view; of a bin of ``bins`` without a count it is nought.

    Background pixels are not made: a view's sorted values begin with as many noughts as pixels are missing, so the two order statistics are picked
    from the ranked sparse values.
    """
    from pyspark.sql import Window as W

    n, at = geom.pixels, p * (geom.pixels - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    ranked = view.where("sum_v > 0").withColumn("k", F.row_number().over(W.partitionBy("bin").orderBy(F.col("sum_v").desc())) - 1)
    pick = lambda r: F.coalesce(F.max(F.when(F.col("k") == n - 1 - r, F.col("sum_v"))), F.lit(0))
    found = ranked.where(F.col("k") <= n - 1 - lo).groupBy("bin").agg((pick(lo) + (pick(hi) - pick(lo)) * F.lit(at - lo)).cast("double").alias("p"))
    return found if bins is None else bins.select("bin").distinct().join(found, "bin", "left").select("bin", F.coalesce("p", F.lit(0.0)).alias("p"))


def dose_summary(l1: DataFrame, geom: Geometry, frames_per_bin: int, start: int = 0, frames: DataFrame | None = None) -> DataFrame:
    """(bin, total, rate, cumulative): counts of each bin, for each pixel and frame, and bin number times rate.  With ``frames`` (frame_id) bins without a count have noughts, else no row."""
    t = fraction_view(l1, frames_per_bin, start).groupBy("bin").agg(F.sum("sum_v").alias("total"))
    if frames is not None:
        t = _bins(frames, frames_per_bin, start).join(t, "bin", "left").select("bin", F.coalesce("total", F.lit(0)).alias("total"))
    rate = F.col("total") / F.lit(float(geom.pixels * frames_per_bin))
    return t.select("bin", "total", rate.alias("rate"), (F.col("bin") * rate).alias("cumulative"))


def _bins(frames: DataFrame, frames_per_bin: int, start: int) -> DataFrame:
    return frames.where(F.col("frame_id") >= start).select(F.expr(f"cast((frame_id - {start}) div {frames_per_bin} as int)").alias("bin")).distinct()


def text_lines(frames: DataFrame, geom: Geometry) -> DataFrame:
    """(frame_id, y, line): each row of each frame as text, every value followed by a space."""

    def run(it):
        y = np.arange(geom.ny, dtype=np.int32)
        for b in it:
            for f, data in zip(b.column(0).to_pylist(), b.column(1)):
                lines = ["".join(f"{v} " for v in row) for row in geom.image(data.as_buffer()).reshape(geom.ny, geom.nx).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(geom.ny, f)), pa.array(y), pa.array(lines)], ["frame_id", "y", "line"])

    return frames.select(F.col("frame_id").cast("long"), "pixels").where("frame_id IS NOT NULL AND pixels IS NOT NULL").mapInArrow(run, "frame_id long, y int, line string")


def spectrum(frames: DataFrame, geom: Geometry) -> DataFrame:
    """(frame_id, spectrum): log magnitude of the centred 2-D Fourier transform; noughts take the smallest finite value."""

    def work(b):
        ids, out = b.column(0).to_pylist(), np.empty((b.num_rows, geom.pixels))
        for s, data in zip(out, b.column(1)):
            mag = np.abs(np.fft.fftshift(np.fft.fft2(geom.image(data.as_buffer()).reshape(geom.ny, geom.nx))))
            with np.errstate(divide="ignore"):
                np.log(mag.ravel(), out=s)
            finite = s[np.isfinite(s)]
            s[~np.isfinite(s)] = finite.min() if len(finite) else 0.0
        ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * geom.pixels)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["frame_id", "spectrum"])

    # a spectrum has eight bytes a pixel
    return frames.select(F.col("frame_id").cast("long"), "pixels").where("pixels IS NOT NULL").mapInArrow(by_slices(work, 8 * geom.pixels), "frame_id long, spectrum array<double>")


def transposed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"y": "__y"}).withColumnRenamed("x", "y").withColumnRenamed("__y", "x")

"""Noise statistics, thresholds and histograms of calibration frames."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_sigma, level_components
from . import tiles
from .frames import _frames, _pair, calibration_array


def row_medians(frames: DataFrame, geom) -> DataFrame:
    """(frame_id, y, med): the median of each row of each frame, in the frame's own task."""

    def run(it):
        y = np.arange(geom.ny, dtype=np.int32)
        for b in it:
            for f, img in _frames(b, geom):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(geom.ny, f)), pa.array(y), pa.array(np.median(img.reshape(geom.ny, geom.nx), axis=1).astype(np.float64))], ["frame_id", "y", "med"])

    return _pair(frames).mapInArrow(run, "frame_id long, y int, med double")


def equal_histogram(values: DataFrame, column: str = "d", bins: int = 100, weight: str | None = None) -> DataFrame:
    """(bin, n), bins 1 to ``bins`` of equal width from the least to the greatest value, the last closed.  Values that are all alike fall into bin 1; ``weight`` is a column of counts."""
    ends = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    v = F.col(column).cast("double")
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1)).otherwise(1)
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    return values.crossJoin(F.broadcast(ends)).where(v.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(n.alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))  # ends is one row


def global_sigma(deviations: DataFrame, bins: int = 100) -> float:
    """Width of the Gaussian fitted to values less their pixel's median (d, n): the histogram is distributed, its ``bins`` counts are fitted here."""
    rows = equal_histogram(deviations, bins=bins, weight="n").collect()
    if not rows:
        return 0.0
    lo, hi = rows[0].lo, rows[0].hi
    counts = np.zeros(bins)
    for r in rows:
        counts[r.bin - 1] = r.n
    return gaussian_sigma(counts, lo + (np.arange(bins) + 0.5) * (hi - lo) / bins)


def histogram_moments(hist: DataFrame) -> DataFrame:
    """Weighted mean and deviation of a histogram (c, n)."""
    mean = F.sum(F.col("c") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("c") * F.col("c") * F.col("n")) / F.sum("n")
    return hist.agg(mean.alias("mean"), F.sqrt(square - mean * mean).alias("sigma"))


def sigma_thresholds(med: DataFrame, sigma: float, n: int) -> DataFrame:
    """(i, y, x, t): floor(median + sigma * i), i from 0 to n - 1."""
    return med.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "y", "x", "med").select("i", "y", "x", F.floor(F.col("med") + F.lit(float(sigma)) * F.col("i")).cast("int").alias("t"))


def topk_midpoint(values: DataFrame, n: int, geom, value: str = "v", tile: int = tiles.TILE) -> DataFrame:
    """(y, x, t): midway between each pixel's n-th and (n+1)-th greatest value; null where it has fewer, no row where it has none."""
    top = tiles.nth_greatest(tiles.greatest(values, geom, n + 1, value, tile), geom, [n, n + 1], tile)
    return top.select("y", "x", ((F.col("v1") + F.col("v2")) / 2.0).alias("t"))


def gain_threshold(values: DataFrame, n_events: int, geom, none: int = 4096, value: str = "v", tile: int = tiles.TILE) -> DataFrame:
    """(y, x, t) of every pixel: one above the value that more than ``n_events`` of a pixel's values reach; ``none`` where there is no such value."""
    top = tiles.greatest(values, geom, n_events + 1, value, tile)
    every = values.sparkSession.range(-(-geom.pixels // tile)).select(F.col("id").cast("int").alias("tile"))

    def run(it):
        for b in it:
            for t, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cut = np.full(min(tile, geom.pixels - t * tile), none, np.int64)
                if blob is not None:
                    p, v, _ = tiles.decode(blob)
                    head = np.flatnonzero(np.append(True, p[1:] != p[:-1])[: len(p)])
                    enough = np.diff(np.append(head, len(p))) > n_events
                    cut[p[head[enough]]] = v[head[enough] + n_events] + 1
                i = np.arange(len(cut)) + t * tile
                yield pa.RecordBatch.from_arrays([pa.array((i // geom.nx).astype(np.int32)), pa.array((i % geom.nx).astype(np.int32)), pa.array(cut.astype(np.int32))], ["y", "x", "t"])

    return every.join(top, "tile", "left").select("tile", "payload").mapInArrow(run, "y int, x int, t int")


def common_mode(frames: DataFrame, geom, block: int) -> DataFrame:
    """(frame_id, y, x, adu): values less the median of their frame's column block and column parity; each frame in its own task, without a shuffle."""

    def run(it):
        y, x = (a.ravel().astype(np.int32) for a in np.indices((geom.ny, geom.nx)))
        for b in it:
            for f, data in zip(b.column(0).to_pylist(), b.column(1)):
                img = geom.image(data.as_buffer()).reshape(geom.ny, geom.nx).astype(np.float64)
                for c in range(0, geom.nx, block):
                    for parity in (0, 1):
                        cols = np.arange(c, min(c + block, geom.nx))
                        cols = cols[cols % 2 == parity]
                        if len(cols):
                            img[:, cols] -= np.median(img[:, cols])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(geom.pixels, f)), pa.array(y), pa.array(x), pa.array(img.ravel())], ["frame_id", "y", "x", "adu"])

    rows = frames.select(F.col("frame_id").cast("long").alias("frame_id"), "pixels").where("frame_id IS NOT NULL AND pixels IS NOT NULL")
    return rows.mapInArrow(run, "frame_id long, y int, x int, adu double")


def sigma_counts(frames: DataFrame, med: DataFrame, sigma: float, n_sigmas: int, geom) -> DataFrame:
    """(i, n_frames, n_events, n_fg): events and foreground pixels of all frames at each threshold floor(median + sigma * i), in one pass over the frames.

    The foreground of a threshold lies in that of each lower one: a frame's components at all of them come from one forest (``kernels.level_components``).
    """
    if sigma < 0:
        raise ValueError("sigma is negative")
    centre = frames.sparkSession.sparkContext.broadcast(calibration_array(med.select("y", "x", (F.col("med") * 2).cast("long").alias("t")), geom) / 2.0)

    def run(it):
        for b in it:
            cols: list[list] = [[], [], []]
            for _, img in _frames(b, geom):
                level = np.zeros(geom.pixels, np.int32)
                for i in range(n_sigmas):
                    level += img > np.floor(centre.value + sigma * i)
                n_events, n_fg = level_components(level.reshape(geom.ny, geom.nx), n_sigmas)
                for col, v in zip(cols, (range(n_sigmas), n_events.tolist(), n_fg.tolist())):
                    col += v
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["i", "n_events", "n_fg"])

    rows = _pair(frames).mapInArrow(run, "i int, n_events long, n_fg long")
    return rows.groupBy("i").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n_events").alias("n_events"), F.sum("n_fg").alias("n_fg"))


def sigma_report(frames: DataFrame, geom, n_sigmas: int, n_stats: int | None = None, accurate_sigma: int | None = None, sigma: float | None = None):
    """The calibration run: (thresholds (i, y, x, t), report (i, n_frames, n_events, fg_share, rate), accurate threshold (y, x, t) or None).

    Medians are over all frames; the noise's width (unless given) and the counts for each of ``n_sigmas`` thresholds are over the ``n_stats`` last frames (all by default).
    ``accurate_sigma`` asks for the threshold under which each pixel has about as many events as the run's rate at that sigma lets expect: midway between
    its two greatest values at that rank; there is none where fewer than two are expected.
    """
    frames = frames.select(F.col("frame_id").cast("long").alias("frame_id"), "pixels").where("frame_id IS NOT NULL AND pixels IS NOT NULL")
    hist = tiles.tile_histograms(frames, geom)
    stats = tiles.pixel_stats(hist, geom)
    last = frames
    n_frames = frames.count()
    if n_stats is not None and n_stats < n_frames:
        least = frames.select("frame_id").orderBy(F.desc("frame_id")).limit(n_stats).agg(F.min("frame_id")).first()[0]
        last = frames.where(F.col("frame_id") >= least)
    if sigma is None:
        sigma = global_sigma(tiles.deviations(hist) if last is frames else tiles.deviations(tiles.tile_histograms(last, geom), hist))
    thresholds = sigma_thresholds(stats, sigma, n_sigmas)
    area = lambda c: F.col(c) / (F.col("n_frames") * F.lit(float(geom.pixels)))
    report = sigma_counts(last, stats, sigma, n_sigmas, geom).select("i", "n_frames", "n_events", area("n_fg").alias("fg_share"), area("n_events").alias("rate"))
    exact = None
    if accurate_sigma is not None:
        row = report.where(F.col("i") == accurate_sigma).first()
        expected = math.ceil(n_frames * row.rate) if row else 0
        if expected >= 2:
            top = tiles.nth_greatest(tiles.greatest_of_frames(frames, geom, expected + 1), geom, [expected, expected + 1])
            exact = top.select("y", "x", ((F.col("v1") + F.col("v2")) / 2.0).alias("t"))
    return thresholds, report, exact


def tail_probability(threshold: float, mean: float, sigma: float) -> float:
    """Share of Gaussian noise above a threshold."""
    return 0.5 * math.erfc((threshold - mean) / (sigma * math.sqrt(2)))

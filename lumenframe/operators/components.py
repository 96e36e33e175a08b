"""Connected components of sparse pixels and what is counted from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalar import ratio_rounded
from .frames import Geometry

EVENT = "frame_id long, lab long, area long, w long, wy long, wx long, vmax int, vmin int, py int, px int"
_KINDS = [pa.int64()] * 6 + [pa.int32()] * 4


def event_batch(e: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = [c.split()[0] for c in EVENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(e[k]).cast(t) for k, t in zip(names, _KINDS)], names)


def label_components(l1: DataFrame, geom: Geometry, border: str = "keep") -> DataFrame:
    """Events of sparse rows (frame_id, y, x, v): label (smallest y * nx + x), area and sums.

    Rows meet by frame; each task labels all its frames at once, streaming them in frame order, so a task holds
    one Arrow batch and the frame that it cuts.  ``border="drop"`` leaves out the outermost pixels.
    """

    def run(it):
        held = None
        for b in it:
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last frame may go on in the next batch
            if cut:
                yield event_batch(kernels.event_rows(*(c[:cut] for c in cols), geom.ny, geom.nx, border))
            held = [c[cut:] for c in cols]
        if held is not None:
            yield event_batch(kernels.event_rows(*held, geom.ny, geom.nx, border))

    rows = l1.select(F.col("frame_id").cast("long").alias("frame_id"), "y", "x", "v").where("frame_id IS NOT NULL")
    return rows.repartition("frame_id").sortWithinPartitions("frame_id").mapInArrow(run, EVENT)


def counts(events: DataFrame, rounding: str = "half_up", centroid: str = "weighted") -> DataFrame:
    """Distinct (frame_id, cy, cx) of events: electron counting; events that fall on one pixel collapse."""
    if centroid == "peak":
        return events.select("frame_id", F.col("py").alias("cy"), F.col("px").alias("cx")).distinct()
    return events.select("frame_id", ratio_rounded("wy", "w", rounding).alias("cy"), ratio_rounded("wx", "w", rounding).alias("cx")).distinct()


def area_filter(events: DataFrame, area: int) -> DataFrame:
    return events.where(F.col("area") > area)


def dose_rate(events: DataFrame, geom: Geometry, frames: DataFrame) -> DataFrame:
    """(frame_id, n_events, rate): events for each pixel of each of ``frames``; a frame without events has noughts."""
    found = events.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    every = frames.select(F.col("frame_id").cast("long").alias("frame_id")).where("frame_id IS NOT NULL").distinct()
    counted = every.join(found, "frame_id", "left").select("frame_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_events"))
    return counted.withColumn("rate", F.col("n_events") / F.lit(float(geom.pixels)))


def mean_dose(rates: DataFrame, n_frames: int, first: int = 100) -> DataFrame:
    """(rate, frames, n_events): average rate of the first frames, those without events included, and the events to expect in the run's ``n_frames`` at one a pixel."""
    return rates.where(F.col("frame_id") < first).agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("frames")).withColumn("n_events", F.floor(F.lit(n_frames) * F.col("rate")))


def unmatched(left: DataFrame, right: DataFrame, reach: int = 1, frames_per_group: int = 16) -> DataFrame:
    """Points (frame_id, cy, cx) of left without one of right within ``reach`` in both directions; all columns of left stay, a point with a null is without one.

    On the pixel lattice a distance of at most sqrt 2 is a reach of 1.  Both sides meet by short ranges of frames, each point shuffled once; there the points of right
    are sorted by frame and cell, and each point of left looks for its neighbouring cells.
    """
    block = next(n for n in ("__block", "__block_", "__block__") if n not in left.columns)
    group = lambda f: F.floor(F.col(f) / frames_per_group).cast("long")
    kinds = [(f.name, f.dataType) for f in left.schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    empty = to_arrow_schema(StructType([StructField(n, k) for n, k in kinds])).empty_table()

    def points(t, names):
        cols = [pc.cast(t.column(c), pa.int64()) for c in names]
        ok = pc.and_(pc.and_(pc.is_valid(cols[0]), pc.is_valid(cols[1])), pc.is_valid(cols[2])).to_numpy(zero_copy_only=False).astype(bool)
        return ok, [c.fill_null(0).to_numpy() for c in cols]

    names = [n for n, _ in kinds]

    def work(l, r):
        if not r.num_rows or not l.num_rows:  # a side without the group comes without columns
            return l.select(names) if l.num_rows else empty
        ok, (f, y, x) = points(l, ("frame_id", "cy", "cx"))
        some, (g, v, u) = points(r, ("__f", "__y", "__x"))
        out = np.zeros(len(f), bool)
        if some.any() and ok.any():
            lows = [min(a[ok].min(), b[some].min()) - reach for a, b in ((y, v), (x, u))]
            wide = max(x[ok].max(), u[some].max()) + reach + 1 - lows[1]
            high = max(y[ok].max(), v[some].max()) + reach + 1 - lows[0]
            first = min(f[ok].min(), g[some].min())
            cell = lambda a, b, c: ((a - first) * high + b - lows[0]) * wide + c - lows[1]
            there = np.unique(cell(g[some], v[some], u[some]))
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    want = cell(f, y + dy, x + dx)
                    out |= there[np.searchsorted(there, want).clip(max=len(there) - 1)] == want
            out &= ok
        return l.filter(pa.array(~out)).select(names)

    # columns of their own, as both sides may come from one table
    cells = right.select(*[F.col(c).cast("long").alias(n) for c, n in (("frame_id", "__f"), ("cy", "__y"), ("cx", "__x"))]).withColumn("__g", group("__f"))
    schema = StructType([StructField(n, k) for n, k in kinds])
    return left.withColumn(block, group("frame_id")).groupBy(block).cogroup(cells.groupBy("__g")).applyInArrow(work, schema)

"""State that outlives a batch: frames' numbers across chunks, and views of a running number of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.frames import Geometry, _frames, _threshold

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_store(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Numbering(StatefulProcessor):
    """Of each run the next chunk that is due, its first frame's number, and the sizes of chunks that came before their turn."""

    def __init__(self, first: int):
        self.first = first

    def init(self, handle):
        self.due = handle.getValueState("due", "chunk_id long, run_offset long")
        self.early = handle.getMapState("early", "chunk_id long", "n long")

    def handleInputRows(self, key, rows, timerValues):
        due, offset = self.due.get() if self.due.exists() else (self.first, 0)
        for pdf in rows:
            for chunk, n in zip(pdf["chunk_id"].tolist(), pdf["n"].tolist()):
                if chunk >= due:
                    self.early.updateValue((chunk,), (n,))
        out = []
        while self.early.containsKey((due,)):
            n = self.early.getValue((due,))[0]
            self.early.removeKey((due,))
            out.append((key[0], due, n, offset))
            due, offset = due + 1, offset + n
        self.due.update((due, offset))
        yield pd.DataFrame(out, columns=["run", "chunk_id", "n", "run_offset"])

    def close(self):
        pass


def number_chunks(chunks: DataFrame, first: int = 0) -> DataFrame:
    """(run, chunk_id, n, run_offset) of a stream of chunks (run, chunk_id, n): the frames of a run's chunks before each one.

    A run's chunks count from ``first`` without a gap.  One that arrives before its turn waits in the state, so the numbers hang on the chunks alone, not
    on batches, order of arrival or restarts; one that comes again is passed over.  A row is a chunk, not a frame.
    """
    _state_store(chunks)
    rows = chunks.select(F.col("run").cast("string"), F.col("chunk_id").cast("long"), F.col("n").cast("long"))
    return rows.groupBy("run").transformWithStateInPandas(_Numbering(first), "run string, chunk_id long, n long, run_offset long", "append", "none")


SPARSE = "band int, frame_id long, at binary, v binary"


def banded(frames: DataFrame, dark, eps: int, geom: Geometry, bands: int = 8) -> DataFrame:
    """(band, frame_id, at, v): each frame's foreground by bands of rows, as packed indices and values; a band without any has an empty row, so every band knows of every frame."""
    t = frames.sparkSession.sparkContext.broadcast(_threshold(dark, eps, geom))
    edges = np.linspace(0, geom.ny, bands + 1).round().astype(np.int64) * geom.nx

    def run(it):
        for b in it:
            cols: list[list] = [[], [], [], []]
            for f, img in _frames(b, geom):
                at, v = t.value.foreground(img)
                cuts = np.searchsorted(at, edges)
                for k in range(bands):
                    part = slice(cuts[k], cuts[k + 1])
                    for col, x in zip(cols, (k, f, at[part].astype("<i4").tobytes(), v[part].astype("<i4").tobytes())):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["band", "frame_id", "at", "v"])

    return frames.select(F.col("frame_id").cast("long"), F.col("pixels").cast("binary")).mapInArrow(run, SPARSE)


VIEW = "band int, start long, last long, n_frames int, missing array<long>, late long, at binary, total binary"


class _Views(StatefulProcessor):
    """Frames of a band that are not in a view yet, where the next view starts, and the greatest frame seen."""

    def __init__(self, frames: int, slack: int, first: int, timeout_ms: int):
        self.frames, self.slack, self.first, self.timeout = frames, slack, first, timeout_ms

    def init(self, handle):
        self.handle = handle
        self.mark = handle.getValueState("mark", "start long, seen long, late long")
        self.held = handle.getMapState("held", "frame_id long", "at binary, v binary")

    def _marks(self):
        return self.mark.get() if self.mark.exists() else (self.first, -1, 0)

    def _view(self, band, start, ids, late):
        at, v = [], []
        for k in ids:
            a, b = self.held.getValue((k,))
            self.held.removeKey((k,))
            at.append(np.frombuffer(a, "<i4"))
            v.append(np.frombuffer(b, "<i4").astype(np.int64))
        spot, where = np.unique(np.concatenate(at), return_inverse=True)
        total = np.bincount(where, np.concatenate(v), len(spot)).astype("<i8")
        missing = sorted(set(range(start, ids[-1])) - set(ids))
        return (band, start, ids[-1], len(ids), missing, late, spot.astype("<i4").tobytes(), total.tobytes())

    def _closed(self, band, start, seen, late, ids, out):
        """Views that are full, or whose frames must all have come as later ones are here; (start, late, ids that stay)."""
        while ids:
            mine = [k for k in ids if k < start + self.frames]
            if len(mine) < self.frames and seen < start + self.frames + self.slack:
                break
            if not mine:
                start = ids[0]  # nothing for a whole view: the next one starts at the next frame
                continue
            out.append(self._view(band, start, mine, late))
            start, late, ids = mine[-1] + 1, 0, ids[len(mine) :]
        return start, late, ids

    def _settle(self, key, timerValues, force: bool, rows=()):
        start, seen, late = self._marks()
        for pdf in rows:
            for f, a, v in zip(pdf["frame_id"].tolist(), pdf["at"], pdf["v"]):
                if f < start:
                    late += 1
                    continue
                self.held.updateValue((f,), (bytes(a), bytes(v)))
                seen = max(seen, f)
        ids, out = sorted(k[0] for k in self.held.keys()), []
        start, late, ids = self._closed(key[0], start, seen, late, ids, out)
        if force and ids:
            start = max(start, ids[0]) if not [k for k in ids if k < start + self.frames] else start
            mine = [k for k in ids if k < start + self.frames]
            out.append(self._view(key[0], start, mine, late))
            start, late, ids = self._closed(key[0], mine[-1] + 1, seen, 0, ids[len(mine) :], out)
        self.mark.update((start, seen, late))
        if self.timeout:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if ids:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        return pd.DataFrame(out, columns=[c.split()[0] for c in VIEW.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        yield self._settle(key, timerValues, False, rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._settle(key, timerValues, True)

    def close(self):
        pass


def count_views(sparse: DataFrame, frames: int, *, slack: int = 0, first: int = 0, timeout_ms: int = 0) -> DataFrame:
    """Views (band, start, last, n_frames, missing, late, at, total) of every ``frames`` frames of a stream of ``banded`` rows.

    A view takes the frames from ``start`` on.  It closes when it has all of them, or when a frame ``slack`` beyond its end is here, or, with ``timeout_ms``,
    when nothing has come for so long; the next one starts after the last frame that it got.  Frames that it lacks are listed;
    frames that come after their view are counted in the next one's ``late``.  What is open stays in the state.
    """
    _state_store(sparse)
    return sparse.groupBy("band").transformWithStateInPandas(_Views(frames, slack, first, timeout_ms), VIEW, "append", "processingTime" if timeout_ms else "none")


def view_pixels(views: DataFrame, geom: Geometry) -> DataFrame:
    """(start, y, x, sum_v): the pixels of views."""

    def run(it):
        for b in it:
            for start, at, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                i, v = np.frombuffer(at, "<i4"), np.frombuffer(total, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), start)), pa.array((i // geom.nx).astype(np.int32)), pa.array((i % geom.nx).astype(np.int32)), pa.array(v)], ["start", "y", "x", "sum_v"])

    return views.select("start", "at", "total").mapInArrow(run, "start long, y int, x int, sum_v long")

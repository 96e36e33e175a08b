"""Figures of a run: observed while frames are reduced, and a log of a stream's batches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import store
from .frames import Geometry

METRICS = "metric string, value double"


def _sums(geom: Geometry):
    """Of packed records: frames, foreground or event pixels, and bytes raw, reduced and compressed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("run_frames"),
        total(F.col("n")).alias("run_pixels"),
        (F.count(F.lit(1)) * (geom.pixels * 2)).alias("raw_bytes"),
        (F.count(F.lit(1)) * -(-geom.pixels // 8) + total(F.col("packed_bytes"))).alias("reduced_bytes"),
        total(F.col("bitmap_bytes") + F.col("vals_bytes")).alias("compressed_bytes"),
        F.max("frame_id").alias("last_frame"),
    ]


def observed(records: DataFrame, geom: Geometry, name: str | Observation) -> DataFrame:
    """Packed records that leave their sums behind as they pass: with an ``Observation`` for who holds it, with a name for a stream's listeners."""
    return records.observe(name, *_sums(geom))


def measured(records: DataFrame, geom: Geometry, write) -> dict:
    """Writes records by ``write(records)`` and returns their sums and the milliseconds that it took: one pass, no second look at what was written."""
    seen = Observation()
    began = time.perf_counter()
    write(observed(records, geom, seen))
    return {**seen.get, "run_ms": round(1000 * (time.perf_counter() - began))}


def metric_rows(spark: SparkSession, metrics: dict) -> DataFrame:
    """(metric, value) rows of a few figures, as ``layout.metric_totals`` adds them up over runs."""
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in sorted(metrics.items())], METRICS)


class RunLog(StreamingQueryListener):
    """Notes what streams do in a folder: a file for each start, batch and end, under the run's id, so a note that is made again replaces itself."""

    def __init__(self, path: str, clock=time.time):
        self.path, self.clock = path, clock
        store.make_folder(path)

    def _note(self, run, key: str, **what):
        store.write_json(store.join(self.path, f"{run}-{key}.json"), {"run": str(run), "at": self.clock(), **what})

    def onQueryStarted(self, event):
        self._note(event.runId, "started", event="started", name=event.name)

    def onQueryProgress(self, event):
        p = event.progress
        sums = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        self._note(p.runId, f"{p.batchId:012d}", event="batch", name=p.name, batch=p.batchId, rows=p.numInputRows, ms=p.durationMs.get("triggerExecution", 0), metrics=[{"observed": o, "metric": k, "value": None if v is None else float(v)} for o, row in sums.items() for k, v in row.items()])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._note(event.runId, "terminated", event="terminated", error=event.exception)


LOG = "run string, at double, event string, name string, batch long, rows long, ms long, metrics array<struct<observed:string,metric:string,value:double>>, error string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def log_totals(log: DataFrame) -> DataFrame:
    """(run, metric, value): sums over the batches of each run, without the last frame's number, whose greatest counts."""
    m = log.where("event = 'batch'").select("run", F.explode("metrics").alias("m")).select("run", "m.metric", "m.value")
    return m.groupBy("run", "metric").agg(F.when(F.col("metric") == "last_frame", F.max("value")).otherwise(F.sum("value")).alias("value"))

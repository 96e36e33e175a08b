"""Arriving chunks: parts of a run as a stream, numbered and reduced in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import dose_rate, label_components
from ..operators.frames import Geometry, pack_frames, reduce_l1
from ..operators.layout import run_offsets
from ..operators.views import central_roi, every_nth


def chunk_stream(spark: SparkSession, path: str, schema, *, per_trigger: int = 1, clean: str = "off", archive: str | None = None) -> DataFrame:
    """Finished Parquet chunks of a directory, oldest first, each once; producers rename a chunk when it is whole.

    ``clean`` "delete" or "archive" removes chunks that were processed.
    """
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("cleanSource", clean)
    return (r.option("sourceArchiveDir", archive) if archive else r).parquet(path)


def numbered(chunks: DataFrame) -> DataFrame:
    """(chunk_id, index, ...) rows with frame_id, the absolute index over all chunks: it hangs on the chunks alone, so a retried batch numbers alike."""
    sizes = chunks.groupBy("chunk_id").agg((F.max("index") + 1).alias("n"))
    return chunks.join(run_offsets(sizes).select("chunk_id", "run_offset"), "chunk_id").withColumn("frame_id", F.col("run_offset") + F.col("index"))


def reduce_stream(frames: DataFrame, dark, eps: int, geom: Geometry, path: str, checkpoint: str, *, available_now: bool = True, **pack):
    """Packs a stream of frames (frame_id, pixels) into a Parquet table of records, exactly once."""
    q = pack_frames(frames, dark, eps, geom, **pack).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def deduplicated(frames: DataFrame, fps: float, lateness: str = "10 seconds") -> DataFrame:
    """frames with event_time, when the frame ended, each id once while it is not later than ``lateness``.

    Frame 0 ends one frame after the epoch: a time at the epoch itself would be late for the first watermark.
    """
    t = frames.withColumn("event_time", F.timestamp_micros(((F.col("frame_id") + 1).cast("double") / fps * 1_000_000).cast("long")))
    return t.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["frame_id"])


def live_view(l1: DataFrame, frames_per_bin: int, fps: float, lateness: str = "10 seconds") -> DataFrame:
    """(window, y, x, sum_v, n_frames): sums of every ``frames_per_bin`` frames of a stream, and how many of them have the pixel lit.

    For views that close by their number of frames, and say which are missing, see ``stateful.count_views``.
    """
    t = l1.withColumn("event_time", F.timestamp_micros((F.col("frame_id").cast("double") / fps * 1_000_000).cast("long")))
    w = F.window("event_time", f"{round(frames_per_bin / fps * 1_000_000)} microseconds")
    return t.withWatermark("event_time", lateness).groupBy(w.alias("window"), "y", "x").agg(F.sum("v").alias("sum_v"), F.count(F.lit(1)).alias("n_frames"))


def validation_dose(frames: DataFrame, dark, eps: int, geom: Geometry, gap: int, size: int = 128) -> DataFrame:
    """(frame_id, n_events, rate) on the central region of every ``gap``-th frame; the function of a batch for ``each_batch``.

    The region is cut out first, so an event that its edge cuts counts with the part inside.  A frame without events has noughts.
    """
    sample = every_nth(frames, gap)
    inside, roi = central_roi(reduce_l1(sample, dark, eps, geom), geom, size)
    return dose_rate(label_components(inside, geom), roi, sample)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True):
    """Writes work(batch) of each micro-batch under its own number: a batch that is done again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def chunk_windows(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """(window_start, event_type, n): tumbling windows of ``events`` rows; works on batches and, with a watermark, on streams."""
    t = rows.withColumn("event_time", F.col("ts").cast("timestamp"))
    return t.groupBy(F.window("event_time", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")

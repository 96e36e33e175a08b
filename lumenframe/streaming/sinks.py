"""A stream's two sinks: packed records of all frames, and every so many-th frame as it came, for validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import Geometry, pack_frames
from ..operators.views import every_nth
from ..sources import store
from ..sources.readers import register
from .chunks import validation_dose

#: Bytes of the index before a validation frame.
PREFIX = 8


def write_batch(batch: DataFrame, number: int, dark, eps: int, geom: Geometry, path: str, gap: int, *, files: int = 4, dose_size: int | None = None, **pack) -> None:
    """Writes one batch of frames (frame_id, pixels) under its number: ``records/batch=N``, ``validation/batch=N`` and, with ``dose_size``, ``dose/batch=N``.

    Frames whose number is a multiple of ``gap`` go to raw files, each after its number in 8 bytes; they are dealt by their number alone and sorted, so a batch that is done
    again replaces what it wrote by the same bytes.  A gap of nought or less keeps none.
    """
    frames = batch.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("pixels").cast("binary").alias("pixels"))
    pack_frames(frames, dark, eps, geom, **pack).write.mode("overwrite").parquet(f"{path}/records/batch={number}")
    if gap <= 0:
        return
    register(batch.sparkSession)
    kept = every_nth(frames, gap).repartition(files, F.xxhash64("frame_id")).sortWithinPartitions("frame_id")
    kept.write.format("raw_frames").mode("overwrite").option("sorted", "true").option("record_prefix", PREFIX).option("stem", "validation").save(f"{path}/validation/batch={number}")
    if dose_size:
        validation_dose(frames, dark, eps, geom, gap, dose_size).write.mode("overwrite").parquet(f"{path}/dose/batch={number}")


def reduce_and_validate(stream: DataFrame, dark, eps: int, geom: Geometry, path: str, checkpoint: str, gap: int, *, available_now: bool = True, **options):
    """Runs ``write_batch`` for each micro-batch of a stream of frames; a batch that is replayed after a failure leaves what it left before."""
    q = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, dark, eps, geom, path, gap, **options)).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def validation_frames(spark, path: str, geom: Geometry) -> DataFrame:
    """(path, frame_id, pixels) of the validation frames under ``path``, by the numbers before them."""
    register(spark)
    return spark.read.format("raw_frames").option("ny", geom.ny).option("nx", geom.nx).option("record_prefix", PREFIX).option("prefix_id", "true").load(store.join(path, "validation", "*", "*.bin"))

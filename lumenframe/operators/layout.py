"""Order, offsets, parts and their merge, set comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs
from .frames import by_slices

#: Frames of a block of a running sum.
BLOCK = 4096


def prefix_sum(rows: DataFrame, key: str, value: str, out: str = "offset", block: int = BLOCK) -> DataFrame:
    """rows with the sum of ``value`` over all smaller keys; equal keys are summed in no fixed order.

    Keys are cut into blocks; each block is summed up by itself, and only the blocks' totals, one row for every ``block`` keys, are
    summed over the whole.
    """
    b = F.floor(F.col(key) / block).alias("__block")
    cut = rows.withColumn("__block", F.floor(F.col(key) / block))
    totals = rows.groupBy(b).agg(F.sum(value).alias("__total"))
    bases = totals.select("__block", (F.sum("__total").over(W.orderBy("__block")) - F.col("__total")).alias("__base"))
    inner = F.sum(value).over(W.partitionBy("__block").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    return cut.join(bases, "__block").withColumn(out, (F.coalesce(inner, F.lit(0)) + F.col("__base")).cast("long")).drop("__block", "__base")


def seek_table(records: DataFrame) -> DataFrame:
    """(frame_id, c1, c2, packed, offset): sizes of a frame's two streams and where they begin in the body of a merged file."""
    t = records.select("frame_id", F.col("c1").cast("long"), F.col("c2").cast("long"), F.col("packed").cast("long"))
    return prefix_sum(t.withColumn("__size", F.col("c1") + F.col("c2")), "frame_id", "__size").drop("__size")


def run_offsets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n, run_offset): the absolute index of each chunk's first frame."""
    return prefix_sum(chunks, "chunk_id", "n", "run_offset")


def rle_runs(l1: DataFrame, nx: int) -> DataFrame:
    """(frame_id, id, gap): how many pixels lie between a set pixel and the one before; the scan starts at index 1."""
    ids = l1.select("frame_id", (F.col("y") * nx + F.col("x")).cast("int").alias("id")).where("id >= 1")
    return ids.withColumn("gap", F.col("id") - F.coalesce(F.lag("id").over(W.partitionBy("frame_id").orderBy("id")), F.lit(0)) - 1)


def ordinals(l1: DataFrame) -> DataFrame:
    """Sparse rows with their place in the frame's value stream, from 1."""
    return l1.withColumn("ordinal", F.row_number().over(W.partitionBy("frame_id").orderBy("y", "x")))


def frame_shares(n_frames: int, workers: int) -> list[tuple[int, int]]:
    """(first, count) for each worker: the remainder goes to the first workers."""
    q, r = divmod(n_frames, workers)
    return [(w * q + min(w, r), q + (w < r)) for w in range(workers)]


def merge_parts(parts: DataFrame, part_col: str = "part", key: str = "frame_id") -> DataFrame:
    """One row a frame: of frames in several parts the last part's.  ``parts`` may hold any columns; frames come out in ranges of their id."""
    others = [c for c in parts.columns if c != key]
    best = parts.groupBy(key).agg(F.max_by(F.struct(*others), F.col(part_col)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def ordered(merged: DataFrame, key: str = "frame_id") -> DataFrame:
    """Frames in ascending order over partitions and within them."""
    return merged.repartitionByRange(key).sortWithinPartitions(key)


def missing_frames(present: DataFrame, n_frames: int) -> DataFrame:
    return present.sparkSession.range(n_frames).withColumnRenamed("id", "frame_id").join(present.select(F.col("frame_id").cast("long")), "frame_id", "left_anti")


def duplicate_frames(parts: DataFrame, part_col: str = "part") -> DataFrame:
    """(frame_id, n, parts) of frames that several parts hold."""
    d = parts.select("frame_id", part_col).distinct().groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(part_col)).alias("parts"))
    return d.where("n > 1")


def part_summary(parts: DataFrame, part_col: str = "part") -> DataFrame:
    """First and last frame and number of frames of each part."""
    return parts.groupBy(part_col).agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count_distinct("frame_id").alias("n"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side: empty where both are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def mismatch_share(a: DataFrame, b: DataFrame, key: str = "frame_id", value: str = "data") -> DataFrame:
    """(frame_id, share): bytes that differ between two binary columns; what one side lacks differs, and two empty ones are alike."""
    names = [key, "share"]

    def run(it):
        for rows in it:
            out = []
            for x, y in zip(rows.column(1), rows.column(2)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8) for v in (x, y))
                n, m = max(len(p), len(q)), min(len(p), len(q))
                out.append((n - m + int((p[:m] != q[:m]).sum())) / n if n else 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.float64())], names)

    both = a.select(key, F.col(value).cast("binary").alias("x")).join(b.select(key, F.col(value).cast("binary").alias("y")), key, "full_outer").select(key, "x", "y")
    return both.mapInArrow(run, f"`{key}` {both.schema[key].dataType.simpleString()}, share double")


def size_ratios(sizes: DataFrame, raw_bytes: int) -> DataFrame:
    """Reduction, compression and overall ratios of (reduced, compressed) bytes, averaged over frames."""
    a = sizes.agg(F.avg("reduced").alias("reduced"), F.avg("compressed").alias("compressed"))
    return a.select(*_ratios(raw_bytes))


def _ratios(raw_bytes: int) -> list:
    return [(F.lit(float(raw_bytes)) / F.col("reduced")).alias("rer"), (F.col("reduced") / F.col("compressed")).alias("cor"), (F.lit(float(raw_bytes)) / F.col("compressed")).alias("rcr")]


def codec_ratios(records: DataFrame, names, raw_bytes: int) -> DataFrame:
    """(codec, rer, cor, rcr): ``size_ratios`` of records packed without a codec (bitmap, vals), for each codec of ``names``; the records are made and read once for all of them."""
    codecs_, names = list(names), ["codec", "reduced", "compressed"]
    for codec in codecs_:
        if codec not in codecs.CODEC_IDS:
            raise ValueError(f"unknown codec {codec!r}")

    def work(b):
        rows = []
        for streams in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if None not in streams:
                n = sum(map(len, streams))
                rows += [(c, n, sum(len(codecs.compress(s, c)) for s in streams)) for c in codecs_]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names)

    sizes = records.select("bitmap", "vals").mapInArrow(by_slices(work, raw_bytes), "codec string, reduced long, compressed long")
    a = sizes.groupBy("codec").agg(F.avg("reduced").alias("reduced"), F.avg("compressed").alias("compressed"))
    return a.select("codec", *_ratios(raw_bytes))


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Totals of (metric, value) rows over tasks."""
    return metrics.groupBy("metric").agg(F.sum("value").alias("value"))

"""Command line: reduce, expand, merge, index, header, calibrate and watch runs of frames."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import codecs
from .operators import calibration, frames, layout, metrics
from .operators.views import frame_range
from .sources import index, store
from .sources.params import RunParams
from .sources.readers import register
from .streaming import arrivals, sinks

FORMATS = {0: "raw_frames", 1: "mrc", 2: "seq"}


def _session() -> SparkSession:
    return register(SparkSession.builder.appName("lumenframe").getOrCreate())


def _frames(spark, path, kind, params):
    r = spark.read.format(FORMATS[kind])
    if kind == 0:
        r = r.option("ny", params.ny).option("nx", params.nx).option("bytes", max(1, params.source_bit_depth // 8))
    return r.option("numbering", "run").load(path)


def _geometry(params: RunParams) -> frames.Geometry:
    return frames.Geometry(params.ny, params.nx, "<u2" if params.source_bit_depth > 8 else "u1")


def _packing(params: RunParams) -> dict:
    codec = codecs.CODEC_NAMES[params.compression_scheme] if params.rc_operation_mode else None
    stat = {1: "max", 2: "mean", 3: "min"}.get(params.l2_statistics, "max")
    return dict(level=params.reduction_level, depth=params.target_bit_depth, codec=codec, codec_level=params.compression_level, stat=stat, centroid="peak" if params.l4_centroiding == 2 else "weighted")


def _dark(spark, dark: str, params: RunParams, geom):
    calib = frame_range(_frames(spark, dark, params.dark_file_type, params), params.dark_frame_offset, params.num_dark_frames)
    return frames.dark_max(calib, geom)


def reduce(spark, image: str, dark: str, params: RunParams, out: str, validation: str | None = None, verbose: bool = False) -> dict:
    """Reads frames and dark frames, reduces them to the parameters' level and writes part files; returns the run's figures.

    With a ``validation`` folder every ``validation_frame_gap``-th frame is written there as it is, after its number.
    """
    geom = _geometry(params)
    raw = frame_range(_frames(spark, image, params.source_file_type, params), params.frame_offset, params.num_frames)
    pack = _packing(params)
    packed = frames.pack_frames(raw, _dark(spark, dark, params, geom), params.dark_threshold_epsilon, geom, **pack)

    def write(records):
        w = records.write.format("rc").mode("append").option("ny", geom.ny).option("nx", geom.nx).option("depth", params.target_bit_depth).option("eps", params.dark_threshold_epsilon)
        w.option("codec", pack["codec"] or "none").option("codec_level", params.compression_level).option("source_type", params.source_file_type).save(out)

    found = metrics.measured(packed, geom, write)
    if validation and params.validation_frame_gap > 0:
        kept = raw.select("frame_id", "pixels").where(F.col("frame_id") % params.validation_frame_gap == 0).repartitionByRange("frame_id").sortWithinPartitions("frame_id")
        kept.write.format("raw_frames").mode("append").option("sorted", "true").option("record_prefix", sinks.PREFIX).option("stem", "validation").save(validation)
    if verbose:
        for k, v in sorted(found.items()):
            print(f"{k}\t{v}")
    return found


def watch(spark, folder: str, dark: str, params: RunParams, out: str, available_now: bool = False):
    """Reduces the SEQ chunks that arrive in a folder until a file ``stop`` is there; numbers, records, validation frames and a log of batches go to ``out``."""
    geom = _geometry(params)
    stream = arrivals.arriving(spark, folder, store.join(out, "chunks"), "seq", stop_file=store.join(folder, "stop"))
    spark.streams.addListener(metrics.RunLog(store.join(out, "log")))
    return sinks.reduce_and_validate(stream, _dark(spark, dark, params, geom), params.dark_threshold_epsilon, geom, out, store.join(out, "checkpoint"), params.validation_frame_gap, available_now=available_now, **_packing(params))


def expand(spark, path: str, out: str, dense: bool = False, triplets: bool = False) -> None:
    """Writes reduced files as a Parquet table of sparse pixels, as raw frames, or as files of triplets."""
    px = spark.read.format("rc").load(path).drop("path")
    if not dense and not triplets:
        px.write.mode("overwrite").parquet(out)
        return
    h = spark.read.format("rc_header").load(path).select(F.element_at("header", "ny").cast("int").alias("ny"), F.element_at("header", "nx").cast("int").alias("nx")).first()
    if triplets:
        px.repartitionByRange("frame_id").sortWithinPartitions("frame_id", "y", "x").write.format("triplets").mode("append").option("ny", h.ny).option("nx", h.nx).save(out)
        return
    layout.ordered(frames.dense(px, frames.Geometry(h.ny, h.nx))).write.format("raw_frames").mode("append").option("sorted", "true").option("ny", h.ny).option("nx", h.nx).save(out)


def merge(spark, path: str, out: str) -> None:
    """Merges part files: into one reduced file where ``out`` is named like one (``.rc1`` to ``.rc4``), else into one sparse table.  Of a frame in several parts the last part's pixels stay."""
    if re.search(r"\.rc[1-4]$", out):
        index.merge_files(spark, path, out)
        return
    px = spark.read.format("rc").load(path).withColumn("part", F.regexp_extract("path", r"_part(\d+)$", 1).cast("int"))
    last = px.groupBy("frame_id").agg(F.max("part").alias("part"))
    layout.ordered(px.join(last, ["frame_id", "part"]).drop("path")).write.mode("overwrite").parquet(out)


def calibrate(spark, image: str, params: RunParams, sigmas: int, out: str, n_stats: int | None = None, accurate_sigma: int | None = None) -> None:
    """Writes thresholds by sigma, their counts over the last ``n_stats`` frames and, with ``accurate_sigma``, the accurate threshold where there are events enough."""
    geom = frames.Geometry(params.ny, params.nx)
    raw = frame_range(_frames(spark, image, params.source_file_type, params), params.frame_offset, params.num_frames)
    thresholds, report, exact = calibration.sigma_report(raw, geom, sigmas, n_stats, accurate_sigma)
    thresholds.write.mode("overwrite").partitionBy("i").parquet(f"{out}/thresholds")
    report.write.mode("overwrite").parquet(f"{out}/report")
    if exact is not None:
        exact.write.mode("overwrite").parquet(f"{out}/accurate")


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="lumenframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("reduce", "expand", "merge", "index", "header", "calibrate", "watch"):
        s = sub.add_parser(name)
        s.add_argument("-i", "--input", required=True)
        s.add_argument("-o", "--output", required=name != "header")
        s.add_argument("-d", "--dark")
        s.add_argument("-p", "--params")
        s.add_argument("-l", "--level", type=int)
        s.add_argument("-n", "--num-frames", type=int)
        s.add_argument("-v", "--verbose", action="store_true")
        s.add_argument("-vf", "--validation-folder")
        s.add_argument("--validation-gap", type=int)
        s.add_argument("--sigmas", type=int, default=5)
        s.add_argument("--n-stats", type=int)
        s.add_argument("--accurate-sigma", type=int)
        s.add_argument("--dense", action="store_true")
        s.add_argument("--triplets", action="store_true")
    a = p.parse_args(argv)
    spark = _session()
    params = RunParams()
    if a.params:
        params = RunParams.parse(store.read(a.params).decode())
    if a.level:
        params.reduction_level = a.level
    if a.num_frames:
        params.num_frames = a.num_frames
    if a.validation_gap is not None:
        params.validation_frame_gap = a.validation_gap
    params.__post_init__()
    if a.command in ("reduce", "watch") and not a.dark:
        p.error(f"{a.command} needs --dark")
    if a.command == "reduce":
        reduce(spark, a.input, a.dark, params, a.output, a.validation_folder, a.verbose)
    elif a.command == "watch":
        arrivals.run_until_stopped(watch(spark, a.input, a.dark, params, a.output), store.join(a.input, "stop"))
    elif a.command == "expand":
        expand(spark, a.input, a.output, a.dense, a.triplets)
    elif a.command == "merge":
        merge(spark, a.input, a.output)
    elif a.command == "index":
        index.write_index(spark, a.input, a.output)
    elif a.command == "calibrate":
        calibrate(spark, a.input, params, a.sigmas, a.output, a.n_stats, a.accurate_sigma)
    else:
        spark.read.format("rc_header").load(a.input).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Registered queries of the file sources, sinks and streams: the fixture's frames are written, read back and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, views
from ..sources import index, readers, store
from ..streaming import arrivals, chunks, sinks, stateful
from .fixtures import BASE, EPS, EVENTS, GEOM, dark_frames, raw_frames

QUERIES, ORACLES = {}, {}
#: Files of a run.
FILES = 6
#: Dense files number frames by their place.
_NUMBERED = ", nth AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS n FROM fr)"
_DENSE = "SELECT n::BIGINT AS frame_id, count(*) AS n_px, sum(adu)::BIGINT AS sum_adu, max(adu)::BIGINT AS max_adu, sum(adu * (y * 64 + x))::BIGINT AS moment FROM raw JOIN nth USING (frame_id)"
_L1 = "SELECT frame_id, count(*) AS n_fg, sum(v)::BIGINT AS sum_v, sum(y * 64 + x)::BIGINT AS places FROM l1 GROUP BY 1"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the store that the driver and all tasks share, the session's spark.checkpoint.dir; the warehouse stands in where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark, d, kind: str) -> DataFrame:
    """The frames in files by ranges of frames, each written by its own task as its rows come, and read as one run."""
    readers.register(spark)
    path = _folder(spark, kind)
    rows = raw_frames(spark, d).repartitionByRange(FILES, "frame_id").sortWithinPartitions("frame_id")
    rows.write.format(kind).mode("overwrite").option("ny", GEOM.ny).option("nx", GEOM.nx).option("sorted", "true").save(path)
    return spark.read.format(kind).option("ny", GEOM.ny).option("nx", GEOM.nx).option("numbering", "run").option("frames_per_partition", 32).load(path)


def _sums(df: DataFrame) -> DataFrame:
    return frames.pixel_sums(df.select("frame_id", "pixels"), GEOM)


def _dense(name: str, where: str = ""):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = f"{BASE}{_NUMBERED}\n{_DENSE} {where} GROUP BY 1"
        return f

    return add


@_dense("raw_files")
def raw_files(spark, d):
    return _sums(_written(spark, d, "raw_frames"))


@_dense("mrc_files")
def mrc_files(spark, d):
    return _sums(_written(spark, d, "mrc"))


@_dense("seq_files")
def seq_files(spark, d):
    return _sums(_written(spark, d, "seq"))


@_dense("seq_range", "WHERE n >= 3 AND n < 11")
def seq_range(spark, d):
    return _sums(views.frame_range(_written(spark, d, "seq"), 3, 8))


@_dense("slicing", "WHERE n >= 2 AND n < 12 AND (n - 2) % 3 = 0 AND y < 32 AND x % 2 = 0")
def slicing(spark, d):
    px = views.sub_volume(frames.pixels(_written(spark, d, "raw_frames").select("frame_id", "pixels"), GEOM), slice(2, 12, 3), slice(0, 32), slice(0, None, 2))
    return px.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_px"), F.sum("adu").cast("long").alias("sum_adu"), F.max("adu").cast("long").alias("max_adu"), F.sum(F.expr(f"adu * (y * {GEOM.nx} + x)")).cast("long").alias("moment"))


def _parts(spark, d, level: int, codec: str, shuffled: bool = False) -> str:
    readers.register(spark)
    path = _folder(spark, f"rc{level}")
    packed = frames.pack_frames(raw_frames(spark, d), frames.dark_max(dark_frames(spark), GEOM), EPS, GEOM, level=level, codec=None if codec == "none" else codec)
    packed = (packed.repartition(FILES, F.xxhash64("frame_id")) if shuffled else packed).sortWithinPartitions("frame_id")
    packed.write.format("rc").mode("overwrite").option("ny", GEOM.ny).option("nx", GEOM.nx).option("codec", codec).option("sorted", "true").save(path)
    return path


def _reduced(spark, d, level: int, codec: str) -> DataFrame:
    return spark.read.format("rc").load(_parts(spark, d, level, codec))


def _fg(df: DataFrame) -> DataFrame:
    return df.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_fg"), F.sum("v").cast("long").alias("sum_v"), F.sum(F.expr(f"y * {GEOM.nx} + x")).cast("long").alias("places"))


def _sparse(name: str, sql: str = _L1, base: str = BASE):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = f"{base}\n{sql}"
        return f

    return add


@_sparse("reduced_parts")
def reduced_parts(spark, d):
    return _fg(_reduced(spark, d, 1, "zlib"))


@_sparse("reduced_merged")
def reduced_merged(spark, d):
    """Parts that hold frames in no order, merged by several tasks at once, and the one file read by ranges of its seek table."""
    path = _parts(spark, d, 1, "zstd", shuffled=True)
    out = store.join(_folder(spark, "merged"), "run.rc1")
    index.merge_files(spark, path, out, tasks=4)
    return _fg(spark.read.format("rc").option("frames_per_partition", 32).load(out))


@_sparse("reduced_bitmaps", _L1.replace("sum(v)::BIGINT AS sum_v, ", ""))
def reduced_bitmaps(spark, d):
    return _fg(_reduced(spark, d, 3, "zlib").withColumn("v", F.lit(1))).drop("sum_v")


@_sparse("reduced_frame_access", _L1.replace("GROUP BY", "WHERE frame_id IN (2, 5, 7) GROUP BY"))
def reduced_frame_access(spark, d):
    """Three frames by an index of the parts: only their bytes are read."""
    path = _parts(spark, d, 1, "zlib", shuffled=True)
    at = _folder(spark, "index")
    index.write_index(spark, path, at)
    return _fg(spark.read.format("rc").option("index", at).load().where("frame_id IN (2, 5, 7)"))


@_sparse("frame_index", "SELECT frame_id, (12 * count(v) + 7) // 8 AS c2 FROM fr LEFT JOIN l1 USING (frame_id) GROUP BY 1")
def frame_index(spark, d):
    """The index of uncompressed parts: the bytes of each frame's values follow from its foreground."""
    return index.rc_index(spark, _parts(spark, d, 1, "none")).select("frame_id", "c2")


@_sparse("l4_reduced_files", "SELECT frame_id, count(*) AS n_fg, sum(cy * 64 + cx)::BIGINT AS places FROM cnt GROUP BY 1", BASE + EVENTS)
def l4_reduced_files(spark, d):
    """Counted electrons (level 4) in parts, merged and read back."""
    out = store.join(_folder(spark, "merged"), "run.rc4")
    index.merge_files(spark, _parts(spark, d, 4, "zlib"), out, tasks=3)
    return _fg(spark.read.format("rc").load(out)).drop("sum_v")


@_sparse("l2_reduced_files", "SELECT frame_id, count(*) AS n_fg, sum(v)::BIGINT AS sum_v, sum(cy * 64 + cx)::BIGINT AS places FROM (SELECT frame_id, wy // w AS cy, wx // w AS cx, first(vmax ORDER BY lab) AS v FROM ev GROUP BY 1, 2, 3) GROUP BY 1", BASE + EVENTS)
def l2_reduced_files(spark, d):
    """Events' floor centroids with their greatest value (level 2) in parts."""
    return _fg(_reduced(spark, d, 2, "zlib"))


@_sparse("triplet_files")
def triplet_files(spark, d):
    """Sparse pixels as files of triplets, and back."""
    readers.register(spark)
    path = _folder(spark, "triplets")
    l1 = frames.reduce_l1(raw_frames(spark, d), frames.dark_max(dark_frames(spark), GEOM), EPS, GEOM)
    l1.repartitionByRange(FILES, "frame_id").sortWithinPartitions("frame_id", "y", "x").write.format("triplets").mode("overwrite").option("ny", GEOM.ny).option("nx", GEOM.nx).save(path)
    return _fg(spark.read.format("triplets").load(path))


@_sparse("stream_reduce")
def stream_reduce(spark, d):
    """Chunks of frames as a stream, reduced and packed exactly once, read back."""
    src, out, at = (_folder(spark, f"stream-{k}") for k in ("in", "out", "state"))
    raw_frames(spark, d).repartition(4).write.parquet(src)
    stream = chunks.chunk_stream(spark, src, "frame_id long, pixels binary", per_trigger=2)
    dark = frames.dark_max(dark_frames(spark), GEOM)
    chunks.reduce_stream(stream, dark, EPS, GEOM, out, at).awaitTermination()
    return _fg(frames.unpack_records(spark.read.parquet(out), GEOM))


@_dense("seq_arrivals", "WHERE frame_id // 20 < (SELECT max(frame_id) // 20 FROM fr)")
def seq_arrivals(spark, d):
    """SEQ chunks of 20 frames that arrive in a folder, as a stream that numbers frames over all chunks; the last chunk may not be whole yet and stays."""
    readers.register(spark)
    src, out, at = (_folder(spark, f"arrivals-{k}") for k in ("in", "out", "state"))
    dealt = raw_frames(spark, d).repartition(F.expr("frame_id div 20")).sortWithinPartitions("frame_id")
    dealt.write.format("seq").mode("overwrite").option("ny", GEOM.ny).option("nx", GEOM.nx).option("sorted", "true").option("frames_per_file", 20).save(src)
    stream = arrivals.arriving(spark, src, store.join(at, "log"), order="name", frames_per_partition=8)
    stream.select("frame_id", "pixels").writeStream.format("parquet").option("path", out).option("checkpointLocation", store.join(at, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return _sums(spark.read.parquet(out))


def _run_stream(df: DataFrame, path: str, at: str) -> DataFrame:
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@_sparse("chunk_numbering", "SELECT 'run' AS run, chunk_id, n, coalesce(sum(n) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run_offset FROM (SELECT frame_id // 7 AS chunk_id, count(*) AS n FROM fr GROUP BY 1)")
def chunk_numbering(spark, d):
    """Chunks that arrive in any order, numbered through by state that outlives the batches."""
    src, out, at = (_folder(spark, f"numbering-{k}") for k in ("in", "out", "state"))
    heads = raw_frames(spark, d).groupBy(F.expr("frame_id div 7").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit("run"))
    heads.repartition(4, F.xxhash64("chunk_id")).write.parquet(src)
    stream = chunks.chunk_stream(spark, src, "chunk_id long, n long, run string", per_trigger=1)
    return _run_stream(stateful.number_chunks(stream), out, at)


_GAPS = "frame_id % 37 <> 5 AND frame_id % 60 NOT BETWEEN 20 AND 33"
_E = "CASE WHEN (SELECT count(*) FROM seen WHERE frame_id >= s AND frame_id < s + 10) > 0 THEN s ELSE (SELECT min(frame_id) FROM seen WHERE frame_id >= s) END"
_VIEWS = f""", seen AS (SELECT frame_id FROM fr WHERE {_GAPS}),
vw AS (SELECT 0::BIGINT AS s UNION ALL SELECT (SELECT max(frame_id) FROM seen WHERE frame_id >= e AND frame_id < e + 10) + 1 FROM (SELECT {_E} AS e FROM vw WHERE s <= (SELECT max(frame_id) FROM seen))),
closed AS (SELECT * FROM (SELECT e AS start, (SELECT count(*) FROM seen WHERE frame_id >= e AND frame_id < e + 10) AS n, (SELECT max(frame_id) FROM seen WHERE frame_id >= e AND frame_id < e + 10) AS last
           FROM (SELECT {_E} AS e FROM vw WHERE s <= (SELECT max(frame_id) FROM seen))) WHERE n = 10 OR (SELECT max(frame_id) FROM seen) >= start + 10)"""


@_sparse("live_views", f"{_VIEWS}\nSELECT c.start, c.n::INT AS n_frames, c.last - c.start + 1 - c.n AS n_missing, l1.y, l1.x, sum(v)::BIGINT AS sum_v FROM closed c JOIN l1 ON l1.frame_id BETWEEN c.start AND c.last AND {_GAPS.replace('frame_id', 'l1.frame_id')} GROUP BY ALL")
def live_views(spark, d):
    """Views of ten frames each from a stream with missing frames, closed by their number of frames."""
    src, out, at = (_folder(spark, f"views-{k}") for k in ("in", "out", "state"))
    raw_frames(spark, d).where(_GAPS).repartitionByRange(4, "frame_id").write.parquet(src)
    stream = chunks.chunk_stream(spark, src, "frame_id long, pixels binary", per_trigger=4)
    sparse = stateful.banded(stream, frames.dark_max(dark_frames(spark), GEOM), EPS, GEOM, bands=4)
    found = _run_stream(stateful.count_views(sparse, 10), out, at)
    about = found.where("band = 0").select("start", "n_frames", F.size("missing").cast("long").alias("n_missing"))
    return stateful.view_pixels(found, GEOM).join(about, "start").select("start", "n_frames", "n_missing", "y", "x", "sum_v")


@_dense("validation_frames", "WHERE frame_id % 10 = 0")
def validation_frames(spark, d):
    """A stream's second sink: every tenth frame in raw files, by the number before it."""
    src, out, at = (_folder(spark, f"validation-{k}") for k in ("in", "out", "state"))
    raw_frames(spark, d).repartition(4).write.parquet(src)
    stream = chunks.chunk_stream(spark, src, "frame_id long, pixels binary", per_trigger=2)
    sinks.reduce_and_validate(stream, frames.dark_max(dark_frames(spark), GEOM), EPS, GEOM, out, at, 10).awaitTermination()
    return _sums(sinks.validation_frames(spark, out, GEOM))


ORACLES["validation_frames"] = ORACLES["validation_frames"].replace("SELECT n::BIGINT AS frame_id,", "SELECT frame_id,")

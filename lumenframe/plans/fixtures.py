"""Detector frames derived from the star-schema tables: 64 x 64 pixels, 12 bits, one frame for every 100 order keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import Geometry, by_slices

GEOM = Geometry(64, 64)
EPS = 400


def _noise(frame_id: np.ndarray | int):
    y, x = np.divmod(np.arange(GEOM.pixels), GEOM.nx)
    return 100 + (y * 7 + x * 13) % 17 + (frame_id * 31 + y * 17 + x * 7) % 11


def frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id): the ids of ``raw_frames``, each once, without their images."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.expr("cast(l_orderkey div 100 as bigint)").alias("frame_id")).distinct()


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, pixels): hits of the line items on a noisy background."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hits = lines.select(
        F.expr("cast(l_orderkey div 100 as bigint)").alias("frame_id"),
        F.expr("cast((l_partkey * 7 + l_linenumber) % 64 * 64 + (l_suppkey * 11 + l_linenumber * 5) % 64 as int)").alias("i"),
        F.col("l_quantity").cast("int").alias("q"),
    )
    rows = hits.groupBy("frame_id").agg(F.collect_list(F.struct("i", "q")).alias("s"))

    def work(b):
        ids, out = b.column(0).to_pylist(), []
        for f, s in zip(ids, b.column(1)):
            img = _noise(f)
            np.add.at(img, s.values.field("i").to_numpy(), 16 * s.values.field("q").to_numpy().astype(np.int64))
            out.append(np.minimum(4095, img).astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["frame_id", "pixels"])

    return rows.mapInArrow(by_slices(work, GEOM.nbytes), "frame_id long, pixels binary")


def dark_frames(spark: SparkSession, n: int = 20) -> DataFrame:
    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_noise(f).astype("<u2").tobytes() for f in b.column(0).to_pylist()], pa.binary())], ["frame_id", "pixels"])

    return spark.range(0, n, 1, 1).withColumnRenamed("id", "frame_id").mapInArrow(run, "frame_id long, pixels binary")


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(GEOM.pixels).select(F.expr(f"cast(id div {GEOM.nx} as int)").alias("y"), F.expr(f"cast(id % {GEOM.nx} as int)").alias("x"))


#: The same fixture in DuckDB SQL: common tables sig, grid, fr, raw, dk, dark, l1 and events (cc by recursion).
BASE = """
WITH RECURSIVE sig AS (
  SELECT CAST(floor(l_orderkey / 100.0) AS BIGINT) AS frame_id, CAST((l_partkey * 7 + l_linenumber) % 64 AS INT) AS y,
         CAST((l_suppkey * 11 + l_linenumber * 5) % 64 AS INT) AS x, CAST(sum(l_quantity) AS INT) * 16 AS e
  FROM lineitem GROUP BY 1, 2, 3),
grid AS (SELECT CAST(a.range AS INT) AS y, CAST(b.range AS INT) AS x FROM range(64) a CROSS JOIN range(64) b),
fr AS (SELECT DISTINCT frame_id FROM sig),
raw AS (
  SELECT fr.frame_id, g.y, g.x, CAST(least(4095, 100 + (g.y * 7 + g.x * 13) % 17 + (fr.frame_id * 31 + g.y * 17 + g.x * 7) % 11 + coalesce(sig.e, 0)) AS INT) AS adu
  FROM fr CROSS JOIN grid g LEFT JOIN sig ON sig.frame_id = fr.frame_id AND sig.y = g.y AND sig.x = g.x),
dk AS (SELECT CAST(d.range AS BIGINT) AS frame_id, g.y, g.x, CAST(100 + (g.y * 7 + g.x * 13) % 17 + (d.range * 31 + g.y * 17 + g.x * 7) % 11 AS INT) AS adu FROM range(20) d CROSS JOIN grid g),
dark AS (SELECT y, x, max(adu) AS t FROM dk GROUP BY y, x),
l1 AS (SELECT r.frame_id, r.y, r.x, r.adu - (d.t + 400) AS v FROM raw r JOIN dark d ON r.y = d.y AND r.x = d.x WHERE r.adu > d.t + 400)"""

EVENTS = """,
fg AS (SELECT frame_id, y, x, v, CAST(y * 64 + x AS BIGINT) AS id FROM l1),
rr AS (SELECT frame_id, id, y, x, id AS lab FROM fg
       UNION SELECT f.frame_id, f.id, f.y, f.x, rr.lab FROM rr JOIN fg f ON f.frame_id = rr.frame_id AND abs(f.y - rr.y) <= 1 AND abs(f.x - rr.x) <= 1 AND rr.lab < f.id),
cc AS (SELECT frame_id, id, min(lab) AS lab FROM rr GROUP BY 1, 2),
ev AS (SELECT cc.frame_id, cc.lab, count(*)::BIGINT AS area, sum(v)::BIGINT AS w, sum(v * y)::BIGINT AS wy, sum(v * x)::BIGINT AS wx, max(v)::INT AS vmax, min(v)::INT AS vmin
       FROM cc JOIN fg USING (frame_id, id) GROUP BY 1, 2),
cnt AS (SELECT DISTINCT frame_id, ((2 * wy + w) // (2 * w))::INT AS cy, ((2 * wx + w) // (2 * w))::INT AS cx FROM ev)"""

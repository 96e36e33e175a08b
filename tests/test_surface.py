"""Functions for SQL, run figures and the log of a stream, matches by ranges of frames, lines of text."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import kernels, scalar
from lumenframe.functions.sql import register_functions
from lumenframe.operators import components, frames, layout, metrics, views
from lumenframe.operators.frames import Geometry
from lumenframe.streaming import chunks

G = Geometry(5, 7)


def table(spark, stack):
    return spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(stack)], "frame_id long, pixels binary")


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(5).integers(0, 400, (12, 5, 7)).astype("<u2")


def test_bits_and_values_in_sql(spark):
    register_functions(spark)
    one = lambda q: spark.sql(f"SELECT {q} AS r").first().r
    assert bytes(one("pack_bits(array(0, 7, 8, 9), 16)")) == bytes.fromhex("8103")
    assert bytes(one("pack_values(array(78, 145), 12)")) == bytes.fromhex("4E1009")
    assert one("unpack_bits(pack_bits(array(0, 7, 8, 9), 16), 16)") == [0, 7, 8, 9] and one("unpack_values(X'4E1009', 12, 2)") == [78, 145]
    assert bytes(one("decompress(compress(CAST('abcabcabc' AS BINARY), 'zstd'), 'zstd')")) == b"abcabcabc"
    assert bytes(one("pack_bits(CAST(array() AS array<int>), 9)")) == b"\0\0"
    for q in ("pack_bits(CAST(NULL AS array<int>), 9)", "pack_values(array(1), CAST(NULL AS int))", "unpack_bits(CAST(NULL AS binary), 8)", "compress(CAST(NULL AS binary), 'zlib')"):
        assert one(q) is None
    rows = spark.createDataFrame([(k, [(k * j) % 64 for j in range(k)]) for k in range(50)], "k int, v array<int>")
    rows.createOrReplaceTempView("some_values")
    got = spark.sql("SELECT k, v, unpack_values(pack_values(v, 6), 6, size(v)) AS w FROM some_values").collect()
    assert len(got) == 50 and all(r.v == r.w for r in got)
    with pytest.raises(Exception, match="bits"):
        one("pack_values(array(4096), 12)")


@pytest.mark.parametrize("level,codec", [(1, "zlib"), (3, None), (2, "zstd")])
def test_frames_in_sql(spark, stack, level, codec):
    register_functions(spark)
    packed = frames.pack_frames(table(spark, stack), np.full(35, 150), 50, G, level=level, codec=codec)
    packed.unionByName(packed.limit(1).withColumn("frame_id", F.lit(99).cast("long")).withColumn("bitmap", F.lit(None).cast("binary"))).createOrReplaceTempView("some_records")
    vals = "r.vals" if level == 2 or level == 1 else "NULL"
    name = "NULL" if codec is None else f"'{codec}'"
    got = spark.sql(f"SELECT r.frame_id, p.* FROM some_records r, LATERAL unpack_frame(r.bitmap, {vals}, 12, {name}, 7, 35) p")
    want = frames.unpack_records(packed, G, codec=codec)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_figures(spark, stack):
    packed = frames.pack_frames(table(spark, stack), np.full(35, 150), 50, G)
    kept = []
    m = metrics.measured(packed, G, lambda r: kept.extend(r.collect()))
    n = int((stack > 200).sum())
    assert (m["run_frames"], m["run_pixels"], m["raw_bytes"], m["last_frame"]) == (12, n, 12 * 70, 11)
    assert m["reduced_bytes"] == sum(5 + -(-int((f > 200).sum()) * 12 // 8) for f in stack) and m["compressed_bytes"] == sum(r.bitmap_bytes + r.vals_bytes for r in kept) and m["run_ms"] > 0
    both = metrics.metric_rows(spark, m).unionByName(metrics.metric_rows(spark, m))
    assert {r.metric: r.value for r in layout.metric_totals(both).collect()}["run_frames"] == 24
    none = metrics.measured(packed.limit(0), G, lambda r: r.collect())
    assert none["run_frames"] == 0 and none["compressed_bytes"] == 0


def test_log_of_a_stream(spark, stack, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    for k in range(3):
        table(spark, stack[4 * k : 4 * k + 4]).coalesce(1).write.mode("append").parquet(src)
    listener = metrics.RunLog(log)
    spark.streams.addListener(listener)
    try:
        s = chunks.chunk_stream(spark, src, "frame_id long, pixels binary")
        packed = metrics.observed(frames.pack_frames(s, np.full(35, 150), 50, G), G, "reduction")
        q = packed.writeStream.format("parquet").queryName("logged").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(60):
            rows = metrics.read_log(spark, log).collect()
            if any(r.event == "terminated" for r in rows):
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert {r.event for r in rows} == {"started", "batch", "terminated"} and len({r.run for r in rows}) == 1
    assert sorted(r.batch for r in rows if r.event == "batch" and r.rows) == [0, 1, 2] and all(r.ms > 0 for r in rows if r.rows)
    total = {r.metric: r.value for r in metrics.log_totals(metrics.read_log(spark, log)).collect()}
    assert (total["run_frames"], total["run_pixels"]) == (12, int((stack > 200).sum()))


@pytest.mark.parametrize("group,reach", [(1, 1), (16, 1), (3, 2), (5, 0)])
def test_matches_agree_with_all_pairs(spark, group, reach):
    g = np.random.default_rng(group)
    left = [(int(f), int(y), int(x), f"p{k}") for k, (f, y, x) in enumerate(zip(g.integers(-3, 30, 200), g.integers(0, 12, 200), g.integers(0, 12, 200)))] + [(None, 1, 1, "n"), (3, None, 1, "n"), (70, 1, 1, "far")]
    right = [(int(f), int(y), int(x)) for f, y, x in zip(g.integers(-3, 30, 150), g.integers(0, 14, 150), g.integers(-2, 12, 150))] + [(None, 1, 1), (3, 1, None), (80, 1, 1)]
    a = spark.createDataFrame(left, "frame_id long, cy int, cx int, name string").repartition(3)
    b = spark.createDataFrame(right, "frame_id long, cy int, cx int").repartition(3)
    near = lambda p, q: None not in p[:3] + q and p[0] == q[0] and abs(p[1] - q[1]) <= reach and abs(p[2] - q[2]) <= reach
    want = [p for p in left if not any(near(p, q) for q in right)]
    got = components.unmatched(a, b, reach, group)
    assert got.columns == a.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert components.unmatched(a, b.limit(0)).count() == len(left) and components.unmatched(a.limit(0), b).count() == 0


def test_weights_above_the_dark_frame_alone(spark, stack):
    above = {(r.frame_id, r.lab): r for r in frames.events(table(spark, stack), np.full(35, 150), 50, G).collect()}
    dark = frames.events(table(spark, stack), np.full(35, 150), 50, G, weights="dark").collect()
    assert len(dark) == len(above)
    for r in dark:
        e = above[r.frame_id, r.lab]
        assert (r.area, r.w, r.vmax, r.vmin) == (e.area, e.w + 50 * e.area, e.vmax + 50, e.vmin + 50) and (r.py, r.px) == (e.py, e.px)


def test_lines_bins_and_names(spark, stack):
    got = {(r.frame_id, r.y): r.line for r in views.text_lines(table(spark, stack), G).collect()}
    assert got == {(k, y): "".join(f"{v} " for v in stack[k, y]) for k in range(12) for y in range(5)}
    l1 = spark.createDataFrame([(0, 1, 1, 5), (21, 0, 0, 7)], "frame_id long, y int, x int, v int")
    every = spark.range(30).withColumnRenamed("id", "frame_id")
    assert {r.bin: r.total for r in views.dose_summary(l1, G, 10, frames=every).collect()} == {0: 5, 1: 0, 2: 7}
    p = views.view_percentile(views.fraction_view(l1, 10), G, 1.0, every.select((F.col("frame_id") / 10).cast("int").alias("bin")))
    assert {r.bin: r.p for r in p.collect()} == {0: 5.0, 1: 0.0, 2: 7.0}
    df = spark.createDataFrame([("Run_A", "run_a"), ("x", "y"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(scalar.same_name(F.col("a"), F.col("b"))).collect()] == [True, False, None]


def test_shares_of_bytes_that_differ(spark):
    rows = [(1, b"abcd", b"abxd"), (2, b"", b""), (3, b"ab", b"abcd"), (4, None, b"a")]
    a = spark.createDataFrame([(k, bytearray(x)) for k, x, _ in rows if x is not None], "frame_id long, data binary")
    b = spark.createDataFrame([(k, bytearray(y)) for k, _, y in rows], "frame_id long, data binary")
    assert {r.frame_id: r.share for r in layout.mismatch_share(a, b).collect()} == {1: 0.25, 2: 0.0, 3: 0.5, 4: 1.0}
    assert kernels.pack_bits(np.array([1, 0, 0, 0, 0, 0, 0, 1, 1, 1])) == bytes.fromhex("8103")

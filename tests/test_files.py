import os

import numpy as np
import pytest

from lumenframe.operators import frames, layout
from lumenframe.operators.frames import Geometry
from lumenframe.sources import headers, readers

G = Geometry(5, 7)


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(1).integers(0, 400, (9, 5, 7)).astype("<u2")


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    readers.register(spark)


def table(spark, stack):
    return spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(stack)], "frame_id long, pixels binary")


def read_back(df):
    return {r.frame_id: np.frombuffer(bytes(r.pixels), "<u2").reshape(5, 7) for r in df.collect()}


@pytest.mark.parametrize("kind", ["raw_frames", "mrc", "seq"])
def test_dense_formats_round_trip_and_prune(spark, stack, tmp_path, kind):
    out = str(tmp_path / kind)
    table(spark, stack).coalesce(1).write.format(kind).mode("overwrite").option("ny", 5).option("nx", 7).save(out)
    df = spark.read.format(kind).option("ny", 5).option("nx", 7).option("frames_per_partition", 2).load(out)
    got = read_back(df)
    assert len(got) == 9 and all((got[i] == stack[i]).all() for i in range(9))
    assert sorted(read_back(df.where("frame_id >= 3 AND frame_id < 5"))) == [3, 4]
    assert df.where("frame_id = 6").rdd.getNumPartitions() == 1


def test_cut_short_and_prefixed_raw_files(spark, stack, tmp_path):
    p = tmp_path / "v.bin"
    p.write_bytes(b"".join(int(i * 4).to_bytes(2, "little") + f.tobytes() for i, f in enumerate(stack)) + b"\1\2\3")
    got = read_back(spark.read.format("raw_frames").option("ny", 5).option("nx", 7).option("record_prefix", 2).load(str(p)))
    assert len(got) == 9 and (got[8] == stack[8]).all()


def test_bad_headers_fail(tmp_path):
    with pytest.raises(ValueError):
        headers.read_seq_header(b"\0" * 1024)
    with pytest.raises(ValueError):
        headers.read_mrc_header(headers.write_mrc_header(3, 3, 1, mode=6)[:1000])


@pytest.mark.parametrize("level", [1, 2, 3, 4])
@pytest.mark.parametrize("codec", ["none", "zlib", "zstd"])
def test_reduced_parts_and_merged_files(spark, stack, tmp_path, level, codec):
    dark = np.full(G.pixels, 150)
    packed = frames.pack_frames(table(spark, stack), dark, 100, G, level=level, codec=None if codec == "none" else codec)
    want = sorted(tuple(r) for r in frames.unpack_records(packed, G, codec=None if codec == "none" else codec).collect())
    for merged in ("false", "true"):
        out = str(tmp_path / merged)
        w = (packed.coalesce(1) if merged == "true" else packed.repartition(3)).write.format("rc").mode("overwrite")
        w.option("ny", 5).option("nx", 7).option("codec", codec).option("merged", merged).save(out)
        df = spark.read.format("rc").option("frames_per_partition", 2).load(out).drop("path")
        assert sorted(tuple(r) for r in df.collect()) == want
        assert {r.frame_id for r in df.where("frame_id = 4").collect()} <= {4}
    assert not [p for p in os.listdir(out) if p.startswith(".")]
    h = spark.read.format("rc_header").load(out).first().header
    assert h["reduction_level"] == str(level) and h["nx"] == "7"


def test_reducing_while_reading(spark, stack, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(stack.tobytes())
    dark = np.full(G.pixels, 150)
    got = readers.reduce_files(spark, str(tmp_path / "in"), "raw_frames", dark, 30, G, str(tmp_path / "t.bin"), frames_per_partition=4)
    want = frames.pack_frames(table(spark, stack), dark, 30, G)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r.frame_id for r in got.where("frame_id = 7").collect()] == [7]


def test_reduce_then_expand_is_the_clipped_difference(spark, stack):
    dark = np.arange(G.pixels) * 5
    l1 = frames.reduce_l1(table(spark, stack), dark, 7, G)
    got = read_back(frames.dense(l1, G, table(spark, stack)))
    want = np.maximum(stack.astype(int) - (dark + 7).reshape(5, 7), 0)
    assert all((got[i] == want[i]).all() for i in range(9))


def test_wrong_shapes_fail(spark, stack):
    with pytest.raises(ValueError):
        frames.reduce_l1(table(spark, stack), np.zeros(3), 0, G)
    with pytest.raises(Exception, match="pixels"):
        frames.reduce_l1(table(spark, stack), np.zeros(36), 0, Geometry(6, 6)).collect()


def test_merge_is_independent_of_part_order(spark):
    rows = [(f, p, f * 10 + p) for f in range(8) for p in range(3) if (f + p) % 2]
    a = layout.merge_parts(spark.createDataFrame(rows, "frame_id long, part int, n int"))
    b = layout.merge_parts(spark.createDataFrame(rows[::-1], "frame_id long, part int, n int").repartition(3))
    assert sorted(a.collect()) == sorted(b.collect())


def test_cli_round_trip(spark, stack, tmp_path):
    from lumenframe import cli
    from lumenframe.sources.params import RunParams

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(stack.tobytes())
    (tmp_path / "dark.bin").write_bytes(np.full((1, 5, 7), 120, "<u2").tobytes())
    params = RunParams(nx=7, ny=5, dark_threshold_epsilon=30)
    cli.reduce(spark, str(tmp_path / "in"), str(tmp_path / "dark.bin"), params, str(tmp_path / "rc"))
    cli.expand(spark, str(tmp_path / "rc"), str(tmp_path / "px"))
    cli.merge(spark, str(tmp_path / "rc"), str(tmp_path / "merged"))
    got = spark.read.parquet(str(tmp_path / "px"))
    assert got.count() == int((stack > 150).sum()) == spark.read.parquet(str(tmp_path / "merged")).count()
    assert got.selectExpr("sum(v)").first()[0] == int(np.maximum(stack.astype(int) - 150, 0).sum())

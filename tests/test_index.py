"""Indexes of reduced files, single frames by them, and merges by many tasks."""

import os
import re

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from lumenframe import cli
from lumenframe.operators import frames
from lumenframe.operators.frames import Geometry
from lumenframe.sources import headers, index, readers, store

G = Geometry(5, 7)


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    readers.register(spark)


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(3).integers(0, 400, (23, 5, 7)).astype("<u2")


def packed(spark, stack, level, codec, ids=None):
    rows = [(i, bytearray(f.tobytes())) for i, f in enumerate(stack) if ids is None or i in ids]
    return frames.pack_frames(spark.createDataFrame(rows, "frame_id long, pixels binary"), np.full(35, 150), 100, G, level=level, codec=None if codec == "none" else codec)


def write(df, path, codec, mode="overwrite", **options):
    w = df.write.format("rc").mode(mode).option("ny", 5).option("nx", 7).option("codec", codec)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


def pixels(df):
    return sorted((r.frame_id, r.y, r.x, r.v) for r in df.collect())


@pytest.mark.parametrize("level,codec", [(1, "zlib"), (2, "zstd"), (3, "none"), (4, "zlib"), (1, "none")])
def test_merges_by_any_number_of_tasks_give_the_file_of_one(spark, stack, tmp_path, level, codec):
    gone = {4, 5, 11}
    p = packed(spark, stack, level, codec, set(range(23)) - gone)
    write(p.coalesce(1), str(tmp_path / "one"), codec, merged="true")
    (one,) = [x for x in os.listdir(tmp_path / "one") if not x.startswith(".")]
    want = (tmp_path / "one" / one).read_bytes()
    parts = str(tmp_path / "parts")
    write(p.repartition(5), parts, codec)
    want_px = pixels(spark.read.format("rc").load(parts))
    for tasks in (1, 2, 7, 16, None):
        out = str(tmp_path / f"m{tasks}" / f"run.rc{level}")
        assert index.merge_files(spark, parts, out, tasks) == 23
        got = store.read(out)
        assert got[headers.REDUCED_SIZE :] == want[headers.REDUCED_SIZE :]
        assert headers.read_reduced_header(got)["nz"] == 23
        assert os.listdir(tmp_path / f"m{tasks}") == [f"run.rc{level}"]
        assert pixels(spark.read.format("rc").option("frames_per_partition", 4).load(out)) == want_px
    one_frame = spark.read.format("rc").option("frames_per_partition", 4).load(out).where("frame_id = 9")
    assert pixels(one_frame) == [x for x in want_px if x[0] == 9] and one_frame.rdd.getNumPartitions() == 1


def test_of_a_frame_in_several_parts_the_last_stays(spark, stack, tmp_path):
    parts = str(tmp_path / "parts")
    write(packed(spark, stack, 1, "zlib", {0, 1, 2, 3}).coalesce(1), parts, "zlib")
    os.rename(tmp_path / "parts" / "run.rc1_part000", tmp_path / "parts" / "run.rc1_part002")
    write(packed(spark, stack[::-1], 1, "zlib", {2, 3, 4}).coalesce(1), parts, "zlib", mode="append")
    os.rename(tmp_path / "parts" / "run.rc1_part000", tmp_path / "parts" / "run.rc1_part010")
    out = str(tmp_path / "run.rc1")
    cli.merge(spark, parts, out)
    last = spark.read.format("rc").load(str(tmp_path / "parts" / "*_part010"))
    first = spark.read.format("rc").load(str(tmp_path / "parts" / "*_part002")).where("frame_id < 2")
    assert pixels(spark.read.format("rc").load(out)) == sorted(pixels(last) + pixels(first))


def test_a_part_that_is_cut_short_is_no_merge(spark, stack, tmp_path):
    parts = tmp_path / "parts"
    write(packed(spark, stack, 1, "zlib").coalesce(1), str(parts), "zlib")
    p = parts / "run.rc1_part000"
    p.write_bytes(p.read_bytes()[:-3])
    with pytest.raises(Exception, match="cut short"):
        index.merge_files(spark, str(parts), str(tmp_path / "run.rc1"), 3)
    assert not (tmp_path / "run.rc1").exists()


def test_three_frames_of_very_many_open_three_places(spark, tmp_path, monkeypatch):
    """An index of 10^5 frames in 20 parts: the splits that are planned, and the files that they open."""
    n, per = 100_000, 5_000
    part = lambda k: (np.arange(per) * 20 + k).tolist()
    bits = bytes([1, 0, 0, 0, 0])
    folder = tmp_path / "parts"
    folder.mkdir()
    head = headers.write_reduced_header(reduction_level=3, rc_operation_mode=0, target_bit_depth=12, nx=7, ny=5, nz=per)
    for k in range(20):
        (folder / f"run.rc3_part{k:03d}").write_bytes(head + b"".join(f.to_bytes(4, "little") + bits for f in part(k)))
    at = str(tmp_path / "index")
    index.write_index(spark, str(folder), at)
    assert spark.read.parquet(at).count() == n
    every = readers.RcReader({"index": at}).partitions()
    assert len(every) >= 8 and sum(s.n for s in every) == n

    def planned(*filters):
        r = readers.RcReader({"index": at})
        assert not list(r.pushFilters(list(filters)))
        return r, r.partitions()

    r, splits = planned(In(("frame_id",), (7, 40_003, 99_999)))
    assert len(splits) <= 3
    opened = []
    plain = store.open_read
    monkeypatch.setattr(store, "open_read", lambda p: (opened.append(p), plain(p))[1])
    got = [b.to_pydict() for s in splits for b in r.read(s)]
    assert sorted(b["frame_id"][0] for b in got) == [7, 40_003, 99_999] and all(b["y"] == [0] and b["x"] == [0] for b in got)
    assert sorted(re.search(r"part(\d+)$", p)[1] for p in opened if "part0" in p and not p.endswith(".parquet")) == ["003", "007", "019"]
    assert len(planned(EqualTo(("frame_id",), 12_345))[1]) == 1
    assert len(planned(GreaterThanOrEqual(("frame_id",), 500), LessThan(("frame_id",), 600))[1]) <= 2
    assert planned(EqualTo(("frame_id",), 10**7))[1][0].path == ""
    df = spark.read.format("rc").option("index", at).load()
    assert [x.frame_id for x in df.where("frame_id = 12345").collect()] == [12_345]
    assert df.where("frame_id < 40").count() == 40


def test_triplets(spark, stack, tmp_path):
    px = frames.reduce_l1(spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(stack)], "frame_id long, pixels binary"), np.full(35, 150), 100, G).where("frame_id NOT IN (3, 9, 10)")
    out = str(tmp_path / "t")
    px.repartitionByRange(3, "frame_id").sortWithinPartitions("frame_id", "y", "x").write.format("triplets").mode("overwrite").option("ny", 5).option("nx", 7).save(out)
    back = spark.read.format("triplets").load(out)
    assert pixels(back) == pixels(px)
    assert {r.frame_id for r in back.where("frame_id IN (2, 3, 11)").collect()} == {2, 11}
    with pytest.raises(Exception, match="not sorted"):
        px.coalesce(1).orderBy("v").sortWithinPartitions("v").write.format("triplets").mode("overwrite").option("ny", 5).option("nx", 7).save(out)


def test_sorted_writers_stream_and_say_so_when_rows_are_not(spark, stack, tmp_path):
    rows = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(stack)], "frame_id long, pixels binary").coalesce(1)
    for kind in ("raw_frames", "mrc", "seq"):
        out = str(tmp_path / kind)
        w = lambda df: df.write.format(kind).mode("overwrite").option("ny", 5).option("nx", 7).option("sorted", "true").save(out)  # noqa: B023, E731
        w(rows.sortWithinPartitions("frame_id"))
        got = spark.read.format(kind).option("ny", 5).option("nx", 7).load(out)
        assert {r.frame_id: bytes(r.pixels) for r in got.collect()} == {i: f.tobytes() for i, f in enumerate(stack)}
        with pytest.raises(Exception, match="not sorted"):
            w(rows.sortWithinPartitions(rows.frame_id.desc()))
    h = spark.read.format("seq_header").load(str(tmp_path / "seq")).first().header
    assert h["allocated_frames"] == "23"


def test_command_line(spark, stack, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.bin").write_bytes(stack.tobytes())
    (tmp_path / "dark.bin").write_bytes(np.full((1, 5, 7), 120, "<u2").tobytes())
    (tmp_path / "p.txt").write_text("num_rows = 5\nnum_cols = 7\ndark_threshold_epsilon = 30\nvalidation_frame_gap = 4\n")
    run = lambda *a: cli.main(list(map(str, a)))
    assert run("reduce", "-i", tmp_path / "in", "-d", tmp_path / "dark.bin", "-p", tmp_path / "p.txt", "-o", tmp_path / "rc", "-v", "-vf", tmp_path / "val") == 0
    assert f"run_frames\t{len(stack)}" in capsys.readouterr().out
    got = spark.read.format("raw_frames").option("ny", 5).option("nx", 7).option("record_prefix", 8).option("prefix_id", "true").load(str(tmp_path / "val"))
    assert {r.frame_id: bytes(r.pixels) for r in got.collect()} == {i: stack[i].tobytes() for i in range(0, 23, 4)}
    assert run("merge", "-i", tmp_path / "rc", "-o", tmp_path / "m" / "run.rc1") == 0
    assert run("index", "-i", tmp_path / "rc", "-o", tmp_path / "ix") == 0
    assert run("expand", "-i", tmp_path / "m" / "run.rc1", "-o", tmp_path / "t", "--triplets") == 0
    want = pixels(spark.read.format("rc").load(str(tmp_path / "rc")))
    assert pixels(spark.read.format("triplets").load(str(tmp_path / "t"))) == want == pixels(spark.read.format("rc").option("index", str(tmp_path / "ix")).load())
    assert run("calibrate", "-i", tmp_path / "in", "-p", tmp_path / "p.txt", "-o", tmp_path / "cal", "--sigmas", 2, "--n-stats", 9, "--accurate-sigma", 1) == 0
    assert {r.n_frames for r in spark.read.parquet(str(tmp_path / "cal" / "report")).collect()} == {9}

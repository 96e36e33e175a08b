"""Chunk files as a stream: order, files that are held back, restarts, and state over batches."""

import os
import time

import numpy as np
import pytest

from lumenframe.operators import frames
from lumenframe.operators.frames import Geometry
from lumenframe.sources import headers, readers, store
from lumenframe.streaming import arrivals, chunks, sinks, stateful

G = Geometry(4, 6)


def frame(k):
    return ((np.arange(24) * 7 + k * 31) % 251).astype("<u2")


def chunk(folder, name, first, n, age):
    """A SEQ file of n frames that was written ``age`` seconds ago."""
    os.makedirs(folder, exist_ok=True)
    body = b"".join(frame(k).tobytes().ljust(1024, b"\0") for k in range(first, first + n))
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(headers.write_seq_header(6, 4, n).ljust(headers.SEQ_DATA, b"\0") + body)
    t = time.time() - age
    os.utime(path, (t, t))
    return path


def take(spark, tmp_path, **options):
    s = arrivals.arriving(spark, str(tmp_path / "in"), str(tmp_path / "log"), frames_per_partition=2, **options)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.chunk_id, r["index"], r.frame_id, bytes(r.pixels), r.path.rsplit("/", 1)[-1]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_oldest_first_newest_held_back_and_numbered_over_restarts(spark, tmp_path):
    d = str(tmp_path / "in")
    chunk(d, "z.seq", 0, 3, 500)
    chunk(d, "b.seq", 3, 5, 400)
    chunk(d, "a.seq", 8, 2, 300)
    chunk(d, "m.seq", 10, 4, 200)
    chunk(d, "x.tmp", 0, 1, 900)
    got = take(spark, tmp_path)
    want = [(0, i, i, frame(i).tobytes(), "z.seq") for i in range(3)] + [(1, i, 3 + i, frame(3 + i).tobytes(), "b.seq") for i in range(5)] + [(2, i, 8 + i, frame(8 + i).tobytes(), "a.seq") for i in range(2)]
    assert got == want
    assert take(spark, tmp_path) == want  # nothing new
    chunk(d, "c.seq", 14, 1, 100)
    chunk(d, "a.seq", 8, 2, 50)  # a name that was taken
    want += [(3, i, 10 + i, frame(10 + i).tobytes(), "m.seq") for i in range(4)] + [(4, 0, 14, frame(14).tobytes(), "c.seq")]
    assert take(spark, tmp_path) == want
    # the last chunk goes once the run is stopped
    chunk(d, "last.seq", 15, 2, 10)
    (tmp_path / "in" / "stop").write_text("")
    want += [(5, i, 15 + i, frame(15 + i).tobytes(), "last.seq") for i in range(2)]
    assert take(spark, tmp_path, stop_file=str(tmp_path / "in" / "stop")) == want


@pytest.mark.parametrize("clean", ["delete", "archive"])
def test_done_files_are_removed(spark, tmp_path, clean):
    d = str(tmp_path / "in")
    for k in range(12):
        chunk(d, f"run_{k}.seq", k, 1, 100)
    options = dict(order="name", clean=clean, archive=str(tmp_path / "old"), skip_first=1)
    got = take(spark, tmp_path, **options)
    assert [g[4] for g in got] == [f"run_{k}.seq" for k in range(1, 11)]  # 2 before 10, the first passed over, the last held back
    chunk(d, "run_12.seq", 12, 1, 1)
    take(spark, tmp_path, **options)
    left = set(os.listdir(d))
    assert {"run_0.seq", "run_12.seq"} <= left and not left & {f"run_{k}.seq" for k in range(1, 11)}
    if clean == "archive":
        assert set(os.listdir(tmp_path / "old")) >= {f"run_{k}.seq" for k in range(1, 11)}


def test_a_batch_that_runs_again_has_the_same_files(tmp_path):
    d = str(tmp_path / "in")
    for k in range(5):
        chunk(d, f"{k}.seq", 2 * k, 2, 100 - k)
    options = {"path": d, "log": str(tmp_path / "log"), "files_per_batch": "2"}
    r = arrivals.ChunkReader(options)
    a, b = r.latestOffset(), r.latestOffset()
    assert (a, b) == ({"entry": 1}, {"entry": 2}) and r.latestOffset() == b
    again = arrivals.ChunkReader(options)
    parts = lambda x, s, e: [(p.path, p.chunk, p.base, p.first, p.last) for p in x.partitions(s, e)]
    assert parts(again, a, b) == parts(r, a, b) == [(f"{d}/{k}.seq", k, 2 * k, 0, 2) for k in (2, 3)]
    assert parts(again, again.initialOffset(), b) == parts(r, {"entry": 0}, a) + parts(r, a, b)
    assert again.latestOffset() == b
    with pytest.raises(ValueError):
        arrivals.ChunkReader({"path": d})


def heads(spark, path, rows):
    spark.createDataFrame(rows, "run string, chunk_id long, n long").coalesce(1).write.mode("append").parquet(path)


def test_numbers_hang_on_chunks_not_on_arrival(spark, tmp_path):
    src, out, cp = (str(tmp_path / k) for k in ("src", "out", "cp"))
    sizes = {("a", k): k + 1 for k in range(9)} | {("b", k): 5 for k in range(4)}

    def run():
        s = stateful.number_chunks(chunks.chunk_stream(spark, src, "run string, chunk_id long, n long"))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(180)
        return sorted(tuple(r) for r in spark.read.parquet(out).select("run", "chunk_id", "n", "run_offset").collect())

    pick = lambda *ks: [(r, k, sizes[r, k]) for r, k in ks]
    heads(spark, src, pick(("a", 3), ("a", 0), ("b", 1)))
    heads(spark, src, pick(("a", 2), ("b", 0)))
    got = run()
    assert got == [("a", 0, 1, 0), ("b", 0, 5, 0), ("b", 1, 5, 5)]
    # after a restart: what waited comes with its turn, repeats are passed over
    heads(spark, src, pick(("a", 1), ("a", 0), ("a", 8), ("b", 1)))
    heads(spark, src, pick(("a", 7), ("a", 4), ("a", 6), ("a", 5), ("b", 3), ("b", 2)))
    offset, want = {"a": 0, "b": 0}, []
    for (r, k), n in sorted(sizes.items()):
        want.append((r, k, n, offset[r]))
        offset[r] += n
    assert run() == want


@pytest.mark.parametrize("slack", [0, 3])
def test_views_close_by_their_number_of_frames(spark, tmp_path, slack):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    batches = [[0, 1, 2, 3], [4, 6, 7, 5], [8, 9, 12, 13], [10, 2, 30, 31], [32, 33, 34, 36], [40, 41, 42, 43]]
    for k, b in enumerate(batches):
        rows = [(i, bytearray(frame(i).tobytes())) for i in b]
        spark.createDataFrame(rows, "frame_id long, pixels binary").coalesce(1).write.mode("append").parquet(src)
    s = chunks.chunk_stream(spark, src, "frame_id long, pixels binary")
    v = stateful.count_views(stateful.banded(s, np.full(24, 100), 5, G, bands=2), 5, slack=slack)
    q = v.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    # a batch is one step: within it all frames are there before views close
    want, order = [], []
    start, seen, late, held = 0, -1, 0, set()
    for b in batches:
        for k in b:
            if k < start:
                late += 1
            else:
                held.add(k)
                seen = max(seen, k)
        while held:
            mine = sorted(x for x in held if x < start + 5)
            if len(mine) < 5 and seen < start + 5 + slack:
                break
            if not mine:
                start = min(held)
                continue
            want.append((start, mine[-1], len(mine), sorted(set(range(start, mine[-1])) - set(mine)), late))
            order.append(mine)
            held -= set(mine)
            start, late = mine[-1] + 1, 0
    got = spark.read.parquet(out)
    for band in (0, 1):
        assert sorted((r.start, r.last, r.n_frames, list(r.missing), r.late) for r in got.where(f"band = {band}").collect()) == want
    total: dict = {}
    for (a, *_), mine in zip(want, order):
        for k in mine:
            for i, p in enumerate(frame(k).astype(int) - 105):
                if p > 0:
                    total[a, i // 6, i % 6] = total.get((a, i // 6, i % 6), 0) + p
    assert {(r.start, r.y, r.x): r.sum_v for r in stateful.view_pixels(got, G).collect()} == total


def test_a_stalled_view_closes_after_a_while(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, bytearray(frame(i).tobytes())) for i in (0, 1, 3)], "frame_id long, pixels binary").coalesce(1).write.parquet(src)
    s = chunks.chunk_stream(spark, src, "frame_id long, pixels binary")
    v = stateful.count_views(stateful.banded(s, np.full(24, 100), 5, G, bands=1), 5, timeout_ms=500)
    q = v.writeStream.format("memory").queryName("stalled").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            rows = spark.sql("SELECT start, last, n_frames, missing FROM stalled").collect()
            if rows:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.start, r.last, r.n_frames, list(r.missing)) for r in rows] == [(0, 3, 3, [2])]


def test_a_replayed_batch_leaves_the_same_bytes(spark, tmp_path):
    batch = spark.createDataFrame([(i, bytearray(frame(i).tobytes())) for i in range(40)], "frame_id long, pixels binary")
    out = str(tmp_path / "out")

    def files():
        return {os.path.relpath(os.path.join(d, n), out): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(os.path.join(out, "validation")) for n in names if not n.startswith(".")}

    sinks.write_batch(batch.repartition(3), 7, np.full(24, 100), 5, G, out, 3, dose_size=4)
    first = files()
    assert first and all(n.startswith("validation/batch=7/validation_") for n in first)
    sinks.write_batch(batch.repartition(5), 7, np.full(24, 100), 5, G, out, 3, dose_size=4)
    assert files() == first
    got = {r.frame_id: bytes(r.pixels) for r in sinks.validation_frames(spark, out, G).collect()}
    assert got == {i: frame(i).tobytes() for i in range(0, 40, 3)}
    some = sinks.validation_frames(spark, out, G).where("frame_id IN (6, 7, 33)")
    assert sorted(r.frame_id for r in some.collect()) == [6, 33]
    want = frames.reduce_l1(batch, np.full(24, 100), 5, G)
    assert sorted(map(tuple, frames.unpack_records(spark.read.parquet(f"{out}/records").drop("batch"), G).collect())) == sorted(map(tuple, want.collect()))
    assert {r.frame_id for r in spark.read.parquet(f"{out}/dose").collect()} == set(range(0, 40, 3))
    sinks.write_batch(batch, 8, np.full(24, 100), 5, G, out, 0)
    assert files() == first


def test_ids_from_file_names_and_natural_order(spark, tmp_path):
    readers.register(spark)
    for k in (1, 2, 10):
        (tmp_path / f"Frame_{k}.bin").write_bytes(frame(k).tobytes())
    (tmp_path / "notes.bin").write_bytes(b"")
    r = spark.read.format("raw_frames").option("ny", 4).option("nx", 6)
    named = r.option("id_pattern", r"Frame_(\d+)\.bin").load(str(tmp_path))
    assert {x.frame_id: bytes(x.pixels) for x in named.collect()} == {k: frame(k).tobytes() for k in (1, 2, 10)}
    assert [x.frame_id for x in named.where("frame_id > 2").collect()] == [10]
    run = spark.read.format("raw_frames").option("ny", 4).option("nx", 6).option("numbering", "run").load(str(tmp_path / "Frame_*.bin"))
    assert {x.frame_id: bytes(x.pixels) for x in run.collect()} == {i: frame(k).tobytes() for i, k in enumerate((1, 2, 10))}


def test_store(tmp_path):
    p = f"file://{tmp_path}/a"
    store.make_folder(p)
    store.write(f"{p}/x_2.bin", b"two")
    store.write(f"{p}/x_10.bin", b"ten")
    store.write(f"{p}/.hidden", b"")
    assert [x.rsplit("/", 1)[-1] for x in readers.find(p)] == ["x_2.bin", "x_10.bin"] and readers.find(f"{p}/*_2.bin")[0].endswith("x_2.bin")
    store.patch(f"{p}/x_2.bin", 1, b"ne")
    store.move(f"{p}/x_2.bin", f"{p}/x_10.bin")
    assert store.read(f"{p}/x_10.bin") == b"tne" and store.size(f"{p}/x_10.bin") == 3 and not store.exists(f"{p}/x_2.bin")
    with pytest.raises(FileNotFoundError):
        readers.find(f"{p}/none")


def test_a_batch_of_very_many_files_has_few_tasks(tmp_path):
    d = str(tmp_path / "in")
    for k in range(40):
        chunk(d, f"{k}.seq", 5 * k, 5, 100)
    r = arrivals.ChunkReader({"path": d, "log": str(tmp_path / "log"), "order": "name", "hold_back": "0", "frames_per_partition": "2"})
    small = r.partitions(r.initialOffset(), r.latestOffset())
    assert len(small) == 120
    few = arrivals.grouped(small, 7)
    assert len(few) == 7
    rows = lambda parts: [(p, c, i, f, x) for q in parts for b in r.read(q) for p, c, i, f, x in zip(*(b.column(j).to_pylist() for j in range(5)))]
    assert rows(few) == rows(small) and [x[3] for x in rows(few)] == list(range(200))
    assert max(sum(s.last - s.first for s in q.slices) for q in few) <= 30
    assert len(few[0].slices) <= 7  # neighbours in a file are one
    many = [arrivals.Slice(f"{d}/0.seq", k, k, 0, 1) for k in range(5000)]
    assert len(arrivals.grouped(many)) == arrivals.MOST_TASKS and len(arrivals.grouped([])) == 0


def test_a_task_writes_a_file_for_every_so_many_frames(spark, tmp_path):
    readers.register(spark)
    rows = spark.createDataFrame([(k, frame(k).tobytes()) for k in range(3, 50) if k not in range(20, 30)], "frame_id long, pixels binary")
    out = str(tmp_path / "out")
    w = lambda df: df.write.format("seq").mode("overwrite").option("ny", 4).option("nx", 6).option("frames_per_file", 10).option("sorted", "true").save(out)
    w(rows.repartition(2, (rows.frame_id / 10).cast("int")).sortWithinPartitions("frame_id"))
    assert sorted(n for n in os.listdir(out) if not n.startswith(".")) == ["frames_000.seq", "frames_001.seq", "frames_003.seq", "frames_004.seq"]
    got = spark.read.format("seq").option("numbering", "run").load(out)
    assert [bytes(r.pixels) for r in got.orderBy("frame_id").collect()] == [frame(k).tobytes() for k in range(3, 50) if k not in range(20, 30)]
    with pytest.raises(Exception, match="one file"):
        w(rows.repartition(4, "frame_id").sortWithinPartitions("frame_id"))
    assert len([n for n in os.listdir(out) if not n.startswith(".")]) == 4

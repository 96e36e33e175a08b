"""What a kernel gives at once hangs on the bytes of frames, not on the batch that comes."""

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.operators import frames, views
from lumenframe.operators.frames import SLICE_BYTES, Geometry, by_slices

G = Geometry(64, 64)
N = 1500
RNG = np.random.default_rng(4)
IMAGES = RNG.integers(0, 200, (N, G.pixels)).astype("<u2")
IMAGES[:, :: G.nx + 7] += 900
IMAGES[7] = 0
DARK = np.full(G.pixels, 190)


class Frames:
    """Stands for a frame: keeps the kernel and runs it over one batch."""

    def __init__(self, spark, batch):
        self.sparkSession, self.batch = spark, batch

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, run, _):
        return list(run(iter([self.batch, self.batch.slice(0, 0), self.batch.slice(3, 2)])))


@pytest.fixture
def given(spark):
    return Frames(spark, pa.RecordBatch.from_arrays([pa.array(range(N), pa.int64()), pa.array([i.tobytes() for i in IMAGES], pa.binary())], ["frame_id", "pixels"]))


def _ids(out):
    return [f for b in out for f in dict.fromkeys(b.column(0).to_pylist())]


def test_a_spectrum_batch_is_no_larger_than_a_slice(given):
    out = views.spectrum(given, G)
    assert max(b.num_rows for b in out) * 8 * G.pixels <= SLICE_BYTES
    assert _ids(out) == [*range(N), 3, 4]
    last = np.asarray(out[-1].column(1)[1].as_py())
    s = np.log(np.abs(np.fft.fftshift(np.fft.fft2(IMAGES[4].reshape(64, 64)))))
    np.testing.assert_allclose(last, s.ravel(), atol=1e-6)
    dark = next(b for b in out if 7 in b.column(0).to_pylist())
    assert set(dark.column(1)[dark.column(0).to_pylist().index(7)].as_py()) == {0.0}


def test_slices_keep_order_and_a_frame_larger_than_one_is_a_slice():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], ["k"])
    whole = lambda out: [b.column(0).to_pylist() for b in out]
    assert whole(by_slices(lambda b: b, SLICE_BYTES // 4)(iter([batch, batch.slice(0, 0)]))) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert whole(by_slices(lambda b: b, SLICE_BYTES * 3)(iter([batch]))) == [[k] for k in range(10)]
    assert whole(by_slices(lambda b: None, 0)(iter([batch]))) == []


def test_a_batch_is_let_go_before_the_next_is_read():
    import weakref

    class Batch:
        num_rows = 3

        def slice(self, a, n):
            return (a, n)

    held = []

    def given():
        for _ in range(3):
            assert all(w() is None for w in held)
            b = Batch()
            held.append(weakref.ref(b))
            yield b
            del b

    run = by_slices(lambda s: s, SLICE_BYTES)
    # a caller that drops what it got, as the worker does on its next write
    assert sum(1 for _ in run(given())) == 9


def _rows(out):
    return [tuple(r.values()) for b in out for r in b.to_pylist()]


@pytest.mark.parametrize("how", ["l1", "events", "dark", "dropped", "stats", "packed"])
def test_kernels_give_slices_with_the_rows_of_each_frame_alone(given, how):
    run = {
        "l1": lambda f: frames.reduce_l1(f, DARK, 5, G),
        "events": lambda f: frames.events(f, DARK, 5, G),
        "dark": lambda f: frames.events(f, DARK, 5, G, weights="dark"),
        "dropped": lambda f: frames.events(f, DARK, 5, G, border="drop"),
        "stats": lambda f: frames.frame_stats(f, DARK, 5, G),
        "packed": lambda f: frames.pack_frames(f, DARK, 5, G, codec=None),
    }[how]
    out = run(given)
    assert max(len(_ids([b])) for b in out) * G.nbytes <= SLICE_BYTES
    one = lambda k: _rows(run(Frames(given.sparkSession, given.batch.slice(k, 1)))[:1])
    got = _rows(out)
    for k in (0, 511, 512, 1024, N - 1):
        want = one(k)
        assert want and [r for r in got if r[0] == k] == want
    assert len(set(r[0] for r in got)) == N - (how in ("l1", "events", "dark", "dropped"))


def test_codecs_sizes_come_from_one_pass(spark):
    from pyspark.sql import functions as F

    from lumenframe.functions import codecs
    from lumenframe.operators import layout

    given = spark.createDataFrame([(b"abcd" * 40, b"q" * 30), (b"xy" * 9, b""), (None, b"z")], "bitmap binary, vals binary").repartition(2)
    made = spark.sparkContext.accumulator(0)

    def passes(it):
        for b in it:
            made.add(b.num_rows)
            yield b

    got = {r.codec: (r.rer, r.cor, r.rcr) for r in layout.codec_ratios(given.mapInArrow(passes, given.schema), ("zlib", "bz2", "shuffle_zstd"), 512).collect()}
    assert made.value == 3 and set(got) == {"zlib", "bz2", "shuffle_zstd"}
    for name, found in got.items():
        s = given.select((F.length("bitmap") + F.length("vals")).alias("reduced"), (F.length(codecs.compressed("bitmap", name)) + F.length(codecs.compressed("vals", name))).alias("compressed"))
        assert found == tuple(layout.size_ratios(s, 512).first())
    with pytest.raises(ValueError):
        layout.codec_ratios(given, ("zip",), 512)


def test_sums_of_frames_of_one_id_count_together(spark):
    g = Geometry(2, 3)
    a, b = np.array([1, 2, 3, 4, 5, 6], "<u2"), np.array([65535, 0, 0, 0, 0, 7], "<u2")
    df = spark.createDataFrame([(1, a.tobytes()), (1, b.tobytes()), (2, None), (None, a.tobytes())], "frame_id long, pixels binary")
    got = {tuple(r) for r in frames.pixel_sums(df, g).collect()}
    assert got == {(1, 12, 21 + 65542, 65535, 70 + 35), (None, 6, 21, 6, 70)}


@pytest.mark.parametrize("name, kernels", [("recalibrate", 4), ("expand_dense", 4)])
def test_images_are_made_once_where_frames_are_rebuilt(spark, sf_dir, name, kernels):
    from lumenframe.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == kernels  # images, sparse rows, whole frames and what is made of these; ids come without images


def test_recalibrated_frames_come_in_slices(spark, given, monkeypatch):
    whole = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([i.astype("<i4").tobytes() for i in IMAGES[:600]], pa.binary())], ["frame_id", "pixels"])
    monkeypatch.setattr(frames, "dense", lambda *_: Frames(spark, whole))
    out = frames.recalibrate(given, DARK, DARK - 3, 1, G)
    assert max(len(_ids([b])) for b in out) * 4 * G.pixels <= SLICE_BYTES
    assert _ids(out) == [*range(600), 3, 4]
    assert [r[3] for r in _rows(out) if r[0] == 599] == (IMAGES[599] + 2).tolist()

"""Per-pixel statistics by tiles, and events at many thresholds, against plain numpy."""

import numpy as np
import pytest

from lumenframe.functions import kernels
from lumenframe.operators import calibration, frames, tiles
from lumenframe.operators.frames import Geometry

G = Geometry(9, 11)


def table(spark, stack, parts=3, extra=()):
    rows = [(i, bytearray(np.ascontiguousarray(f).tobytes())) for i, f in enumerate(stack)] + list(extra)
    return spark.createDataFrame(rows, "frame_id long, pixels binary").repartition(parts)


def image(df, column, geom=G):
    out = np.full((geom.ny, geom.nx), np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize("n,tile,held", [(1, 16, 1 << 22), (2, 7, 1 << 22), (31, 16, 50), (40, 1000, 300)])
def test_statistics_are_exact_however_tables_are_cut(spark, monkeypatch, n, tile, held):
    monkeypatch.setattr(tiles, "HELD", held)
    monkeypatch.setattr(tiles, "BLOCK_BYTES", 8 * G.pixels * 3)
    stack = np.random.default_rng(n).integers(0, [5, 70000][n % 2 == 0] if n < 40 else 65536, (n, 9, 11)).clip(0, 65535).astype("<u2")
    hist = tiles.tile_histograms(table(spark, stack, extra=[(99, None)]), G, tile)
    assert hist.count() == -(-99 // tile)
    stats = tiles.pixel_stats(hist, G, tile).collect()
    assert len(stats) == 99
    for r in stats:
        v = stack[:, r.y, r.x].astype(float)
        assert r.med == np.median(v) and abs(r.std - v.std()) < 1e-9 * max(1, v.std())
    got = {(r.y, r.x, r.bin): r.n for r in tiles.pixel_histograms(hist, G, 3, tile).collect()}
    want: dict = {}
    for f in stack:
        for (y, x), v in np.ndenumerate(f):
            want[y, x, v // 3] = want.get((y, x, v // 3), 0) + 1
    assert got == want
    d = stack - np.median(stack, axis=0)
    assert {r.d: r.n for r in tiles.deviations(hist).collect()} == dict(zip(*(a.tolist() for a in np.unique(d, return_counts=True))))
    last = tiles.deviations(tiles.tile_histograms(table(spark, stack[-1:]), G, tile), hist)
    assert {r.d: r.n for r in last.collect()} == dict(zip(*(a.tolist() for a in np.unique(d[-1], return_counts=True))))


def test_signed_values_and_empty_tables(spark):
    geom = Geometry(2, 3, "<i4")
    stack = np.array([[[-(2**31), 5, 0], [1, 2, 3]], [[2**31 - 1, 7, 0], [1, 2, 4]]], "<i4")
    got = image(tiles.pixel_stats(tiles.tile_histograms(table(spark, stack), geom), geom), "med", geom)
    assert (got == np.median(stack.astype(float), axis=0)).all()
    none = table(spark, stack[:0])
    assert tiles.tile_histograms(none, G).count() == 0 and tiles.greatest_of_frames(none, G, 3).count() == 0
    with pytest.raises(ValueError):
        tiles.tile_histograms(none, Geometry(2, 3, "<f4"))


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_greatest_values(spark, monkeypatch, k):
    monkeypatch.setattr(tiles, "HELD", 64)
    monkeypatch.setattr(tiles, "BLOCK_BYTES", 600)
    stack = np.random.default_rng(k).integers(0, 9, (30, 9, 11)).astype("<u2")
    f = table(spark, stack)
    order = -np.sort(-stack.astype(int), axis=0)
    for top in (tiles.greatest_of_frames(f, G, k, 16), tiles.greatest(frames.pixels(f, G), G, k, "adu", 16)):
        rows = tiles.nth_greatest(top, G, [1, k], 16)
        assert (image(rows, "v1") == order[0]).all()
        got = image(rows, "v2")
        assert np.isnan(got).all() if k > 30 else (got == order[k - 1]).all()


def test_thresholds_by_greatest_values(spark):
    rows = [(0, 0, v) for v in (9, 7, 7, 3)] + [(0, 1, 5)] + [(8, 10, v) for v in range(20)] + [(None, 3, 1), (4, 4, None)]
    values = spark.createDataFrame(rows, "y int, x int, v int").repartition(3)
    mid = {(r.y, r.x): r.t for r in calibration.topk_midpoint(values, 2, G, tile=10).collect()}
    assert mid == {(0, 0): 7.0, (0, 1): None, (8, 10): 17.5}
    gain = image(calibration.gain_threshold(values, 3, G, tile=10), "t")
    want = np.full((9, 11), 4096.0)
    want[0, 0], want[8, 10] = 4, 17
    assert (gain == want).all()


@pytest.mark.parametrize("seed", range(4))
def test_components_at_every_level_agree_with_labelling_each(seed):
    g = np.random.default_rng(seed)
    ny, nx, n = [(1, 1, 3), (1, 30, 4), (17, 1, 2), (25, 31, 6)][seed]
    for density in (0.05, 0.4, 0.9):
        level = np.where(g.random((ny, nx)) < density, g.integers(0, n + 1, (ny, nx)), 0)
        events, pixels = kernels.level_components(level, n)
        for i in range(n):
            y, x = np.nonzero(level > i)
            lab = kernels.label(np.zeros(len(y), int), y, x, ny, nx)
            assert (events[i], pixels[i]) == (len(np.unique(lab)), len(y))


def test_calibration_run(spark):
    g = np.random.default_rng(6)
    geom = Geometry(20, 24)
    stack = (100 + g.normal(0, 5, (60, 20, 24)).round() + 400 * (g.random((60, 20, 24)) < 0.02)).clip(0, 4095).astype("<u2")
    thresholds, report, exact = calibration.sigma_report(table(spark, stack), geom, 6, n_stats=15, accurate_sigma=5)
    med = np.median(stack, axis=0)
    t = {i: image(thresholds.where(f"i = {i}"), "t", geom) for i in (0, 3)}
    sigma = calibration.global_sigma(tiles.deviations(tiles.tile_histograms(table(spark, stack[-15:]), geom), tiles.tile_histograms(table(spark, stack), geom)))
    assert 3 < sigma < 8 and (t[0] == np.floor(med)).all() and (t[3] == np.floor(med + 3 * sigma)).all()
    rows = {r.i: r for r in report.collect()}
    assert sorted(rows) == list(range(6))
    for i, r in rows.items():
        events = fg = 0
        for f in stack[-15:]:
            y, x = np.nonzero(f > np.floor(med + sigma * i))
            events += len(np.unique(kernels.label(np.zeros(len(y), int), y, x, 20, 24)))
            fg += len(y)
        assert (r.n_frames, r.n_events) == (15, events) and r.fg_share == fg / (15 * 480) and r.rate == events / (15 * 480)
    expected = int(np.ceil(60 * rows[5].rate))
    if expected < 2:
        assert exact is None
    else:
        order = -np.sort(-stack.astype(int), axis=0)
        assert (image(exact, "t", geom) == (order[expected - 1] + order[expected]) / 2).all()
    assert calibration.sigma_report(table(spark, stack[:, :, :]), geom, 2, n_stats=5, accurate_sigma=9, sigma=sigma)[2] is None


def test_row_medians(spark):
    stack = np.random.default_rng(2).integers(0, 99, (5, 9, 11)).astype("<u2")
    got = {(r.frame_id, r.y): r.med for r in calibration.row_medians(table(spark, stack), G).collect()}
    assert got == {(f, y): np.median(stack[f, y]) for f in range(5) for y in range(9)}


def test_calibration_array_is_put_together_from_pieces(spark):
    geom = Geometry(300, 700)
    rows = [(y, x, y * 7 + x) for y in range(0, 300, 3) for x in range(0, 700, 50)] + [(5, 5, None), (400, 0, 9)]
    got = frames.calibration_array(spark.createDataFrame(rows, "y int, x int, t int").repartition(4), geom).reshape(300, 700)
    want = np.zeros((300, 700), int)
    for y, x, t in rows[:-2]:
        want[y, x] = t
    assert (got == want).all()

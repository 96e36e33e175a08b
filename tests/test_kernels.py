import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.functions import codecs, kernels
from lumenframe.functions.scalar import type_code
from lumenframe.sources import headers
from lumenframe.sources.params import RunParams

GOLDEN = ["000000011", "011000000", "011000000", "000000000", "100100000", "010010000", "001000000", "011000001", "100000011"]


def test_packed_values_and_bits():
    assert kernels.pack_values(np.array([78, 145]), 12) == bytes([0x4E, 0x10, 0x09])
    mask = np.zeros(16, bool)
    mask[[0, 7, 8, 9]] = True
    assert kernels.pack_bits(mask) == bytes([0x81, 0x03])


def test_components_of_the_small_frame():
    img = np.array([[int(c) for c in r] for r in GOLDEN])
    y, x = np.nonzero(img)
    e = kernels.event_rows(np.zeros(len(y)), y, x, np.ones(len(y)), 9, 9)
    got = list(zip(*(e[k].tolist() for k in ("lab", "area", "wy", "wx"))))
    assert got == [(7, 2, 0, 15), (10, 4, 6, 6), (36, 6, 37, 6), (39, 2, 9, 7), (71, 3, 23, 23)]


def _flood(img):
    ny, nx = img.shape
    seen, out = np.zeros_like(img, bool), {}
    for s in zip(*np.nonzero(img)):
        if seen[s]:
            continue
        stack, cells = [s], []
        seen[s] = True
        while stack:
            a, b = stack.pop()
            cells.append(a * nx + b)
            for c in range(max(0, a - 1), min(ny, a + 2)):
                for d in range(max(0, b - 1), min(nx, b + 2)):
                    if img[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        for c in cells:
            out[c] = min(cells)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1), st.floats(0.05, 0.9))
def test_labels_match_flood_fill(ny, nx, seed, share):
    img = np.random.default_rng(seed).random((ny, nx)) < share
    y, x = np.nonzero(img)
    lab = kernels.label(np.zeros(len(y)), y, x, ny, nx)
    assert dict(zip((y * nx + x).tolist(), lab.tolist())) == _flood(img)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 16), st.lists(st.integers(0, 65535), max_size=50))
def test_value_packing_round_trip(depth, values):
    v = np.array(values, np.int64) & ((1 << depth) - 1)
    assert (kernels.unpack_values(kernels.pack_values(v, depth), depth, len(v)) == v).all()


def test_value_too_large_fails_and_scaling_fits():
    with pytest.raises(ValueError):
        kernels.pack_values(np.array([16]), 4)
    s = kernels.scaled(np.array([10, 500, 1000]), 8)
    assert s.min() == 0 and s.max() == 255


@pytest.mark.parametrize("codec", sorted(codecs.CODEC_IDS))
@pytest.mark.parametrize("r", range(0, 10, 3))
def test_codec_round_trip(codec, r):
    for data in (bytes(i % (r + 2) for i in range(1024)), b"", b"abc"):
        assert codecs.decompress(codecs.compress(data, codec, 1, 2), codec, 2) == data


def test_reduced_header_round_trip():
    h = headers.write_reduced_header(reduction_level=1, nx=4096, ny=512, nz=700, source_file_name="a.mrc", checksum=b"\1" * 32)
    assert len(h) == 321
    d = headers.read_reduced_header(h)
    assert (d["nx"], d["ny"], d["nz"], d["source_file_name"], d["uid"]) == (4096, 512, 700, "a.mrc", headers.MAGIC)
    assert headers.write_reduced_header(**d) == h
    with pytest.raises(ValueError):
        headers.read_reduced_header(h[:300])
    with pytest.raises(ValueError):
        headers.write_reduced_header(source_file_name="x" * 101)


def test_params():
    p = RunParams.parse("# run\nBit_Depth = 10\nnx = 5 # columns\n\nreduction_level=3")
    assert (p.target_bit_depth, p.nx, p.reduction_level) == (10, 5, 3)
    assert RunParams.parse(p.text()) == p
    for bad in ("no_such = 1", "reduction_level = 7", "nx 5"):
        with pytest.raises(ValueError):
            RunParams.parse(bad)


def test_type_codes():
    assert [type_code(0, b) for b in (1, 8, 9, 16, 17, 33)] == [0, 0, 1, 1, 2, 3]
    assert type_code(1, 12) == 5 and type_code(2, 33) == 9
    with pytest.raises(ValueError):
        type_code(3, 8)


def test_gaussian_width():
    h = np.linspace(-10, 10, 100)
    assert abs(kernels.gaussian_sigma(1000 * np.exp(-(h**2) / (2 * 2.5**2)), h) - 2.5) < 1e-6

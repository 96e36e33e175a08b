import numpy as np

from lumenframe.plans.fixtures import GEOM, raw_frames
from lumenframe.plans.queries import QUERIES


def test_fft_view_is_the_spectrum_of_every_frame(spark, sf_dir):
    want = {}
    for r in raw_frames(spark, sf_dir).collect():
        s = np.log(np.abs(np.fft.fftshift(np.fft.fft2(np.frombuffer(r.pixels, "<u2").reshape(GEOM.ny, GEOM.nx).astype(float)))))
        want[r.frame_id] = np.where(np.isfinite(s), s, s[np.isfinite(s)].min()).ravel()
    got = {r.frame_id: r.spectrum for r in QUERIES["fft_view"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=1e-6)

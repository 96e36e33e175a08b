import math

from lumenframe.llm.quality import upper_bound


def test_bound_of_many_rejected_texts_sums_all_terms():
    # the normal approximation holds within the tolerance
    n = 1 << 29
    k = n // 64
    sd = math.sqrt(k * (1 - k / n))
    assert abs((upper_bound(k, n, 0.05) * n - k) / sd - 1.645) < 0.005


def test_bound_of_few():
    assert abs(upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9

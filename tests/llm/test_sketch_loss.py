"""The sketch filter loses fewer pairs at the limit than the bands do."""

import math

import numpy as np

from trustframe.llm import neardup


def test_floor_loses_less_than_bands():
    n, m, s = neardup.SKETCH_BITS, neardup.SAMPLES, neardup.PERCENT / 100
    estimate = lambda ones: 1 + math.log(max(1 - 2 * ones / n, 1e-6)) * n / (4 * m)
    rejected = [k for k in range(n + 1) if estimate(k) < neardup.FLOOR]
    k = np.arange(n + 1)
    ones, loss = (k == 0).astype(float), 0.0
    for wrong in range(m + 1):  # every differing sample flips two bits
        loss += math.comb(m, wrong) * (1 - s) ** wrong * s ** (m - wrong) * ones[rejected].sum()
        for _ in range(2):
            up, down = ones * (n - k) / n, ones * k / n
            ones = np.append(0, up[:-1]) + np.append(down[1:], 0)
    assert loss < (1 - s**neardup.ROWS) ** neardup.BANDS

"""Vectors whose inner products float64 does not hold exactly."""

import numpy as np
import pytest
from test_search import brute, search


@pytest.mark.parametrize("size", [4e5, 9e6])
def test_large_rows_among_ordinary_ones(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(80)]
    rows += [(100 + i, (rng.normal(size=6).round(3) + [size, 0, 0, 0, 0, 0]).tolist()) for i in range(9)]
    assert search(spark, rows, chunk=7) == brute(rows)


def test_a_large_candidate_beyond_64_bits(spark):
    rows = [(2, [0.01, 1.0]), (3, [1e14, 2.0]), (5, [0.5, 0.5]), (7, [-1e14, 1.0])]
    assert search(spark, rows) == brute(rows)

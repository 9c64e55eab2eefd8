"""Pooled steps against the max-min formula, however the values are sliced."""

from fractions import Fraction

import numpy as np
import pytest

from scorelake.operators import isotonic


def _means(n, bad):
    """The largest, over starts, of the smallest mean over ends."""
    cn, cb = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(bad)]
    m = len(n)
    mean = lambda a, z: Fraction(int(cb[z + 1] - cb[a]), int(cn[z + 1] - cn[a]))
    return [max(min(mean(a, z) for z in range(i, m)) for a in range(i + 1)) for i in range(m)]


@pytest.mark.parametrize("piece, parts", [(1 << 16, 1), (3, 7), (1, 4)])
def test_steps_do_not_depend_on_slices(spark, monkeypatch, piece, parts):
    monkeypatch.setattr(isotonic, "PIECE", piece)
    rng = np.random.default_rng(piece)
    m = 60
    n = rng.integers(1, 9, (4, m))
    shares = np.stack([rng.random(m), np.linspace(0, 1, m), np.linspace(1, 0, m), np.full(m, 0.5)])
    bad = rng.binomial(n, shares)
    rows = [(k, i / m, int(n[k, i]), int(bad[k, i])) for k in range(4) for i in range(m)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = isotonic.isotonic_blocks(spark.createDataFrame(rows, "part int, p double, n long, bad long").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k in range(4):
        blocks = sorted((r.low, r.high, r.n, r.bad) for r in found if r.part == k)
        means = [Fraction(b[3], b[2]) for b in blocks]
        assert means == sorted(means) and sum(b[2] for b in blocks) == n[k].sum()
        expected = _means(n[k], bad[k])
        for low, high, count, ones in blocks:
            inside = [i for i in range(m) if low <= i / m <= high]
            assert {expected[i] for i in inside} == {Fraction(ones, count)} and count == n[k, inside].sum()


def test_no_rows_no_steps(spark):
    assert isotonic.isotonic_blocks(spark.createDataFrame([], "part int, p double, n long, bad long")).count() == 0

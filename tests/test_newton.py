"""Shared-pass logistic fits against plain Newton and proximal steps."""

import numpy as np
import pytest

from scorelake.operators import newton


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)) * [1, 50, 0.02]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.6 * x[:, 0] - 0.02 * x[:, 1] - 0.7)))).astype(float)
    weight, fold = rng.integers(1, 4, 400).astype(float), rng.integers(0, 3, 400)
    data = [(a.tolist(), float(b), float(w), int(f)) for a, b, w, f in zip(x, y, weight, fold)]
    return spark.createDataFrame(data, "x array<double>, y double, weight double, fold int").repartition(5).cache(), x, y, weight, fold


def _gradient(x, y, weight, beta):
    design = np.column_stack([np.ones(len(x)), x])
    return design.T @ (weight * (1 / (1 + np.exp(-design @ beta)) - y))


def test_every_fit_meets_its_own_score_equation(rows):
    df, x, y, weight, fold = rows
    fits = [newton.Fit(l2=p, l1=q, without=k) for p, q in ((0.0, 0.0), (1.0, 0.0), (0.0, 12.0), (2.0, 4.0)) for k in (None, 0, 2)]
    betas, converged = newton.fit_many(df, fits)
    assert all(converged)
    for fit, beta in zip(fits, betas):
        kept = np.ones(len(x), bool) if fit.without is None else fold != fit.without
        slope = _gradient(x[kept], y[kept], weight[kept], beta)
        slope[1:] += fit.l2 * beta[1:]
        assert abs(slope[0]) < 1e-4
        for s, b in zip(slope[1:], beta[1:]):
            assert abs(s + fit.l1 * np.sign(b)) < 1e-4 if b else abs(s) <= fit.l1 + 1e-6
    assert any((b[1:] == 0).any() for f, b in zip(fits, betas) if f.l1)


def test_counts_are_of_the_fold_left_out(rows):
    df, x, y, _, fold = rows
    fits = [newton.Fit(l2=1.0, without=k) for k in range(3)]
    betas, _ = newton.fit_many(df, fits)
    counts = newton.scored_counts(df, fits, betas).collect()
    for k in range(3):
        held = [r for r in counts if r.fit == k and r.role == "test"]
        assert sum(r.good + r.bad for r in held) == (fold == k).sum() and sum(r.bad for r in held) == y[fold == k].sum()


def test_parted_classes_do_not_converge_without_a_penalty(spark):
    parted = spark.createDataFrame([([float(i)], float(i > 4), 1.0, -1) for i in range(10)], "x array<double>, y double, weight double, fold int")
    assert newton.fit_many(parted, [newton.Fit()])[1] == [False]
    assert newton.fit_many(parted, [newton.Fit(l2=1.0)])[1] == [True]
    with pytest.raises(ValueError, match="rows"):
        newton.fit_many(parted.limit(0), [newton.Fit()])

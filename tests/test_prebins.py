"""Tree pre-bins against a plain best-first tree, and optimal bins on top of them."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions.target import TargetSpec
from scorelake.operators import optimal
from scorelake.operators.prebins import cart_breaks

TARGET = TargetSpec("outcome", good=("good",), bad=("bad",))


def _tree(values, bad, leaves, min_size):
    order = np.argsort(values, kind="stable")
    v, y = values[order], bad[order]
    least = max(1, min_size * len(v))
    purity = lambda part: ((part == 0).sum() ** 2 + (part == 1).sum() ** 2) / len(part)

    def best(a, b):
        found = None
        for i in range(a + 1, b):
            if v[i] > v[i - 1] and min(i - a, b - i) >= least:
                gain = round(purity(y[a:i]) + purity(y[i:b]) - purity(y[a:b]), 6)
                if gain > 0 and (found is None or gain > found[0]):
                    found = (gain, i)
        return found

    waiting, cuts = [], []

    def push(a, b):
        if found := best(a, b):
            heapq.heappush(waiting, (-found[0], a, b, found[1]))

    push(0, len(v))
    while waiting and len(cuts) < leaves - 1:
        _, a, b, i = heapq.heappop(waiting)
        cuts.append((v[i - 1] + v[i]) / 2)
        push(a, i)
        push(i, b)
    return sorted(cuts)


@pytest.mark.parametrize("leaves, min_size", [(20, 0.05), (5, 0.01)])
def test_tree_prebins_equal_a_plain_best_first_tree(spark, leaves, min_size):
    rng = np.random.default_rng(leaves)
    n = 900
    columns = {"step": rng.random(n), "few": rng.integers(0, 9, n).astype(float), "noise": rng.normal(size=n), "flat": np.zeros(n)}
    bad = (rng.random(n) < np.where((columns["step"] > 0.41) & (columns["step"] < 0.47), 0.9, 0.2)).astype(int)
    rows = [(c, float(x), int(t)) for c in columns for x, t in zip(columns[c], bad)]
    counts = (
        spark.createDataFrame(rows, "variable string, value double, y int")
        .groupBy("variable", "value")
        .agg(F.count("*").alias("row_count"), F.sum(1 - F.col("y")).alias("good_count"), F.sum("y").alias("bad_count"))
    )
    cells, breaks = cart_breaks(counts, leaves=leaves, min_size=min_size)
    counted = {(r.variable, r.position): (r.row_count, r.bad_count) for r in cells.collect()}
    for c, values in columns.items():
        assert breaks[c] == pytest.approx(_tree(values, bad, leaves, min_size))
        place = np.searchsorted(breaks[c], values, side="right")
        assert all(counted[c, p] == ((place == p).sum(), bad[place == p].sum()) for p in range(len(breaks[c]) + 1))


def test_a_step_inside_one_quantile_bin_is_found(spark):
    rows = [(float(i), "bad" if 1010 <= i < 1060 and i % 5 else ("bad" if i % 11 == 0 else "good"), None if i % 50 else "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, outcome string, other string")
    params = {"min_prebin_size": 0.02, "min_bin_size": 0.02, "min_nonevents": 5, "monotonic": "none"}
    bins, _ = optimal.fit_optimal_bins(df, TARGET, ["x"], optimal.OptimalParams(**params))
    edges = {r.lower for r in bins.collect()}
    assert any(e and 1008.5 <= e <= 1011 for e in edges) and any(e and 1057 <= e <= 1060 for e in edges)
    coarse, _ = optimal.fit_optimal_bins(df, TARGET, ["x"], optimal.OptimalParams(prebinning="quantile", **params))
    assert not any(e and 1008.5 <= e <= 1011 for e in (r.lower for r in coarse.collect()))


def test_missing_nan_and_special_values_stay_outside_the_tree(spark):
    rows = [(None if i % 7 == 0 else float("nan") if i % 7 == 1 else -9.0 if i % 7 == 2 else float(i % 60), "bad" if i % 60 > 30 and i % 3 else "good") for i in range(1400)]
    df = spark.createDataFrame(rows, "x double, outcome string")
    bins, status = optimal.fit_optimal_bins(df, TARGET, ["x"], special_codes={"x": [-9.0]})
    told = {r.label: r.row_count for r in bins.collect()}
    assert told["Missing"] == 400 and told["Special"] == 200 and sum(told.values()) == 1400
    assert status.head().status == "OPTIMAL"
    with pytest.raises(ValueError, match="prebinning"):
        optimal.OptimalParams(prebinning="mdlp")

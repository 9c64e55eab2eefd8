import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.functions.state import materialise
from scorelake.operators import corr, metrics


def ranked_table(rows=900, columns=7, seed=3):
    """Ties, a value of 40 % of the rows, columns missing together and alone, an empty and a constant column."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=rows)
    table = {f"c{i}": np.round(base * rng.uniform(-1, 1) + rng.normal(size=rows), 2 - i % 3) for i in range(columns)}
    table["c0"][rng.random(rows) < 0.4] = 1.5
    for names, share in ((("c1", "c2"), 0.3), (("c3",), 0.6), (("c4",), 0.05)):
        gone = rng.random(rows) < share
        for n in names:
            table[n] = np.where(gone, np.nan, table[n])
    table["empty"], table["same"] = np.full(rows, np.nan), np.full(rows, 4.0)
    return pd.DataFrame(table)


def by_pandas(table, complete):
    if complete:
        table = table.dropna()
    out = {}
    for a, b in itertools.combinations(table.columns, 2):
        both = table[[a, b]].dropna()
        rank = both.rank()
        value = rank[a].corr(rank[b]) if len(both) > 1 and rank[a].std() > 0 and rank[b].std() > 0 else 0.0
        out[a, b] = (round(float(value), 9), len(both))
    return out


@pytest.mark.parametrize("complete", [False, True])
def test_spearman_equals_ranks_of_each_pair(spark, complete, monkeypatch):
    table = ranked_table()
    if complete:
        table = table.drop(columns="empty")
    df = spark.createDataFrame(table)
    for few in (corr.FREQUENT_VALUES, 5):  # all values broadcast, or only those of a fifth of all
        monkeypatch.setattr(corr, "FREQUENT_VALUES", few)
        monkeypatch.setattr(corr, "MATRIX_CELLS", 2000)
        got = corr.correlation_matrix(df, list(table.columns), "spearman", "complete_case" if complete else "pairwise")
        found = {(r.variable_a, r.variable_b): (round(r["corr"], 9) + 0.0, r.n) for r in got.collect()}
        assert found == by_pandas(table, complete)


def test_spearman_plan_does_not_grow_with_columns_or_patterns(spark):
    def exchanges(columns):
        df = spark.createDataFrame(ranked_table(columns=columns))
        plan = corr.correlation_matrix(df, df.columns, "spearman")._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange")

    assert exchanges(5) == exchanges(12)


def test_spearman_of_no_rows(spark):
    df = spark.createDataFrame(ranked_table().head(5)).limit(0)
    got = corr.correlation_matrix(df, ["c0", "c1", "c2"], "spearman").collect()
    assert [(r["corr"], r.n, r.warning) for r in got] == [(0.0, 0, "NO_PAIRWISE_OVERLAP")] * 3


def walked(blocks, size):
    ends = [0]
    while ends[-1] < blocks[-1]:
        ends.append(next(b for b in blocks if b >= min(ends[-1] + size, blocks[-1])))
    return ends


@pytest.mark.parametrize("cells", [2, 3, 16, 4096])
def test_group_ends_equal_a_walk(spark, monkeypatch, cells):
    monkeypatch.setattr(metrics, "END_CELLS", cells)
    rng = np.random.default_rng(cells)
    blocks = {}
    for role, ties in (("a", 1), ("b", 40), ("c", 400), ("d", 3)):
        steps = rng.integers(1, ties + 1, 300)
        if role == "d":
            steps[100] = 500
        blocks[role] = np.cumsum(steps).tolist()
    blocks["e"] = [70]
    ranked = materialise(spark.createDataFrame([(r, u) for r, us in blocks.items() for u in us], "role string, upto long"))
    sizes = {r: (us[-1], max(1, -(-us[-1] // 10))) for r, us in blocks.items()}
    assert metrics._group_ends(ranked, sizes) == {r: walked(us, sizes[r][1]) for r, us in blocks.items()}
    assert metrics._group_ends(ranked.filter(F.lit(False)), {}) == {}

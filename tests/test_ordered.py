import numpy as np
import pytest

from scorelake.functions.hashing import dense_index, hash_order, rank_cutoffs
from scorelake.functions.ordered import average_ranks, exact_quantiles, running_totals
from scorelake.functions.placing import place

PROBS = [0.0, 0.05, 0.1, 1 / 3, 0.5, 0.9, 0.99, 1.0]


def _frame(spark, n=4000):
    rng = np.random.default_rng(3)
    heavy = np.exp(rng.normal(0, 4, n))
    ties = rng.integers(0, 5, n).astype(float)
    rows = [
        ("a" if i % 3 else "b", float(heavy[i]), float(ties[i]) if i % 7 else None, 3.0) for i in range(n)
    ]
    return spark.createDataFrame(rows, "g string, heavy double, ties double, constant double")


@pytest.mark.parametrize("accuracy", [10_000, 100])  # counted in full, and through brackets
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_numpy(spark, accuracy, by):
    df = _frame(spark)
    local = df.toPandas()
    for r in exact_quantiles(df, ["heavy", "ties", "constant"], PROBS, by, accuracy).collect():
        part = local[local.g == r.g] if by else local
        values = part[r.variable].dropna()
        assert r.n == len(values)
        assert r.q == pytest.approx(np.percentile(values, r.p * 100), rel=1e-12)


def test_quantiles_do_not_depend_on_partitioning(spark):
    df = _frame(spark)
    one, many = (
        {(r.variable, r.p): r.q for r in exact_quantiles(df.repartition(k), ["heavy", "ties"], PROBS, accuracy=100).collect()}
        for k in (1, 16)
    )
    assert one == many


def test_running_totals_match_a_sorted_sum(spark):
    rows = [("x" if v % 2 else "y", v, v * 2) for v in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, s long").repartition(5)
    got = {(r.g, r.v): (r.before_s, r.total_s) for r in running_totals(df, "v", ["s"], ["g"]).collect()}
    for g, v, _ in rows:
        same = [r for r in rows if r[0] == g]
        assert got[(g, v)] == (sum(r[2] for r in same if r[1] < v), sum(r[2] for r in same))


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (5.0,)], "v double")
    assert {r.value: r["rank"] for r in average_ranks(df, ["v"]).collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_hash_cutoffs_and_index_agree_with_a_full_sort(spark):
    df = spark.range(500).selectExpr("cast(id AS string) AS key", "id % 2 AS g")
    hashed = df.withColumn("_h", hash_order(["key"], 1))
    ordered = {g: sorted(r._h for r in hashed.collect() if r.g == g) for g in (0, 1)}
    wanted = spark.createDataFrame([(0, "a", 10), (1, "a", 250), (1, "b", 1)], "g long, cut string, k long")
    for r in rank_cutoffs(hashed, ["g"], wanted).collect():
        k = {(0, "a"): 10, (1, "a"): 250, (1, "b"): 1}[(r.g, r.cut)]
        assert r.h == ordered[r.g][k - 1]
    for r in dense_index(hashed, ["g"]).collect():
        assert ordered[r.g][r._index] == r._h


def test_place_joins_when_groups_are_many(spark):
    df = spark.createDataFrame([(i % 400, float(i % 9)) for i in range(800)], "g int, v double")
    breaks = spark.createDataFrame([(g, [2.0, 5.0]) for g in range(400)], "g int, breaks array<double>")
    for left in (False, True):
        for r in place(df, "v", breaks, ["g"], left_closed=left).collect():
            assert r.bin == (sum(b <= r.v for b in (2.0, 5.0)) if left else sum(b < r.v for b in (2.0, 5.0)))

"""What a query leaves on disk does not grow with its passes, repeats or penalties; answers stay those of plain Python."""

import glob
import hashlib
import os
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import hashing, state
from scorelake.functions.packing import pack, unpack
from scorelake.functions.target import TargetSpec
from scorelake.operators import explain, model, newton, permuted
from scorelake.operators.trees import Forest
from scorelake.plans import fit_queries

TARGET = TargetSpec("target", good=("good",), bad=("bad",))
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_packed_arrays_come_back():
    arrays = [np.array([1.5, -2.0, 1e300]), np.array([1, 2**32 - 1, 0], np.uint32), np.array([2**63, 5, 0], np.uint64)]
    back = unpack(pack(arrays), 3, [a.dtype for a in arrays])
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back))


def test_a_staged_table_leaves_no_shuffle_files(spark, tmp_path):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    files = lambda: set(glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*.data", recursive=True))
    dealt = lambda: spark.range(1000).repartition(3, "id")
    before = files()
    dealt().write.parquet(str(tmp_path / "plain"))
    if not files() - before:
        pytest.skip("shuffle files are not where they are looked for")
    before = files()
    state.stage(dealt())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_releasing_ends_with_its_block(spark):
    before = spark.conf.get(RELEASE)
    with pytest.raises(ValueError), state.shuffles_released(spark):
        assert spark.conf.get(RELEASE) == "true"
        raise ValueError("a query fails")
    assert spark.conf.get(RELEASE) == before


def test_lean_places_are_the_dense_ones(spark):
    rows = spark.range(3000).selectExpr("id", "id % 3 = 0 AS c", "IF(id % 7 = 0, NULL, cast(id % 4 AS string)) AS g")
    for by in ([], ["c"], ["g"]):
        hashed = rows.withColumn("_h", hashing.hash_order(["id"], 5))
        told = [{r.id: r._index for r in f(hashed, by).select("id", "_index").collect()} for f in (hashing.dense_index, hashing.lean_index)]
        assert told[0] == told[1] and len(told[0]) == 3000


def _scored(spark, n=3000):
    """Rows of which a third are alike, and their figures."""
    draw = random.Random(3)
    rows = [([float(draw.randrange(4)), 0.0] if i % 3 == 0 else [draw.gauss(0, 1), draw.random()], float(draw.random() < 0.3), 1.0, i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "x array<double>, y double, weight double, fold int").repartition(3)


@pytest.mark.parametrize(("slice_rows", "flush_rows"), [(10**6, 10**6), (150, 100), (10, 10**6)])
def test_slices_win_as_all_pairs_do(spark, slice_rows, flush_rows):
    rows, df = _scored(spark)
    fits = [newton.Fit(without=k) for k in (0, 1, 2)] * 2
    betas = [np.array([-1.0, 0.5, b]) for b in (0.25, 0.25, 0.25, 0.0, 0.0, 0.0)]
    counts = newton.scored_counts(df, fits, betas, ["test"], slice_rows=slice_rows, flush_rows=flush_rows)
    told = newton.slices_won(counts)
    assert counts.groupBy("fit", "role", "value").count().filter("count > 1").isEmpty()
    for k, (fit, beta) in enumerate(zip(fits, betas)):
        own = [(-1.0 + beta[1] * x[0] + beta[2] * x[1], y) for x, y, _, fold in rows if fold == fit.without]
        bad, good = (np.array([z for z, y in own if y == c]) for c in (1.0, 0.0))
        wins = 2 * (bad[:, None] > good[None, :]).sum() + (bad[:, None] == good[None, :]).sum()
        assert told[k, "test"] == (wins, len(good), len(bad))


def test_a_fit_without_left_out_rows_has_no_wins(spark):
    _, df = _scored(spark, 30)
    counts = newton.scored_counts(df, [newton.Fit(without=0), newton.Fit(without=9)], [np.zeros(3)] * 2)
    told = newton.slices_won(counts)
    assert set(told) == {(0, "test"), (0, "train"), (1, "train")} and told[1, "train"][0] == told[1, "train"][1] * told[1, "train"][2]


def test_a_search_stages_its_rows_only(spark, monkeypatch):
    rows = [(i, float(i % 17), float(i % 5), "bad" if (i * 7) % 17 + i % 5 > 11 else "good") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, target string")
    staged, totals = [], []
    monkeypatch.setattr(model, "stage", lambda d: staged.append(d.columns) or state.stage(d))
    monkeypatch.setattr(model, "running_totals", lambda *a, **_: totals.append(a))
    told = model.tune(df, TARGET, ["a", "b"], ["id"], "logistic", {"c": [0.01, 1.0]}, folds=3).collect()
    assert staged == [["x", "y", "weight", "fold"]] and totals == []
    folds = {}
    for label in ("good", "bad"):
        order = sorted((hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]) for r in rows if r[3] == label)
        folds |= {i: place % 3 for place, (_, i) in enumerate(order)}
    data = spark.createDataFrame([([a, b], float(t == "bad"), 1.0, folds[i]) for i, a, b, t in rows], "x array<double>, y double, weight double, fold int")
    for r in told:
        betas, _ = newton.fit_many(data, [newton.Fit(l2=1.0 / float(r.params[2:]), without=k) for k in range(3)])
        areas = []
        for k, beta in enumerate(betas):
            z = [(beta[0] + beta[1] * a + beta[2] * b, t) for i, a, b, t in rows if folds[i] == k]
            bad, good = (np.array([v for v, t in z if t == c]) for c in ("bad", "good"))
            areas.append(((bad[:, None] > good[None, :]).sum() + 0.5 * np.isclose(bad[:, None], good[None, :], atol=1e-12, rtol=0).sum()) / (len(bad) * len(good)))
        assert r.mean_auc == pytest.approx(np.mean(areas), abs=1e-5) and r.std_auc == pytest.approx(np.std(areas), abs=1e-5)


# Bad where a > 0.5 and b > 2, or where a <= 0.5 and b > 4: (left, right, feature, threshold, value) of a tree on (a, b).
_TREE = (np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), np.array([0, 1, 1, -1, -1, -1, -1]), np.array([0.5, 4.0, 2.0, 0.0, 0.0, 0.0, 0.0]), np.array([0.0, 0.0, 0.0, 0.1, 0.9, 0.2, 0.8]))


def _is_bad(a, b):
    return b > 2 if a > 0.5 else b > 4


def _keyed(n=900):
    draw = random.Random(5)
    return [(i, i % 4, draw.choice([0.0, 0.5, 0.7, 1.0]), float(draw.randrange(7)), float(draw.random() < 0.4)) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, k, y, [a, b]) for i, k, a, b, y in rows], "id int, k int, label double, x array<double>").repartition(3)


@pytest.mark.parametrize(("slice_rows", "flush_rows", "word"), [(10**6, 10**6, 1 << 62), (64, 50, 1 << 62), (64, 10**6, 4), (1, 200, 1 << 62)])
def test_permuted_hits_equal_ranks_paired_in_python(spark, monkeypatch, slice_rows, flush_rows, word):
    monkeypatch.setattr(permuted, "WORD", word)
    rows = _keyed(900 if slice_rows > 1 else 60)
    assert permuted.cells_of(Forest((_TREE,), False), 2).words == (1 if word > 4 else 2)
    told = permuted.permuted_hits(_frame(spark, rows), Forest((_TREE,), False), 2, ["id", "k"], 42, [43, 44], slice_rows, flush_rows)
    order = lambda seed: sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}|{r[1]}|{seed}".encode()).hexdigest())
    for seed, found in zip((43, 44), told):
        pairs = list(zip(order(42), order(seed)))
        hits = [sum(_is_bad(q[2], p[3]) == p[4] for p, q in pairs), sum(_is_bad(p[2], q[3]) == p[4] for p, q in pairs)]
        assert found == [(len(rows), h) for h in hits]


def test_keys_that_repeat_are_still_a_permutation(spark):
    rows = [(0 if i % 2 else None, k, 1.0, b, y) for i, k, _, b, y in _keyed(400)]
    ((by_a, by_b),) = permuted.permuted_hits(_frame(spark, rows), Forest((_TREE,), False), 2, ["id"], 42, [43], 30, 70)
    assert by_a == (400, sum(_is_bad(1.0, r[3]) == r[4] for r in rows)) and by_b[0] == 400
    # Of one key every order is a permutation: as many rows as before take a bad value.
    bad, taken = sum(r[4] for r in rows), sum(_is_bad(1.0, r[3]) for r in rows)
    assert abs(bad + taken - 400) <= by_b[1] <= 400 - abs(bad - taken)


def test_permutations_join_and_stage_no_rows(spark, monkeypatch):
    rows = _keyed()
    df = spark.createDataFrame([(i, a, b, "bad" if _is_bad(a, b) else "good") for i, _, a, b, _ in rows], "id int, a double, b double, target string")
    fitted = model.fit_tree(df, TARGET, ["a", "b"], "decision_tree", max_depth=3)
    staged = []
    monkeypatch.setattr(explain, "stage", lambda d: pytest.fail("rows are staged with all their values"))
    monkeypatch.setattr(explain, "dense_index", lambda *_: pytest.fail("rows are joined by their places"))
    monkeypatch.setattr(permuted, "stage", lambda d: staged.append(d.dtypes) or state.stage(d))
    told = {r.feature: r.importance_mean for r in explain.permutation_importance(df, fitted, TARGET, ["a", "b"], ["id"], repeats=2).collect()}
    assert staged == [[("_key0", "int"), ("_word0", "bigint")]] and told["b"] > told["a"] > 0.05


def test_no_rows_have_no_importances(spark):
    assert permuted.permuted_hits(_frame(spark, _keyed(5)).filter("id < 0"), Forest((_TREE,), False), 2, ["id"], 42, [43]) == [[]]


def test_large_tables_are_joined_with_the_columns_in_use(spark, tmp_path, monkeypatch):
    lines = spark.range(4000).selectExpr(
        "id div 4 AS l_orderkey", "id % 50 AS l_partkey", "id % 9 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber",
        "cast(id % 40 AS double) AS l_quantity", "cast(id % 97 AS double) AS l_extendedprice", "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax",
        "'N' AS l_returnflag", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus", "timestamp'2020-01-01' AS l_shipdate",
    )
    orders = spark.range(900).selectExpr("id AS o_orderkey", "id % 70 AS o_custkey", "'1-URGENT' AS o_orderpriority")
    customers = spark.range(60).selectExpr("id AS c_custkey", "IF(id % 3 = 0, 'BUILDING', 'FURNITURE') AS c_mktsegment", "IF(id % 5 = 0, NULL, id * 1.5D) AS c_acctbal")
    for name, df in (("lineitem", lines), ("orders", orders), ("customer", customers)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    wide, narrow = fit_queries._tree_sample(spark, str(tmp_path)), fit_queries._narrow_sample(spark, str(tmp_path))
    assert sorted(map(tuple, wide.select(narrow.columns).collect())) == sorted(map(tuple, narrow.collect()))
    monkeypatch.setattr(fit_queries, "NARROW_ROWS", 3999)
    monkeypatch.setattr(fit_queries, "_tree_sample", lambda *_: pytest.fail("all columns are joined"))
    assert fit_queries.permutation_importance(spark, str(tmp_path)).count() == 6

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions.target import TargetSpec
from scorelake.operators import binning, cluster, compare, corr, diagnostics, model, optimal, scaling, scoring, select, woe
from scorelake.sources.sqlgen import scoring_sql

TARGET = TargetSpec("target", ("good",), ("bad",))
BIN = "variable string, kind string, bin_id string, bin_order int, label string, lower double, upper double, lower_inclusive boolean, upper_inclusive boolean, categories array<string>, is_missing boolean, is_special boolean, is_other boolean, row_count long, good_count long, bad_count long"


def _bin(variable, i, lower=None, upper=None, categories=None, kind="numeric", **flags):
    return (
        variable, kind, f"{variable}_{i}", i, str(i), lower, upper, False, upper is not None, categories,
        flags.get("missing", False), flags.get("special", False), flags.get("other", False), 1, 1, 1,
    )


def _small(spark):
    df = spark.createDataFrame([(20, "north"), (40, "east"), (25, "south"), (50, "west")], "age int, region string")
    bins = spark.createDataFrame(
        [
            _bin("age", 1, None, 30.0), _bin("age", 2, 30.0, None),
            _bin("region", 1, categories=["north", "east"], kind="categorical"),
            _bin("region", 2, categories=["south", "west"], kind="categorical"),
        ],
        BIN,
    )
    table = spark.createDataFrame(
        [("age", "age_1", 0.5), ("age", "age_2", -0.3), ("region", "region_1", 0.2), ("region", "region_2", -0.1)],
        "variable string, bin_id string, woe double",
    )
    return df, bins, table


def test_woe_columns_and_policies(spark):
    df, bins, table = _small(spark)
    rows = woe.add_woe_columns(df, bins, table).collect()
    assert [(r.age_woe, r.region_woe) for r in rows] == [(0.5, 0.2), (-0.3, 0.2), (0.5, -0.1), (-0.3, -0.1)]
    partial = table.filter("bin_id <> 'age_2'")
    with pytest.raises(ValueError):
        woe.add_woe_columns(df, bins, partial)
    assert [r.age_woe for r in woe.add_woe_columns(df, bins, partial, policy="zero").collect()] == [0.5, 0.0, 0.5, 0.0]
    assert [r.age_woe for r in woe.add_woe_columns(df, bins, partial, policy="skip_bin").collect()] == [0.5, None, 0.5, None]
    strange = spark.createDataFrame([(None, "north", "oot")], "age int, region string, role string")
    with pytest.raises(ValueError):
        woe.apply_woe(strange, bins, table)
    assert woe.apply_woe(strange, bins, table, on_unmatched="fill_zero").first().age_woe == 0.0


def test_bins_cover_every_row(spark):
    rng = np.random.default_rng(0)
    rows = [
        (float(rng.normal()) if i % 11 else None, float(i % 3), 7.0, f"l{int(rng.integers(0, 9))}'\\" if i % 13 else None, "bad" if i % 4 == 0 else "good")
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "x double, few double, flat double, level string, target string")
    bins = binning.fit_bins(df, TARGET, binning.BinningParams(max_bins=8, max_categorical_levels=4))
    sums = {r.variable: r for r in bins.groupBy("variable").agg(F.sum("row_count").alias("n"), F.count("*").alias("k")).collect()}
    assert {v: r.n for v, r in sums.items()} == {c: 1500 for c in ("x", "few", "flat", "level")}
    assert sums["x"].k == 8 and sums["flat"].k == 1 and sums["level"].k == 6
    again = binning.bin_counts(df, bins, TARGET).filter(F.col("variable") != binning.ALL_ROWS)
    stored = {(r.variable, r.bin_id): r.row_count for r in bins.collect()}
    assert {(r.variable, r.bin_id): r.row_count for r in again.collect()} == stored
    cells = woe.woe_cells(df, bins, TARGET)
    assert all(r.iv >= 0 for r in woe.iv_table(cells).collect())
    ignoring = binning.fit_bins(df, TARGET, binning.BinningParams(max_bins=8, missing_policy="ignore"), ["x"])
    assert ignoring.filter("is_missing").count() == 0 and ignoring.count() == 8


def test_binning_needs_both_classes(spark):
    with pytest.raises(ValueError):
        binning.fit_bins(spark.createDataFrame([(1.0, "good")], "x double, target string"), TARGET)
    with pytest.raises(ValueError):
        binning.BinningParams(max_bins=1)


def test_zero_cells(spark):
    df = spark.createDataFrame([("a", "good")] * 4 + [("b", "good"), ("b", "bad"), ("b", "bad")], "v string, target string")
    bins = binning.fit_bins(df, TARGET)
    initial = {r.label: r for r in woe.woe_cells(df, bins, TARGET).collect()}
    assert initial["a"].woe == 0.0 and initial["a"].zero_cell
    for params in (woe.WoeParams(purpose="final"), woe.WoeParams(purpose="final", alpha=0.5)):
        with pytest.raises(ValueError):
            woe.woe_cells(df, bins, TARGET, params)
    smooth = {r.label: r for r in woe.woe_cells(df, bins, TARGET, woe.WoeParams(0.5, "few rows", "final")).collect()}
    assert smooth["a"].woe == pytest.approx(math.log((4.5 / 6) / (0.5 / 3)))
    assert smooth["b"].woe == pytest.approx(math.log((1 / 5) / (2 / 2)))


def test_overrides(spark):
    bins = spark.createDataFrame([_bin("age", 1, None, 10.0), _bin("age", 2, 10.0, 20.0), _bin("age", 3, 20.0, None), _bin("x", 1)], BIN)
    merge = binning.BinOverride("age", "merge_bins", "thin", ("age_1", "age_2"), "young", "Young")
    out = {r.bin_id: r for r in binning.apply_overrides(bins, [merge, binning.BinOverride("x", "reject_variable", "weak")]).collect()}
    assert set(out) == {"young", "age_3"}
    assert (out["young"].lower, out["young"].upper, out["young"].row_count, out["young"].bin_order) == (None, 20.0, 2, 1)
    for wrong in (
        binning.BinOverride("age", "merge_bins", "", ("age_1", "age_2")),
        binning.BinOverride("age", "merge_bins", "r", ("age_1", "age_3")),
        binning.BinOverride("age", "merge_bins", "r", ("age_2", "age_1")),
        binning.BinOverride("age", "group_categories", "r", ("age_1", "age_2")),
        binning.BinOverride("nope", "reject_variable", "r"),
    ):
        with pytest.raises(ValueError):
            binning.apply_overrides(bins, [wrong])


def test_scaling_known_numbers(spark):
    s = scaling.Scaling(600, "50:1", 20)
    assert s.factor == pytest.approx(28.8539008) and s.offset == pytest.approx(487.1228762)
    base = spark.createDataFrame([("age", "b1", "l", 0.5), ("age", "b2", "l", -0.3), ("income", "b1", "l", 0.2)], "variable string, bin_id string, label string, woe double")
    coefficients = scaling.coefficients_table(base, -0.5, {"age_woe": 1.2, "income_woe": -0.8})
    points = {(r.variable, r.bin_id): r.points for r in scaling.scorecard(base, coefficients, s).collect()}
    assert points[("age", "b1")] == pytest.approx(round(-s.factor * 1.2 * 0.5, 2))
    assert points[("income", "b1")] == pytest.approx(round(s.factor * 0.8 * 0.2, 2))
    assert scaling.scaling_constants(coefficients, s).first().base_points == pytest.approx(round(s.offset + s.factor * 0.5, 2))
    assert [scaling.parse_odds(o) for o in ("50:1", "50", 50.0)] == [50.0] * 3
    for wrong in ("abc", None, "1:0", ""):
        with pytest.raises(ValueError):
            scaling.parse_odds(wrong)


@pytest.mark.parametrize("policy", ["error", "zero"])
def test_three_scoring_routes_agree(spark, policy):
    df, bins, table = _small(spark)
    if policy == "zero":
        df = df.union(spark.createDataFrame([(None, "moon")], "age int, region string"))
    df = df.withColumn("id", F.monotonically_increasing_id())
    coefficients = scaling.coefficients_table(df, -1.2, {"age_woe": -0.9, "region_woe": -1.1})
    s = scaling.Scaling()
    frame = woe.add_woe_columns(df, bins, table)
    if policy == "zero":
        frame = frame.fillna(0.0, ["age_woe", "region_woe"])
    direct = {r.id: r.score for r in scoring.apply_logistic(frame, coefficients, s).collect()}
    text = scoring_sql(bins, table, coefficients, "{t}", ["id"], s, policy)
    by_sql = {r.id: r.score for r in spark.sql(text, t=df).collect()}
    assert by_sql.keys() == direct.keys() and all(abs(by_sql[k] - direct[k]) < 1e-9 for k in direct)
    if policy == "error":
        card = scaling.scorecard(table.withColumn("label", F.lit("")), coefficients, s)
        base = scaling.scaling_constants(coefficients, s).first().base_points
        points = {r.id: r.total_points for r in scoring.add_points(df, bins, card, base).collect()}
        assert all(abs(points[k] - direct[k]) < 0.02 for k in direct)
        plan = scoring.apply_logistic(frame, coefficients, s)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Exchange" not in plan
    else:
        strict = spark.sql(scoring_sql(bins, table, coefficients, "{t}", ["id"], s, "error"), t=df)
        assert strict.filter("score IS NULL").count() == 1


def test_logistic_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [0.8, -0.5] - 1)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), "bad" if t else "good") for (a, b), t in zip(x, y)], "a_woe double, b_woe double, target string")
    got = {r.feature: r.coefficient for r in model.fit_logistic(df, TARGET).collect()}
    design = np.column_stack([np.ones(600), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + np.array([0, 1, 1]) * w
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([0, 1, 1]), gradient)
    assert [got["(Intercept)"], got["a_woe"], got["b_woe"]] == pytest.approx(list(w), abs=1e-5)
    with pytest.raises(ValueError):
        model.fit_logistic(df.withColumn("target", F.lit("unknown")), TARGET)


def _brute_force(good, bad, total, rows, p):
    best = (-1.0, None)
    m = len(good)
    for k in range(1, p.max_bins + 1):
        for cuts in itertools.combinations(range(1, m), k - 1):
            ends = [*cuts, m]
            g = [good[a:b].sum() for a, b in zip([0, *cuts], ends)]
            b_ = [bad[a:b].sum() for a, b in zip([0, *cuts], ends)]
            if any(x < max(p.min_nonevents, 1) or y < max(p.min_events, 1) or x + y < p.min_bin_size * rows for x, y in zip(g, b_)):
                continue
            rates = [y / (x + y) for x, y in zip(g, b_)]
            steps = list(zip(rates, rates[1:]))
            up, down = all(a <= c for a, c in steps), all(a >= c for a, c in steps)
            if not {"auto": up or down, "ascending": up, "descending": down, "none": True}[p.monotonic]:
                continue
            iv = sum((x / total[0] - y / total[1]) * math.log((x / total[0]) / (y / total[1])) for x, y in zip(g, b_))
            best = max(best, (iv, ends), key=lambda t: t[0])
    return best


@pytest.mark.parametrize("monotonic", ["auto", "ascending", "descending", "none"])
def test_optimal_merge_equals_brute_force(monotonic):
    rng = np.random.default_rng(2)
    for _ in range(25):
        good, bad = rng.integers(0, 60, 8).astype(float), rng.integers(0, 25, 8).astype(float)
        p = optimal.OptimalParams(max_bins=4, min_events=5, min_nonevents=5, monotonic=monotonic)
        total, rows = (good.sum(), bad.sum()), (good + bad).sum()
        iv, ends = _brute_force(good, bad, total, rows, p)
        mine = optimal.best_merge(good, bad, total, rows, p)
        if ends is None:
            assert mine is None
            continue
        edges = [0, *mine]
        got = sum(
            (good[a:b].sum() / total[0] - bad[a:b].sum() / total[1])
            * math.log((good[a:b].sum() / total[0]) / (bad[a:b].sum() / total[1]))
            for a, b in zip(edges, mine)
        )
        assert got == pytest.approx(iv)


def test_optimal_bins_of_a_frame(spark):
    rows = [(float(i % 100), 5.0 if i % 2 else 6.0, "bad" if (i % 100 > 60) ^ (i % 7 == 0) else "good") for i in range(3000)]
    rows += [(-1.0, 5.0, "bad")] * 50
    df = spark.createDataFrame(rows, "x double, flat double, target string")
    bins, status = optimal.fit_optimal_bins(df, TARGET, ["x", "flat"], special_codes={"x": [-1.0]})
    assert {r.variable: r.status for r in status.collect()}["x"] == "OPTIMAL"
    mine = bins.filter("variable = 'x'")
    assert mine.filter("is_special").first().row_count == 50
    assert mine.agg(F.sum("row_count")).first()[0] == 3050
    recount = binning.bin_counts(df, mine, TARGET).filter("variable = 'x'")
    assert {r.bin_id: r.row_count for r in recount.collect()} == {r.bin_id: r.row_count for r in mine.collect()}


def test_correlation_routes_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)).round(1)
    x[:, 5] = x[:, 0] + 0.01 * x[:, 1]
    rows = [tuple(float(v) if (i + j) % 9 or j != 2 else None for j, v in enumerate(r)) for i, r in enumerate(x)]
    names = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    local = df.toPandas()
    for method in ("pearson", "spearman"):
        for r in corr.correlation_matrix(df, names, method).collect():
            assert r["corr"] == pytest.approx(local[[r.variable_a, r.variable_b]].dropna().corr(method).iloc[0, 1], abs=1e-9)
        complete = local.dropna().corr(method)
        for r in corr.correlation_matrix(df, names[:4], method, "complete_case").collect():
            expected = local[names[:4]].dropna().corr(method)
            assert r["corr"] == pytest.approx(expected.loc[r.variable_a, r.variable_b], abs=1e-9)
    table = corr.correlation_matrix(df, names, absolute=True)
    stats = spark.createDataFrame([("a", 0.1, 0.0), ("f", 0.3, 0.0)], "variable string, iv double, missing_rate double")
    for out in (cluster.threshold_clusters(table, names, stats, 0.9), cluster.hierarchical_clusters(table, names, stats, 0.2)):
        rows = {r.variable: r for r in out.collect()}
        assert rows["a"].cluster_id == rows["f"].cluster_id is not None and rows["f"].is_representative
        assert all(rows[v].cluster_id is None for v in "bcde")


def test_vif_matches_the_inverse(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    x[:, 2] += 2 * x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    expected = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    got = {r.feature: r.vif for r in diagnostics.vif(df, ["a", "b", "c"]).collect()}
    assert [got[c] for c in "abc"] == pytest.approx(list(expected), abs=1e-5)
    flat = diagnostics.vif(df.withColumn("b", F.lit(1.0)), ["a", "b"]).collect()
    assert all(r.vif is None and r.status == "warning" for r in flat)


def test_coefficient_checks(spark):
    table = spark.createDataFrame([("a_woe", 0.4), ("b_woe", 0.0), ("c_woe", -11.0), ("d_woe", float("inf"))], "feature string, coefficient double")
    assert [r.status for r in diagnostics.coefficient_signs(table).orderBy("feature").collect()] == ["warning", "neutral", "pass", "warning"]
    assert [r.status for r in diagnostics.separation(table).orderBy("feature").collect()] == ["pass", "pass", "warning", "fail"]


def test_selection_by_cluster_rules(spark):
    iv = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.3), ("d", 0.2), ("e", 0.01)], "variable string, iv double")
    clusters = spark.createDataFrame([("cluster_001", "a", 0.2), ("cluster_001", "b", 0.0), (None, "c", 0.0)], "cluster_id string, variable string, missing_rate double")
    pick = lambda **k: {r.variable: r.decision for r in select.select_variables(iv, select.SelectionParams(**k), clusters).collect()}
    assert pick(cluster_rule="highest_iv") == {"a": "selected", "b": "rejected", "c": "selected", "d": "selected", "e": "rejected"}
    assert pick(cluster_rule="lowest_missing")["b"] == "selected" and pick(cluster_rule="lowest_missing")["a"] == "rejected"
    over = pick(cluster_rule="manual_override", overrides={"cluster_001": ("b", "policy")})
    assert over["b"] == "selected" and over["a"] == "rejected"
    assert pick(cluster_rule="manual_override")["a"] == "selected"
    assert pick(max_variables=2) == {"a": "selected", "b": "selected", "c": "rejected", "d": "rejected", "e": "rejected"}
    assert pick(includes={"e": "policy"}, excludes={"a": "law"})["e"] == "selected"
    with pytest.raises(ValueError):
        select.SelectionParams(includes={"a": ""})


def test_filters_drop_the_weaker_of_a_correlated_pair(spark):
    df = spark.range(200).selectExpr("cast(id AS double) AS a", "cast(id AS double) * 2 AS b", "cast(id % 7 AS double) AS c", "1.0D AS d", "CASE WHEN id > 150 THEN 1.0D END AS e")
    iv = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.2), ("d", 1.0), ("e", 1.0)], "variable string, iv double")
    got = {r.variable: r.method for r in select.select_by_filters(df, list("abcde"), iv).collect()}
    assert got == {"a": "correlation", "b": "filter", "c": "filter", "d": "variance", "e": "missingness"}


def test_bundle_and_comparison(spark):
    _, _, table = _small(spark)
    coefficients = scaling.coefficients_table(table, -1.0, {"age_woe": -1.0, "region_woe": -1.0})
    assert scaling.bundle_violations(coefficients, table, -1.0, "t", "t", "t").count() == 0
    wrong = scaling.bundle_violations(coefficients, table.filter("variable = 'age'"), -2.0, "t", "u", "v")
    assert wrong.count() == 4
    b = spark.createDataFrame([("a", 0.1, 3)], "variable string, iv double, bin_count long")
    c = spark.createDataFrame([("b", 0.2, 4)], "variable string, iv double, bin_count long")
    rows = {r.variable: r for r in compare.compare_iv(b, c).collect()}
    assert rows["a"].iv_delta == -0.1 and rows["b"].bin_count_delta == 4 and not rows["a"].in_challenger

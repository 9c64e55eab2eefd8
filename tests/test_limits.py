"""Answers must not depend on how many rows, columns or groups there are, nor on their order."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions.placing import place
from scorelake.functions.target import TargetSpec
from scorelake.operators import binning, calibrate, cluster, compare, corr, fairness, prep, profile, resample, split
from scorelake.plans import model_queries
from scorelake.sources import readers
from scorelake.sources.sqlgen import scoring_sql

TARGET = TargetSpec("outcome", good=("good",), bad=("bad",))


def test_types_come_from_all_rows(spark, tmp_path):
    lines = ["a,b"] + [f"{i},{i}" for i in range(10_000)] + ["word,1.5"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "string", "b": "double"} and df.filter("a = 'word' AND b = 1.5").count() == 1


@pytest.mark.parametrize("columns", [2, 5])
def test_nan_is_missing_for_every_number_of_columns(spark, columns):
    df = spark.range(200).select(
        F.when(F.col("id") % 10 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("x0"),
        *[(F.col("id") * (i + 1) + F.col("id") % 7).cast("double").alias(f"x{i}") for i in range(1, columns)],
    )
    row = corr.correlation_matrix(df, df.columns).filter("variable_a = 'x0' AND variable_b = 'x1'").first()
    assert row.n == 180 and row["corr"] > 0.99


def test_many_groups_keep_the_callers_columns(spark):
    df = spark.range(800).select((F.col("id") % 40).cast("string").alias("g"), F.col("id").cast("double").alias("v"), F.lit("mine").alias("x"))
    breaks = spark.range(40).select(F.col("id").cast("string").alias("g"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i * 40.0).alias("breaks"))
    out = place(df, "v", breaks, by=["g"])
    assert out.columns == ["g", "v", "x", "bin"] and out.filter("x = 'mine'").count() == 800
    assert out.filter("v = 90").first().bin == 2


def test_more_than_fifty_candidates_and_twenty_cutoffs(spark):
    names = [f"c{i:03d}" for i in range(60)]
    iv = spark.createDataFrame([(c, float(i)) for i, c in enumerate(names)], "variable string, iv double")
    assert len(cluster.candidates(iv, names)) == 60 and cluster.candidates(iv, names, 2) == ["c059", "c058"]
    pairs = spark.createDataFrame([(a, b, 0.9 if i == 0 else 0.0) for i, (a, b) in enumerate(zip(names, names[1:]))], "variable_a string, variable_b string, corr double")
    stats = iv.withColumn("missing_rate", F.lit(0.0))
    assert cluster.hierarchical_clusters(pairs, names, stats).count() == 60
    bands = spark.createDataFrame([("train", float(i), 0.1, 0.1, 0.1, i) for i in range(40)], "role string, upper double, approval_rate double, bad_rate double, capture_rate double, count long")
    assert compare.compare_cutoffs(bands, bands).count() == 40


def test_few_rows_are_reported_by_both_calibrators(spark):
    df = spark.createDataFrame([("good", 0.2), ("bad", 0.7)] * 5, "outcome string, predicted_bad_probability double")
    for fit in (calibrate.fit_platt, calibrate.fit_isotonic):
        fitted = fit(df, TARGET)
        assert fitted.status == "too_few_rows"
        assert fitted.transform(df).filter("predicted_bad_probability = 0.7").count() == 5
        assert fit(df, TARGET, min_rows=5).status == "fitted"


def test_fractional_limits_widen_whole_numbers(spark):
    df = spark.createDataFrame([(44,), (45,), (46,), (None,)], "v int")
    capped = prep.treat(df, [prep.Treatment("v", "cap", 45.7, "r"), prep.Treatment("v", "floor", 44.9, "r")])
    assert [r.v for r in capped.collect()] == [44.9, 45.0, 45.7, None]
    with pytest.raises(ValueError):
        prep.treat(df.select(F.col("v").cast("string")), [prep.Treatment("v", "cap", 1.0, "r")])


def test_repeated_keys_are_refused_and_nulls_are_keys(spark):
    df = spark.range(1000).select((F.col("id") % 5).cast("string").alias("k"), F.when(F.col("id") % 10 == 0, "bad").otherwise("good").alias("outcome"))
    with pytest.raises(ValueError, match="repeat"):
        resample.resample(df, TARGET, ["k"], "undersample_majority")
    with pytest.raises(ValueError, match="repeat"):
        split.stratified_split(df, "outcome", ["k"])
    pair = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    from scorelake.functions.hashing import hash_order

    assert pair.select(hash_order(["x", "y"], 1).alias("h")).distinct().count() == 2


def test_edits_apply_one_after_another(spark):
    bins, _, _ = model_queries._special_model(spark)
    three = bins.filter("bin_id IN ('q_low', 'q_high')").unionByName(
        bins.filter("bin_id = 'q_high'").withColumns({"bin_id": F.lit("q_top"), "bin_order": F.lit(9), "lower": F.lit(40.0)})
    )
    edit = lambda sources, new: binning.BinOverride("quantity", "merge_bins", "why", sources, new)
    with pytest.raises(ValueError, match="unknown bins"):
        binning.apply_overrides(three, [edit(("q_low", "q_high"), "ab"), edit(("q_high", "q_top"), "bc")])
    rows = binning.apply_overrides(three, [edit(("q_low", "q_high"), "ab"), edit(("ab", "q_top"), "abc")]).collect()
    assert [(r.bin_id, r.row_count) for r in rows] == [("abc", 3)]
    moved = binning.apply_overrides(bins.filter("variable = 'quantity'"), [binning.BinOverride("quantity", "reorder_missing_bin", "why")])
    assert moved.orderBy(F.desc("bin_order")).first().bin_id == "q_missing"


def test_account_codes_are_not_numbers_and_absent_columns_are_reported(spark):
    df = spark.createDataFrame([("12d", "$1,5"), ("7F", "2e3"), ("3", "-.5")], "code string, amount string")
    codes = {r.column if "column" in r else r[0]: r.code for r in profile.string_numeric(df).collect()}
    assert codes["code"] == "OK" and codes["amount"] == "STRING_CODED_NUMERIC"
    rows = fairness.proxy_risk(df, ["gone"], ["amount"]).collect()
    assert [(r.sensitive_column, r.feature, r.risk_level) for r in rows] == [("gone", None, "unknown")]


def test_scorer_names_what_is_missing(spark):
    bins, values, coefficients = model_queries._special_model(spark)
    with pytest.raises(ValueError, match="q_low"):
        scoring_sql(bins, values.filter("bin_id <> 'q_low'"), coefficients, "t", ["id"])
    with pytest.raises(ValueError, match="no bins"):
        scoring_sql(bins.filter("variable <> 'discount'"), values, coefficients, "t", ["id"])
    odd = lambda df: df.withColumn("variable", F.when(F.col("variable") == "quantity", "odd name").otherwise(F.col("variable")))
    renamed = coefficients.withColumn("feature", F.when(F.col("feature") == "quantity_woe", "odd name_woe").otherwise(F.col("feature")))
    table = spark.createDataFrame([("a", 25.0, 0.01), ("b", 21.0, 0.01)], "id string, `odd name` double, discount double")
    text = scoring_sql(odd(bins), odd(values), renamed, "{t}", ["id"], dialect="spark")
    got = {r.id: round(r.raw_model_output, 6) for r in spark.sql(text, t=table).collect()}
    assert got == {"a": round(-1 - 0.8 * 0.9 - 1.2 * 0.5, 6), "b": round(-1 + 0.8 * 0.3 - 1.2 * 0.5, 6)}
    assert '"odd name"' in scoring_sql(odd(bins), odd(values), renamed, "t", ["id"])

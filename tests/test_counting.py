"""Interval counts of many columns against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scorelake.functions.target import TargetSpec
from scorelake.operators import binning, counting, diagnostics

TARGET = TargetSpec("outcome", good=("good",), bad=("bad",), indeterminate=("unknown",))


@pytest.mark.parametrize("size", [2, 256])
def test_counts_equal_numpy_whatever_the_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(counting, "chunks", lambda columns, _=None, real=counting.chunks: real(columns, size))
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        values = [None if rng.random() < 0.1 else float(rng.integers(0, 9)) for _ in range(4)] + [float("nan") if i % 50 == 0 else 1.0]
        rows.append((*values, ["good", "bad", "unknown"][i % 3]))
    names = ["a", "b", "c d", "e.f", "n"]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names) + ", outcome string").repartition(3)
    breaks = {"a": [0.0, 3.0, 8.0], "b": [], "c d": [2.5], "e.f": [9.0], "n": [0.5, 1.0]}
    got = counting.interval_counts(df, names, breaks, TARGET)
    for j, c in enumerate(names):
        expected = {}
        for r in rows:
            place = -1 if r[j] is None else len(breaks[c]) if math.isnan(r[j]) else int(np.searchsorted(breaks[c], r[j], side="left"))
            cell = expected.setdefault(place, {"row_count": 0, "good_count": 0, "bad_count": 0})
            cell["row_count"] += 1
            cell["good_count"] += r[-1] == "good"
            cell["bad_count"] += r[-1] == "bad"
        assert got[c] == expected


def test_no_rows_no_cells(spark):
    assert counting.interval_counts(spark.createDataFrame([], "x double, outcome string"), ["x"], {"x": [1.0]}, TARGET) == {"x": {}}


def test_plan_does_not_grow_with_the_breaks(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit("good").alias("outcome"))
    assert counting.interval_counts(df, ["x"], {"x": [i / 1000 for i in range(5000)]}, TARGET)["x"][0]["row_count"] == 1


def test_long_chains_of_intervals_are_searched(spark):
    rows = [(float(i) / 4,) for i in range(-8, 60)] + [(None,), (float("nan"),), (float("-inf"),), (float("inf"),)]
    df = spark.createDataFrame([(*r, "good" if i % 2 else "bad") for i, r in enumerate(rows)], "x double, outcome string")
    bins = binning.fit_bins(df, TARGET, binning.BinningParams(max_bins=9))
    entries = binning.bins_by_variable(bins)["x"]
    names = [f"'{e.bin_id}'" for e in entries]
    linear = "CASE " + " ".join(f"WHEN {binning.bin_condition(e, entries)} THEN {n}" for e, n in zip(entries, names)) + " END"
    searched = binning.case_by_bin(entries, names)
    assert searched.count("<=") == len(entries) - 2 and linear.count("<=") + linear.count(">") > 2 * (len(entries) - 3)
    assert df.filter(~F.expr(searched).eqNullSafe(F.expr(linear))).isEmpty()
    closed = [Row(**{**e.asDict(), "lower_inclusive": e.lower is not None, "upper_inclusive": False}) for e in entries]
    linear = "CASE " + " ".join(f"WHEN {binning.bin_condition(e, closed)} THEN {n}" for e, n in zip(closed, names)) + " END"
    assert df.filter(~F.expr(binning.case_by_bin(closed, names)).eqNullSafe(F.expr(linear))).isEmpty()
    counted = {r.bin_id: (r.row_count, r.good_count, r.bad_count) for r in binning.bin_counts(df, bins, TARGET).filter("variable = 'x'").collect()}
    assert counted == {e.bin_id: (e.row_count, e.good_count, e.bad_count) for e in entries}


def test_a_gap_between_intervals_stays_without_a_bin(spark):
    df = spark.createDataFrame([(float(i), "good" if i % 2 else "bad") for i in range(40)], "x double, outcome string")
    entries = binning.bins_by_variable(binning.fit_bins(df, TARGET, binning.BinningParams(max_bins=8)))["x"]
    kept = [e for i, e in enumerate(entries) if i != 3]
    text = binning.case_by_bin(kept, [f"'{e.bin_id}'" for e in kept], entries)
    assert df.filter(F.expr(text).isNull()).count() == entries[3].row_count


def test_inflation_reads_costly_columns_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(diagnostics, "stage", lambda df: staged.append(df.columns) or df.localCheckpoint(), raising=True)
    df = spark.range(60).select(F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), F.lit("x").alias("text"))
    assert {r.feature for r in diagnostics.vif(df, ["a", "b"]).collect()} == {"a", "b"}
    assert staged == [["a", "b"]]

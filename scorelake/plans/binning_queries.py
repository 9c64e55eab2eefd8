"""Binning, WOE and IV queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import binning, woe
from scorelake.plans.registry import query
from scorelake.plans.views import CATEGORICAL, NUMERIC, SCORED_CTE, TARGET, development

FEATURES = NUMERIC + CATEGORICAL
PARAMS = binning.BinningParams(max_bins=20, max_categorical_levels=3)


def _numeric_long() -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS x, outcome FROM dev" for c in NUMERIC]
    return " UNION ALL ".join(parts)


def _text_long() -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS x, outcome FROM dev" for c in CATEGORICAL]
    return " UNION ALL ".join(parts)


_PROBS20 = "[" + ", ".join(repr(k / 20) for k in range(1, 20)) + "]"
_PROBS19 = "[" + ", ".join(repr(k / 19) for k in range(1, 19)) + "]"

# Bins, their recount and unrounded WOE, from the training rows.
BINS_CTE = f"""{SCORED_CTE}, dev AS (SELECT * FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad')),
num AS ({_numeric_long()}),
cat AS ({_text_long()}),
brk AS (
  SELECT variable, list_sort(list_distinct(CASE WHEN count(x) < count(*)
     THEN quantile_cont(x, {_PROBS19}) ELSE quantile_cont(x, {_PROBS20}) END)) AS b
  FROM num GROUP BY variable),
numcell AS (
  SELECT num.variable, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(b, lambda e: e < x)) END AS cell, b, outcome
  FROM num JOIN brk ON num.variable = brk.variable),
numcount AS (
  SELECT variable, cell, count(*) AS row_count, count(*) FILTER (outcome = 'good') AS good_count,
         count(*) FILTER (outcome = 'bad') AS bad_count, any_value(b) AS b
  FROM numcell GROUP BY variable, cell),
numbins AS (
  SELECT variable, 'numeric' AS kind, row_number() OVER (PARTITION BY variable ORDER BY cell) AS bin_order,
    CASE WHEN cell > 0 AND lag(cell) OVER w >= 0 THEN b[lag(cell) OVER w + 1] END AS lower,
    CASE WHEN cell >= 0 AND lead(cell) OVER w IS NOT NULL THEN b[cell + 1] END AS upper,
    NULL AS category, cell = -1 AS is_missing, FALSE AS is_other, row_count, good_count, bad_count
  FROM numcount WINDOW w AS (PARTITION BY variable ORDER BY cell)),
catcount AS (
  SELECT variable, x, count(*) AS row_count, count(*) FILTER (outcome = 'good') AS good_count,
         count(*) FILTER (outcome = 'bad') AS bad_count,
         row_number() OVER (PARTITION BY variable, x IS NULL ORDER BY count(*) DESC, x) AS rk
  FROM cat GROUP BY variable, x),
catgrp AS (
  SELECT variable, CASE WHEN x IS NULL THEN 0 WHEN rk <= 3 THEN rk ELSE 4 END AS grp,
    CASE WHEN rk <= 3 THEN x END AS category,
    CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(good_count) AS BIGINT) AS good_count,
    CAST(sum(bad_count) AS BIGINT) AS bad_count
  FROM catcount GROUP BY ALL),
catbins AS (
  SELECT variable, 'categorical' AS kind, row_number() OVER (PARTITION BY variable ORDER BY grp) AS bin_order,
    CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, category,
    grp = 0 AS is_missing, grp = 4 AS is_other, row_count, good_count, bad_count
  FROM catgrp),
bins AS (
  SELECT variable || '_bin_' || lpad(CAST(bin_order AS VARCHAR), 3, '0') AS bin_id, * FROM
   (SELECT * FROM numbins UNION ALL SELECT * FROM catbins) u),
tot AS (SELECT count(*) FILTER (outcome = 'good') AS tg, count(*) FILTER (outcome = 'bad') AS tb FROM dev),
cells AS (
  SELECT bins.*, good_count / tg AS good_dist, bad_count / tb AS bad_dist,
    CASE WHEN good_count > 0 AND bad_count > 0 THEN ln((good_count / tg) / (bad_count / tb)) ELSE 0 END AS woe
  FROM bins, tot),
woe AS (SELECT *, (good_dist - bad_dist) * woe AS iv_component FROM cells),
iv AS (SELECT variable, round(sum(iv_component), 6) AS iv, count(*) AS bin_count FROM woe GROUP BY variable)
"""

_BIN_COLUMNS = """variable, kind, bin_id, CAST(bin_order AS INT) AS bin_order,
 round(lower, 6) AS lower, round(upper, 6) AS upper, category, is_missing, is_other,
 row_count, good_count, bad_count"""


def fitted_bins(spark, sf_dir, columns=None, dev=None):
    sample = dev if dev is not None else development(spark, sf_dir)
    return binning.fit_bins(sample, TARGET, PARAMS, columns or FEATURES)


def _shown(bins):
    return bins.select(
        "variable", "kind", "bin_id", "bin_order", F.round("lower", 6).alias("lower"),
        F.round("upper", 6).alias("upper"), F.get("categories", F.lit(0)).alias("category"),
        "is_missing", "is_other", "row_count", "good_count", "bad_count",
    )


@query("bins_numeric", f"{BINS_CTE} SELECT {_BIN_COLUMNS} FROM bins WHERE kind = 'numeric'")
def bins_numeric(spark, sf_dir):
    return _shown(fitted_bins(spark, sf_dir, NUMERIC))


@query("bins_categorical", f"{BINS_CTE} SELECT {_BIN_COLUMNS} FROM bins WHERE kind = 'categorical'")
def bins_categorical(spark, sf_dir):
    return _shown(fitted_bins(spark, sf_dir, CATEGORICAL))


@query("bins_all", f"{BINS_CTE} SELECT {_BIN_COLUMNS} FROM bins")
def bins_all(spark, sf_dir):
    return _shown(fitted_bins(spark, sf_dir))


@query(
    "bin_warnings",
    f"""{BINS_CTE} SELECT variable, bin_id, round(row_count / whole, 6) AS fraction
    FROM (SELECT *, sum(row_count) OVER (PARTITION BY variable) AS whole FROM bins WHERE kind = 'numeric' AND NOT is_missing) b
    WHERE row_count / whole < 0.05""",
)
def bin_warnings(spark, sf_dir):
    found = binning.bin_warnings(fitted_bins(spark, sf_dir), PARAMS)
    return found.withColumn("fraction", F.round("fraction", 6))


def fitted_cells(spark, sf_dir, columns=None, params=woe.WoeParams()):
    dev = development(spark, sf_dir)
    bins = fitted_bins(spark, sf_dir, columns, dev)
    return bins, woe.woe_cells(dev, bins, TARGET, params)


@query(
    "woe_table",
    f"""{BINS_CTE} SELECT variable, bin_id, row_count, good_count, bad_count,
    round(good_dist, 6) AS good_distribution, round(bad_dist, 6) AS bad_distribution,
    round(woe, 6) AS woe, round(iv_component, 6) AS iv_component FROM woe""",
)
def woe_table(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir)
    return woe.woe_table(cells).drop("label")


@query("iv_table", f"{BINS_CTE} SELECT variable, iv, bin_count, CAST(0 AS BIGINT) AS zero_cell_count FROM iv")
def iv_table(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir)
    return woe.iv_table(cells)

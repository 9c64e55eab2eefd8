"""Model fits, calibration, optimal binning, reject inference and explanation queries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scorelake.functions.columns import one_row
from scorelake.functions.state import stage
from scorelake.operators import calibrate, explain, isotonic, metrics, model, optimal, prep, reject, scaling, scoring, select
from scorelake.plans.binning_queries import BINS_CTE, FEATURES
from scorelake.plans.metric_queries import SCORED_CTE, scored_sample
from scorelake.plans.model_queries import SCALING, _woe_frame, with_woe
from scorelake.plans.newton_sql import newton_cte
from scorelake.plans.prep_queries import REJECTS
from scorelake.plans.registry import query
from scorelake.plans.views import NUMERIC, TARGET, apps, development, known, scored, table

TREE_FEATURES = ["quantity", "price", "discount", "tax", "balance", "builder"]


def _filled(df):
    """Numeric features without nulls, plus a flag for one segment."""
    return df.fillna({"quantity": 25.0, "balance": 0.0}).withColumn(
        "builder", F.when(F.col("segment") == "BUILDING", 1.0).otherwise(0.0)
    )


def _tree_sample(spark, sf_dir):
    return stage(_filled(development(spark, sf_dir)).select("app_key", "outcome", "role", *TREE_FEATURES))


def _narrow_sample(spark, sf_dir):
    """The rows of the tree sample in another order, joined and staged once with the columns in use only."""
    rows = development(spark, sf_dir, ["app_key", "outcome", "quantity", "price", "discount", "tax", "balance", "segment"])
    return _filled(rows).select("app_key", "outcome", *TREE_FEATURES)


_WOE_NAMES = [f"{v}_woe" for v in FEATURES]
# The fit on all WOE columns, C = 1, and its rounded coefficients.
LOGIT_CTE = (
    BINS_CTE.replace("WITH ", "WITH RECURSIVE ", 1)
    + with_woe(FEATURES, "dev", "x")
    + f""", design AS (SELECT [1.0::DOUBLE, {", ".join(_WOE_NAMES)}] AS x, CASE WHEN outcome = 'bad' THEN 1.0::DOUBLE ELSE 0 END AS y, -1 AS fold FROM x),
asked AS (SELECT 0 AS fit, 1.0::DOUBLE AS l2, CAST(NULL AS INT) AS without),
{newton_cte("design", "asked", len(FEATURES) + 1)},
coefs AS (SELECT unnest(['(Intercept)', {", ".join(f"'{n}'" for n in _WOE_NAMES)}]) AS feature, unnest(list_transform(beta, lambda v: round(v, 6))) AS coefficient FROM fitted)"""
)


@query("logit_fit", f"{LOGIT_CTE} SELECT feature, coefficient FROM coefs")
def logit_fit(spark, sf_dir):
    frame, _ = _woe_frame(spark, sf_dir)
    return model.fit_logistic(frame, TARGET)


@query(
    "logit_l1",
    f"""SELECT unnest(['(Intercept)', {", ".join(f"'{n}'" for n in _WOE_NAMES)}]) AS feature, TRUE AS optimal""",
)
def logit_l1(spark, sf_dir):
    """Whether every coefficient of the absolute penalty meets its score equation, by sums over all rows at the fit.

    A coefficient that is not zero has a slope of the penalty against its sign, one at zero a slope of the penalty at most.
    """
    frame, _ = _woe_frame(spark, sf_dir)
    frame = stage(frame.select("outcome", *_WOE_NAMES))
    fitted = {r.feature: r.coefficient for r in model.fit_logistic(frame, TARGET, params=model.LogisticParams(penalty="l1", c=0.01)).collect()}
    penalty = 1.0 / 0.01
    z = sum((F.col(n) * F.lit(fitted[n]) for n in _WOE_NAMES), F.lit(fitted[scaling.INTERCEPT]))
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.when(F.col("outcome") == "bad", 1.0).otherwise(0.0)
    slopes = frame.agg(F.sum(miss).alias(scaling.INTERCEPT), *[F.sum(miss * F.col(n)).alias(n) for n in _WOE_NAMES])
    slack = 0.05  # coefficients are rounded to six decimals
    met = []
    for n in [scaling.INTERCEPT, *_WOE_NAMES]:
        due = F.lit(0.0 if n == scaling.INTERCEPT else -penalty * (1 if fitted[n] > 0 else -1))
        free = n == scaling.INTERCEPT or fitted[n] != 0
        fits = F.abs(F.col(f"`{n}`") - due) <= slack if free else F.abs(F.col(f"`{n}`")) <= penalty + slack
        met.append(F.struct(F.lit(n).alias("feature"), fits.alias("optimal")))
    return slopes.select(F.inline(F.array(*met)))


@query(
    "fitted_scorecard",
    f"""{LOGIT_CTE} SELECT variable, bin_id, round(woe, 6) AS woe, coefficient, round(-20::DOUBLE / ln(2) * coefficient * round(woe, 6), 2) AS points
    FROM woe JOIN coefs ON feature = variable || '_woe'""",
)
def fitted_scorecard(spark, sf_dir):
    """Bins, WOE, fit and scaling in one flow: the points of a fitted model."""
    frame, table = _woe_frame(spark, sf_dir)
    coefficients = model.fit_logistic(frame, TARGET)
    return scaling.scorecard(table, coefficients, SCALING).drop("label")


@query("tree_rules")
def tree_rules(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    fitted = model.fit_tree(sample, TARGET, TREE_FEATURES, "decision_tree", max_depth=4, min_samples_leaf=50)
    return model.tree_rules(sample, fitted, TARGET, TREE_FEATURES)


@query(
    "tree_rules_check",
    f"""{SCORED_CTE} SELECT TRUE AS all_leaves, TRUE AS counts_agree, TRUE AS probabilities_agree, count(*) AS n_rows, count(*) FILTER (outcome = 'bad') AS n_bad
    FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad')""",
)
def tree_rules_check(spark, sf_dir):
    """Every rule read as a filter: its rows, bads and probability against the model's, and all rows under one rule each."""
    sample = _tree_sample(spark, sf_dir)
    fitted = model.fit_tree(sample, TARGET, TREE_FEATURES, "decision_tree", max_depth=4, min_samples_leaf=50)
    rules = model.tree_rules(sample, fitted, TARGET, TREE_FEATURES).collect()  # one row per leaf
    bad = F.col("outcome") == "bad"
    scored_rows = model.apply_tree(fitted, sample, TREE_FEATURES)
    sums, agree, near = [], F.lit(True), F.lit(True)
    for i, r in enumerate(rules):
        held = F.expr(r.rule)
        gap = F.max(F.when(held, F.abs(F.col(metrics.PROBABILITY) - F.lit(r.probability))))
        sums += [F.count_if(held).alias(f"n{i}"), F.count_if(held & bad).alias(f"b{i}"), gap.alias(f"g{i}")]
        agree = agree & (F.col(f"n{i}") == r.sample_count) & (F.col(f"b{i}") == r.bad_count)
        near = near & (F.col(f"g{i}") <= 1e-6)
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(len(rules))), F.lit(0)).cast("long")
    leaves = F.lit(len(rules) == (fitted.numNodes + 1) // 2)
    return scored_rows.agg(*sums).select(
        leaves.alias("all_leaves"), agree.alias("counts_agree"), near.alias("probabilities_agree"), total("n").alias("n_rows"), total("b").alias("n_bad")
    )


@query("forest_fit")
def forest_fit(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    fitted = model.fit_tree(sample, TARGET, TREE_FEATURES, "random_forest", n_trees=100)
    return model.importances(sample, fitted, TREE_FEATURES)


@query("gbt_fit")
def gbt_fit(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    fitted, _ = model.fit_boosted(sample, TARGET, TREE_FEATURES, n_trees=100)
    return model.importances(sample, fitted, TREE_FEATURES)


@query("gbt_presets")
def gbt_presets(spark, sf_dir):
    """Boosted trees with all their rounds; presets of one depth are one model, fitted once."""
    sample = _tree_sample(spark, sf_dir)
    depths = sorted(set(model.BOOSTING_DEPTH.values()))
    fitted = {d: model.importances(sample, model.fit_boosted(sample, TARGET, TREE_FEATURES, max_depth=d)[0], TREE_FEATURES) for d in depths}
    parts = [fitted[d].select(F.lit(preset).alias("preset"), "feature", "importance") for preset, d in model.BOOSTING_DEPTH.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("score_tree")
def score_tree(spark, sf_dir):
    fitted = model.fit_tree(_tree_sample(spark, sf_dir), TARGET, TREE_FEATURES, "decision_tree")
    sample = _filled(scored(spark, sf_dir)).select("app_key", "role", *TREE_FEATURES)
    return scoring.score_probability(model.apply_tree(fitted, sample, TREE_FEATURES), SCALING).select(
        "app_key", "role", metrics.PROBABILITY, metrics.SCORE
    )


@query("cv_metrics_tree")
def cv_metrics_tree(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    return model.cross_validate(sample, TARGET, TREE_FEATURES, ["app_key"], "decision_tree", folds=5)


# Rows of the tree sample in five folds of even classes.
_FOLDED_CTE = SCORED_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + """, design AS (
      SELECT [1.0::DOUBLE, coalesce(quantity, 25), price, discount, tax, coalesce(balance, 0), CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END] AS x,
        CASE WHEN outcome = 'bad' THEN 1.0::DOUBLE ELSE 0 END AS y,
        (row_number() OVER (PARTITION BY outcome ORDER BY md5(concat_ws('|', app_key, price, 42))) - 1) % 5 AS fold
      FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad'))"""


@query(
    "cv_metrics",
    f"""{_FOLDED_CTE}, asked AS (SELECT k AS fit, 1.0::DOUBLE AS l2, k AS without FROM range(5) r(k)),
    {newton_cte("design", "asked", 7)},
    held AS (SELECT f.fit, CASE WHEN d.fold = f.fit THEN 'test' ELSE 'train' END AS role, y, 1 / (1 + exp(-list_dot_product(beta, x))) AS p FROM fitted f, design d),
    counts AS (SELECT fit, role, p, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM held GROUP BY ALL),
    below AS (SELECT *, coalesce(sum(good) OVER (PARTITION BY fit, role ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts),
    q AS (SELECT fit, role, round(sum(bad * (before + good * 0.5::DOUBLE)) / (sum(bad) * sum(good))::DOUBLE, 6) AS auc,
      coalesce(sum(bad) FILTER (p >= 0.5), 0) AS tp, coalesce(sum(good) FILTER (p >= 0.5), 0) AS fp,
      coalesce(sum(bad) FILTER (p < 0.5), 0) AS fn, coalesce(sum(good) FILTER (p < 0.5), 0) AS tn FROM below GROUP BY fit, role)
    SELECT CAST(fit AS INT) AS fold, role, auc,
      round((CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 6) AS f1_macro,
      avg(auc) FILTER (role = 'test') OVER () < avg(auc) FILTER (role = 'train') OVER () - 0.1 AS overfit FROM q""",
)
def cv_metrics(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    return model.cross_validate(sample, TARGET, TREE_FEATURES, ["app_key", "price"], "logistic", folds=5)


@query("tune_grid")
def tune_grid(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    return model.tune(sample, TARGET, TREE_FEATURES, ["app_key"], "decision_tree", {"max_depth": [2, 4], "min_samples_leaf": [20, 200]}, folds=5)


_TUNED = random.Random(42).sample([0.001, 0.01, 0.1, 1.0, 10.0], 4)


@query(
    "tune_random",
    f"""{_FOLDED_CTE},
    asked AS (SELECT c::VARCHAR || '/' || k AS fit, c, 1 / c AS l2, k AS without FROM (VALUES {", ".join(f"({c}::DOUBLE)" for c in _TUNED)}) v(c), range(5) r(k)),
    {newton_cte("design", "asked", 7)},
    held AS (SELECT f.fit, c, y, 1 / (1 + exp(-list_dot_product(beta, x))) AS p FROM fitted f JOIN asked USING (fit) JOIN design d ON d.fold = without),
    counts AS (SELECT fit, c, p, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM held GROUP BY ALL),
    below AS (SELECT *, coalesce(sum(good) OVER (PARTITION BY fit ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts),
    areas AS (SELECT fit, c, round(sum(bad * (before + good * 0.5::DOUBLE)) / (sum(bad) * sum(good))::DOUBLE, 6) AS auc FROM below GROUP BY fit, c),
    told AS (SELECT 'c=' || c AS params, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM areas GROUP BY c)
    SELECT *, CAST(row_number() OVER (ORDER BY mean_auc DESC, params) AS INT) AS rank FROM told""",
)
def tune_random(spark, sf_dir):
    sample = _narrow_sample(spark, sf_dir)
    return model.tune(sample, TARGET, TREE_FEATURES, ["app_key", "price"], "logistic", {"c": [0.001, 0.01, 0.1, 1.0, 10.0]}, folds=5, random_trials=4)


@query("select_embedded")
def select_embedded(spark, sf_dir):
    sample = _tree_sample(spark, sf_dir)
    fitted = model.fit_tree(sample, TARGET, TREE_FEATURES, "decision_tree", max_depth=5, min_samples_leaf=5)
    return select.select_by_importance(model.importances(sample, fitted, TREE_FEATURES))


# --- calibration ---------------------------------------------------------------------


def _probabilities(spark, sf_dir):
    return known(scored_sample(spark, sf_dir, extra=["app_key"])).filter("role = 'test'")


def _reported(sample, calibrated):
    both = calibrated.withColumn("raw", F.col("raw_p"))
    return calibrate.calibration_report(both, TARGET, "raw", metrics.PROBABILITY)


def _with_raw(sample):
    return sample.withColumn("raw_p", F.col(metrics.PROBABILITY))


_REPORT_SQL = """
e AS (SELECT quantile_cont(cal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM k),
g AS (SELECT CAST(len(list_filter(b, lambda x: x <= cal)) AS INT) AS bin, count(*) AS count, avg(cal) AS c, avg(raw) AS r, avg(y) AS a FROM k, e GROUP BY 1),
o AS (SELECT bin, count, round(c, 6) AS avg_predicted, round(r, 6) AS avg_predicted_raw, round(a, 6) AS actual_bad_rate, round(abs(c - a), 6) AS abs_deviation FROM g)
SELECT *, round(avg(abs_deviation) OVER (), 6) AS mean_deviation, max(abs_deviation) OVER () AS max_deviation FROM o
"""
_LOGIT_P = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


def _platt_sql(fits: str) -> str:
    """Sigmoids of the log-odds by Newton's method; their mean is the calibrated probability, to twelve decimals."""
    return f"""{SCORED_CTE.replace("WITH ", "WITH RECURSIVE ", 1)},
    t AS (SELECT app_key, predicted_bad_probability AS p, CASE WHEN outcome = 'bad' THEN 1.0::DOUBLE ELSE 0 END AS y,
      CAST(CAST('0x' || substr(md5(concat_ws('|', app_key, 42)), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM scored WHERE role = 'test' AND outcome IN ('good', 'bad')),
    design AS (SELECT [1.0::DOUBLE, {_LOGIT_P}] AS x, y, fold FROM t),
    asked AS ({fits}),
    {newton_cte("design", "asked", 2)},
    each AS (SELECT p, avg(1 / (1 + exp(-(beta[2] * {_LOGIT_P} + beta[1])))) AS cal FROM (SELECT DISTINCT p FROM t) v, fitted GROUP BY p),
    k AS (SELECT t.p AS raw, round(cal, 9) AS cal, y FROM t JOIN each USING (p)), {_REPORT_SQL}"""


def _rounded(df):
    return df.withColumn(metrics.PROBABILITY, F.round(metrics.PROBABILITY, 9))


@query("calibrate_platt", _platt_sql("SELECT 0 AS fit, 1.0::DOUBLE AS l2, CAST(NULL AS INT) AS without"))
def calibrate_platt(spark, sf_dir):
    sample = _probabilities(spark, sf_dir)
    return _reported(sample, _rounded(calibrate.fit_platt(sample, TARGET).transform(_with_raw(sample))))


@query("calibrate_platt_cv", _platt_sql("SELECT k AS fit, 1.0::DOUBLE AS l2, k AS without FROM range(5) r(k)"))
def calibrate_platt_cv(spark, sf_dir):
    sample = _probabilities(spark, sf_dir)
    fitted = calibrate.fit_platt(sample, TARGET, folds=5, keys=["app_key"])
    return _reported(sample, _rounded(fitted.transform(_with_raw(sample))))


@query(
    "calibrate_platt_folded",
    f"""{LOGIT_CTE}, logged AS (SELECT 1 / (1 + exp(-list_dot_product((SELECT list(coefficient ORDER BY place) FROM
        (SELECT coefficient, list_position(['(Intercept)', {", ".join(f"'{n}'" for n in _WOE_NAMES)}], feature) AS place FROM coefs) o), d.x))) AS p, y FROM design d),
    platt_rows AS (SELECT [1.0::DOUBLE, {_LOGIT_P}] AS x, y, -1 AS fold FROM logged),
    {newton_cte("platt_rows", "asked", 2, state="platt_state", fitted="platt")}
    SELECT feature, round(coefficient * beta[2] + CASE WHEN feature = '(Intercept)' THEN beta[1] ELSE 0 END, 6) AS coefficient FROM coefs, platt""",
)
def calibrate_platt_folded(spark, sf_dir):
    """Calibration folded into the coefficients of a fitted model."""
    frame, _ = _woe_frame(spark, sf_dir)
    coefficients = model.fit_logistic(frame, TARGET)
    plain = frame.drop(metrics.PROBABILITY, metrics.SCORE)
    fitted = calibrate.fit_platt(scoring.apply_logistic(plain, coefficients, None), TARGET)
    return fitted.fold_into(coefficients)


# Each value's isotonic mean is the largest, over starts at or below it, of the smallest mean up to an end at or above it.
_STEPS_SQL = """
t AS (SELECT predicted_bad_probability AS p, CASE WHEN outcome = 'bad' THEN 1 ELSE 0 END AS bad,
  CAST(CAST('0x' || substr(md5(concat_ws('|', app_key, 42)), 1, 8) AS BIGINT) % 5 AS INT) AS fold
  FROM scored WHERE role = 'test' AND outcome IN ('good', 'bad')),
w AS (SELECT part, p, count(*) AS n, sum(bad) AS bad FROM t, range(PARTS) r(part) WHERE NOT CROSSED OR fold <> part GROUP BY ALL),
c AS (SELECT part, p, row_number() OVER o AS i, sum(n) OVER o AS cn, sum(bad) OVER o AS cb, n, bad FROM w WINDOW o AS (PARTITION BY part ORDER BY p)),
span AS (SELECT a.part, a.i AS a, z.i AS i, min((z.cb - a.cb + a.bad) / (z.cn - a.cn + a.n)) OVER (PARTITION BY a.part, a.i ORDER BY z.i DESC) AS least
  FROM c a JOIN c z ON a.part = z.part AND a.i <= z.i),
f AS (SELECT part, i, max(least) AS mean FROM span GROUP BY ALL),
fitted AS (SELECT c.part, c.p, f.mean FROM c JOIN f ON c.part = f.part AND c.i = f.i),
v AS (SELECT DISTINCT p FROM t),
around AS (
  SELECT v.p, part, max(b.p) FILTER (b.p <= v.p) AS lo, min(b.p) FILTER (b.p >= v.p) AS hi FROM v, fitted b GROUP BY ALL),
known_mean AS (
  SELECT around.p, around.part, CASE WHEN lo IS NULL OR lo = hi THEN h.mean WHEN hi IS NULL THEN l.mean
    ELSE l.mean + (h.mean - l.mean) * (around.p - lo) / (hi - lo) END AS mean
  FROM around LEFT JOIN fitted l ON l.part = around.part AND l.p = lo LEFT JOIN fitted h ON h.part = around.part AND h.p = hi),
k AS (SELECT v.p AS raw, m.mean AS cal, t.bad::DOUBLE AS y FROM t JOIN v USING (p) JOIN
  (SELECT p, list_sum(list(mean ORDER BY part)) / PARTS AS mean FROM known_mean GROUP BY p) m USING (p)),
e AS (SELECT quantile_cont(cal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM k),
g AS (SELECT CAST(len(list_filter(b, lambda x: x <= cal)) AS INT) AS bin, count(*) AS count, avg(cal) AS c, avg(raw) AS r, avg(y) AS a FROM k, e GROUP BY 1),
o AS (SELECT bin, count, round(c, 6) AS avg_predicted, round(r, 6) AS avg_predicted_raw, round(a, 6) AS actual_bad_rate, round(abs(c - a), 6) AS abs_deviation FROM g)
SELECT *, round(avg(abs_deviation) OVER (), 6) AS mean_deviation, max(abs_deviation) OVER () AS max_deviation FROM o
"""


@query("calibrate_isotonic", f"{SCORED_CTE}, {_STEPS_SQL.replace('PARTS', '1').replace('CROSSED', 'FALSE')}")
def calibrate_isotonic(spark, sf_dir):
    sample = _probabilities(spark, sf_dir)
    return _reported(sample, calibrate.fit_isotonic(sample, TARGET).transform(_with_raw(sample)))


@query("calibrate_isotonic_cv", f"{SCORED_CTE}, {_STEPS_SQL.replace('PARTS', '5').replace('CROSSED', 'TRUE')}")
def calibrate_isotonic_cv(spark, sf_dir):
    sample = _probabilities(spark, sf_dir)
    fitted = calibrate.fit_isotonic(sample, TARGET, folds=5, keys=["app_key"])
    return _reported(sample, fitted.transform(_with_raw(sample)))


@query(
    "isotonic_steps",
    f"""{SCORED_CTE}, {_STEPS_SQL.replace('PARTS', '5').replace('CROSSED', 'TRUE').split("v AS (")[0].rstrip().rstrip(",")}
    SELECT part, round(mean, 9) AS mean, sum(w.n)::BIGINT AS n, sum(w.bad)::BIGINT AS bad FROM fitted JOIN w USING (part, p) GROUP BY part, round(mean, 9)""",
)
def isotonic_steps(spark, sf_dir):
    """The pooled steps of five training folds; steps of one mean are told together."""
    weights = calibrate.fold_weights(_probabilities(spark, sf_dir), TARGET, ["app_key"], 5, 42)
    mean = F.round(F.col("bad") / F.col("n"), 9).alias("mean")
    steps = isotonic.isotonic_blocks(weights).groupBy(F.col("part").cast("long").alias("part"), mean)
    return steps.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


@query(
    "calibration_report",
    f"""{SCORED_CTE}, k AS (SELECT predicted_bad_probability AS raw,
      round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(1.1::DOUBLE * ln(predicted_bad_probability / (1.0::DOUBLE - predicted_bad_probability)) + 0.2::DOUBLE))), 6) AS cal,
      CASE WHEN outcome = 'bad' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM scored WHERE outcome IN ('good', 'bad')),
    e AS (SELECT quantile_cont(cal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM k),
    g AS (SELECT CAST(len(list_filter(b, lambda x: x <= cal)) AS INT) AS bin, count(*) AS count, avg(cal) AS c, avg(raw) AS r, avg(y) AS a FROM k, e GROUP BY 1),
    o AS (SELECT bin, count, round(c, 6) AS avg_predicted, round(r, 6) AS avg_predicted_raw, round(a, 6) AS actual_bad_rate,
      round(abs(c - a), 6) AS abs_deviation FROM g)
    SELECT *, round(avg(abs_deviation) OVER (), 6) AS mean_deviation, max(abs_deviation) OVER () AS max_deviation FROM o""",
)
def calibration_report(spark, sf_dir):
    p = F.col(metrics.PROBABILITY)
    shifted = F.lit(1.1) * F.log(p / (F.lit(1.0) - p)) + F.lit(0.2)
    sample = stage(
        known(scored(spark, sf_dir)).select(
            "outcome", p.alias("raw"), F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-shifted)), 6).alias("cal")
        )
    )
    return calibrate.calibration_report(sample, TARGET, "raw", "cal")


# --- optimal binning --------------------------------------------------------------------


# Every merge of neighbouring pre-bins that the limits allow, by a table of best values over (last bin, number of bins).
_MERGE_SQL = """
cum AS (
  SELECT variable, x, g, b, coalesce(sum(g) OVER w, 0) AS g0, coalesce(sum(b) OVER w, 0) AS b0 FROM (
    SELECT variable, x, count(*) FILTER (outcome = 'good') AS g, count(*) FILTER (outcome = 'bad') AS b
    FROM num WHERE x IS NOT NULL GROUP BY variable, x) c
  WINDOW w AS (PARTITION BY variable ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
node AS (
  SELECT variable, 0 AS depth, CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, CAST(0 AS HUGEINT) AS g0, CAST(0 AS HUGEINT) AS b0,
    sum(g) AS g, sum(b) AS b, 0.05 * (sum(g) + sum(b)) AS least, CAST(NULL AS DOUBLE) AS cut, CAST('inf' AS DOUBLE) AS strength FROM cum GROUP BY variable
  UNION ALL
  SELECT variable, depth + 1, CASE WHEN side = 0 THEN lo ELSE x END, CASE WHEN side = 0 THEN x ELSE hi END,
    CASE WHEN side = 0 THEN g0 ELSE g0 + lg END, CASE WHEN side = 0 THEN b0 ELSE b0 + lb END,
    CASE WHEN side = 0 THEN lg ELSE g - lg END, CASE WHEN side = 0 THEN lb ELSE b - lb END, least, x, least(strength, gain)
  FROM (
    SELECT *, round(((lg * lg + lb * lb)::DOUBLE / (lg + lb) + ((g - lg) * (g - lg) + (b - lb) * (b - lb))::DOUBLE / (g + b - lg - lb)
        - (g * g + b * b)::DOUBLE / (g + b)), 6) AS gain,
      row_number() OVER (PARTITION BY variable, lo ORDER BY gain DESC, x) AS place
    FROM (SELECT n.*, c.x, c.g0 - n.g0 AS lg, c.b0 - n.b0 AS lb FROM node n JOIN cum c ON n.variable = c.variable AND c.x > n.lo AND c.x < n.hi) s
    WHERE lg + lb >= least AND g + b - lg - lb >= least) t, (VALUES (0), (1)) sides(side)
  WHERE place = 1 AND gain > 0),
cart AS (
  SELECT variable, list_sort(list(cut)) AS b FROM (
    SELECT variable, cut, row_number() OVER (PARTITION BY variable ORDER BY strength DESC, depth) AS place
    FROM (SELECT DISTINCT variable, cut, strength, depth FROM node WHERE cut IS NOT NULL) d) r
  WHERE place < 20 GROUP BY variable),
quantile AS (SELECT variable, list_sort(list_distinct(quantile_cont(x, PROBS))) AS b FROM num GROUP BY variable),
methods AS (SELECT 'cart' AS prebinning, * FROM cart UNION ALL SELECT 'quantile', * FROM quantile),
total AS (SELECT variable, count(*) AS n, count(*) FILTER (outcome = 'good') AS tg, count(*) FILTER (outcome = 'bad') AS tb
  FROM (SELECT variable, outcome FROM num UNION ALL SELECT variable, outcome FROM cat) q GROUP BY variable),
level AS (SELECT variable, x, count(*) AS n, count(*) FILTER (outcome = 'good') AS g, count(*) FILTER (outcome = 'bad') AS b FROM cat WHERE x IS NOT NULL GROUP BY variable, x),
pre AS (
  SELECT prebinning, num.variable, len(list_filter(b, lambda e: e <= x)) AS pos, count(*) FILTER (outcome = 'good') AS g, count(*) FILTER (outcome = 'bad') AS b
  FROM num JOIN methods m ON num.variable = m.variable WHERE x IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT prebinning, variable, row_number() OVER (PARTITION BY prebinning, variable ORDER BY b / l.n, x), g, b
  FROM level l JOIN total t USING (variable), (VALUES ('cart'), ('quantile')) p(prebinning) WHERE l.n >= 0.01 * t.n),
placed AS (SELECT prebinning, variable, g, b, row_number() OVER (PARTITION BY prebinning, variable ORDER BY pos) AS pos FROM pre),
seg AS (
  SELECT *, gs / tg AS gd, bs / tb AS bd, bs / (gs + bs) AS rate, (gs / tg - bs / tb) * ln((gs / tg) / (bs / tb)) AS iv FROM (
    SELECT a.prebinning, a.variable, a.pos AS i, z.pos AS j, sum(p.g) AS gs, sum(p.b) AS bs
    FROM placed a JOIN placed z ON a.prebinning = z.prebinning AND a.variable = z.variable AND a.pos <= z.pos
      JOIN placed p ON p.prebinning = a.prebinning AND p.variable = a.variable AND p.pos BETWEEN a.pos AND z.pos
    GROUP BY ALL) s JOIN total USING (variable)
  WHERE gs >= 20 AND bs >= 20 AND gs + bs >= 0.03 * n),
best AS (
  SELECT prebinning, variable, trend, 1 AS k, i, j, rate, iv, [j] AS path FROM seg, (VALUES ('up'), ('down')) t(trend) WHERE i = 1
  UNION ALL
  SELECT prebinning, variable, trend, k, i, j, rate, max(iv), arg_max(path, iv) FROM (
    SELECT c.prebinning, c.variable, c.trend, c.k + 1 AS k, s.i, s.j, s.rate, c.iv + s.iv AS iv, list_append(c.path, s.j) AS path
    FROM best c JOIN seg s ON s.prebinning = c.prebinning AND s.variable = c.variable AND s.i = c.j + 1
      AND CASE WHEN c.trend = 'up' THEN c.rate <= s.rate ELSE c.rate >= s.rate END
    WHERE c.k < 6) u
  GROUP BY ALL),
top AS (
  SELECT best.prebinning, best.variable, max(iv) AS iv, max(iv) FILTER (k > 1) AS parted, arg_max(path, iv) AS path FROM best
  JOIN (SELECT prebinning, variable, max(pos) AS m FROM placed GROUP BY ALL) e ON e.prebinning = best.prebinning AND e.variable = best.variable AND j = m
  GROUP BY ALL)
"""
_BEST_IV_SQL = """
SELECT prebinning, variable, CASE WHEN parted IS NULL AND variable IN (NUMBERS) THEN 'REJECTED' ELSE 'OPTIMAL' END AS status,
  CASE WHEN parted IS NOT NULL OR variable NOT IN (NUMBERS) THEN round(iv, 6) END AS iv
FROM top
"""
_MERGE_SQL = _MERGE_SQL.replace("PROBS", "[" + ", ".join(repr(k / 20) for k in range(1, 20)) + "]")
_NUMBERS = ", ".join(f"'{c}'" for c in NUMERIC)
_MERGED_CTE = f"{BINS_CTE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_MERGE_SQL}"
# The bins of the best merge of tree pre-bins, with missing values first and rare levels last.
_BEST_BINS_SQL = f""", chosen AS (SELECT variable, path FROM top WHERE prebinning = 'cart' AND (parted IS NOT NULL OR variable NOT IN ({_NUMBERS}))),
middles AS (SELECT c.variable, list_sort(list((cut + (SELECT max(x) FROM cum u WHERE u.variable = c.variable AND x < cut)) / 2)) AS mid
  FROM (SELECT variable, unnest(b) AS cut FROM cart) c GROUP BY c.variable),
lv AS (SELECT variable, x, l.n >= 0.01 * t.n AS plain, l.n, g, b, row_number() OVER (PARTITION BY variable, l.n >= 0.01 * t.n ORDER BY b / l.n, x) AS pos FROM level l JOIN total t USING (variable)),
grouped AS (SELECT p.variable, len(list_filter(path, lambda e: e < p.pos)) AS grp, min(pos) AS first, max(pos) AS last, len(any_value(path)) AS size, sum(g) AS g, sum(b) AS b
  FROM placed p JOIN chosen USING (variable) WHERE prebinning = 'cart' GROUP BY ALL),
nulls AS (SELECT variable, count(*) AS n, count(*) FILTER (outcome = 'good') AS g, count(*) FILTER (outcome = 'bad') AS b
  FROM (SELECT variable, x IS NULL AS gone, outcome FROM num UNION ALL SELECT variable, x IS NULL, outcome FROM cat) q WHERE gone GROUP BY variable),
listed AS (
  SELECT variable, -1 AS grp, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, NULL AS categories, TRUE AS is_missing, FALSE AS is_other, g, b FROM nulls JOIN chosen USING (variable)
  UNION ALL
  SELECT variable, grp, CASE WHEN grp > 0 THEN mid[first - 1] END, CASE WHEN grp < size - 1 THEN mid[last] END,
    (SELECT string_agg(x, ', ' ORDER BY x) FROM lv WHERE plain AND lv.variable = gr.variable AND pos BETWEEN first AND last), FALSE, FALSE, g, b
  FROM grouped gr LEFT JOIN middles USING (variable)
  UNION ALL
  SELECT variable, 99, NULL, NULL, NULL, FALSE, TRUE, sum(g), sum(b) FROM lv JOIN chosen USING (variable) WHERE NOT plain GROUP BY variable)
SELECT variable, CASE WHEN variable IN ({_NUMBERS}) THEN 'numeric' ELSE 'categorical' END AS kind, CAST(row_number() OVER (PARTITION BY variable ORDER BY grp) AS INT) AS bin_order,
  round(lower, 6) AS lower, round(upper, 6) AS upper, categories, is_missing, is_other, CAST(g + b AS BIGINT) AS row_count, CAST(g AS BIGINT) AS good_count, CAST(b AS BIGINT) AS bad_count
FROM listed"""


@query("bins_optimal_iv", _MERGED_CTE + _BEST_IV_SQL.replace("NUMBERS", _NUMBERS))
def bins_optimal_iv(spark, sf_dir):
    """Information value of the best merge, from tree and from quantile pre-bins."""
    dev = development(spark, sf_dir)
    parts = []
    for method in ("cart", "quantile"):
        bins, status = optimal.fit_optimal_bins(dev, TARGET, FEATURES, optimal.OptimalParams(prebinning=method))
        totals = one_row(dev.agg(F.count_if(TARGET.is_good).alias("tg"), F.count_if(TARGET.is_bad).alias("tb")))
        g, b = F.col("good_count") / F.col("all.tg"), F.col("bad_count") / F.col("all.tb")
        regular = bins.filter("NOT is_missing AND NOT is_special AND NOT is_other").withColumn("all", totals)
        iv = regular.groupBy("variable").agg(F.round(F.sum((g - b) * F.log(g / b)), 6).alias("iv"))
        parts.append(status.join(iv, "variable", "left").select(F.lit(method).alias("prebinning"), "variable", "status", "iv"))
    return parts[0].union(parts[1])


@query("bins_optimal", _MERGED_CTE + _BEST_BINS_SQL)
def bins_optimal(spark, sf_dir):
    bins, _ = optimal.fit_optimal_bins(development(spark, sf_dir), TARGET, FEATURES)
    return bins.select(
        "variable", "kind", "bin_order", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
        F.array_join("categories", ", ").alias("categories"), "is_missing", "is_other", "row_count", "good_count", "bad_count",
    )


@query("bins_optimal_status")
def bins_optimal_status(spark, sf_dir):
    params = optimal.OptimalParams(min_bin_size=0.2, monotonic="ascending")
    return optimal.fit_optimal_bins(development(spark, sf_dir), TARGET, FEATURES, params, {"quantity": [1.0, 50.0]})[1]


# --- reject inference ----------------------------------------------------------------------

REJECT_FEATURES = ["quantity", "price", "discount", "balance"]


def _population(spark, sf_dir):
    classified = prep.classify_population(apps(spark, sf_dir), TARGET, REJECTS)
    filled = classified.fillna({"quantity": 25.0, "balance": 0.0})
    return stage(filled.select("app_key", "outcome", prep.FINANCED, *REJECT_FEATURES))


@query("reject_band_weights")
def reject_band_weights(spark, sf_dir):
    params = reject.AugmentationParams()
    banded = reject.score_bands(_population(spark, sf_dir), TARGET, REJECT_FEATURES, params)
    return reject.band_weights(banded, TARGET, params)


@query(
    "reject_augment_size",
    """WITH p AS (SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT count(*) AS n_rows FROM p WHERE coalesce(c_mktsegment, '') <> 'FURNITURE' AND (l_orderkey * 11 + l_partkey) % 5 <> 0
      AND (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 97 <> 0""",
)
def reject_augment_size(spark, sf_dir):
    """The augmented sample is exactly as large as the financed one."""
    drawn = reject.augment(_population(spark, sf_dir), TARGET, ["app_key"], REJECT_FEATURES)
    return drawn.agg(F.count(F.lit(1)).alias("n_rows"))


@query("reject_augment")
def reject_augment(spark, sf_dir):
    return reject.augment(_population(spark, sf_dir), TARGET, ["app_key"], REJECT_FEATURES)


# --- explanation ----------------------------------------------------------------------------


# Line items beyond which the sample has the columns in use only; smaller tables keep the order of rows that their tree's split points were drawn from.
NARROW_ROWS = 50_000_000


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").count() > NARROW_ROWS
    sample = _narrow_sample(spark, sf_dir) if large else _tree_sample(spark, sf_dir)
    fitted = model.fit_tree(sample, TARGET, TREE_FEATURES, "decision_tree")
    return explain.permutation_importance(sample, fitted, TARGET, TREE_FEATURES, ["app_key"])


_STABLE = ["quantity", "price", "discount", "tax", "balance"]


@query(
    "importance_stability",
    f"""{SCORED_CTE}, s AS (SELECT *, substr(md5(concat_ws('|', app_key, '7')), 1, 1) AS h, CASE WHEN outcome = 'bad' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM scored),
    f AS (SELECT *, CASE WHEN h < '5' THEN 1 WHEN h < 'a' THEN 2 ELSE 3 END AS seed FROM s),
    i AS ({" UNION ALL ".join(f"SELECT seed, '{c}' AS feature, round(abs(corr({c}, y)), 6) AS importance FROM f GROUP BY seed" for c in _STABLE)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY importance DESC, feature) AS rk FROM i),
    p AS (SELECT a.seed AS sa, b.seed AS sb, corr(a.rk, b.rk) AS rho FROM r a JOIN r b ON a.feature = b.feature AND a.seed < b.seed GROUP BY ALL)
    SELECT count(*) AS seed_pairs, round(avg(rho), 4) AS mean_rank_correlation, round(avg(rho), 4) < 0.85 AS top_features_changed FROM p""",
)
def importance_stability(spark, sf_dir):
    """Importance = absolute correlation with the outcome on three hashed parts of the data."""
    h = F.substring(F.md5(F.concat_ws("|", "app_key", F.lit("7"))), 1, 1)
    y = F.when(F.col("outcome") == "bad", 1.0).otherwise(0.0)
    parts = scored(spark, sf_dir).withColumn("seed", F.when(h < "5", 1).when(h < "a", 2).otherwise(3))
    wide = parts.groupBy("seed").agg(*[F.round(F.abs(F.corr(F.col(c), y)), 6).alias(c) for c in _STABLE])
    table = wide.select("seed", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in _STABLE])))
    return explain.importance_stability(table)


# A fixed linear model of the tree sample's features.
_LINEAR = {"quantity": 0.02, "price": 1e-6, "discount": 6.0, "tax": -1.0, "balance": 1e-5, "builder": 0.5}
_LINEAR_Z = "-2.4::DOUBLE + " + " + ".join(f"{w!r}::DOUBLE * {c}" for c, w in _LINEAR.items())
_FILLED_CTE = f"""{SCORED_CTE}, s AS (SELECT coalesce(quantity, 25)::DOUBLE AS quantity, price::DOUBLE AS price, discount::DOUBLE AS discount, tax::DOUBLE AS tax,
  coalesce(balance, 0)::DOUBLE AS balance, CASE WHEN segment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS builder FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad'))"""


def _grid_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, unnest(CASE WHEN count(DISTINCT {c}) < 100 THEN list_sort(list_distinct(list({c})))
      ELSE list_transform(range(100), lambda k: quantile_cont({c}, 0.05) + (quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) * k / 99) END) AS grid_value FROM s"""


@query(
    "partial_dependence",
    f"""{_FILLED_CTE}, g AS ({" UNION ALL ".join(_grid_sql(c) for c in ("discount", "builder", "quantity", "price"))}),
    z AS (SELECT *, {_LINEAR_Z} AS z FROM s)
    SELECT feature, round(grid_value, 6) AS grid_value, round(avg(1 / (1 + exp(-(z + CASE feature
      {" ".join(f"WHEN '{c}' THEN {w!r}::DOUBLE * (grid_value - {c})" for c, w in _LINEAR.items())} END)))), 6) AS average_prediction
    FROM z, g GROUP BY feature, grid_value""",
)
def partial_dependence(spark, sf_dir):
    """Of a linear model, over four features."""
    sample = _tree_sample(spark, sf_dir)
    weight = {"discount": 4.0, "builder": 3.0, "quantity": 2.0, "price": 1.0}
    ranked = spark.createDataFrame([(f, weight.get(f, 0.0)) for f in TREE_FEATURES], "feature string, importance double")
    linear = scaling.coefficients_table(sample, -2.4, _LINEAR)
    return explain.partial_dependence(sample, linear, TREE_FEATURES, ranked, top=4, grid_points=100)


@query(
    "partial_dependence_tree",
    f"""{_FILLED_CTE} {" UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) < 100 THEN count(DISTINCT {c}) ELSE 100 END AS points, TRUE AS equals_rescoring FROM s" for c in ("price", "quantity", "discount"))}""",
)
def partial_dependence_tree(spark, sf_dir):
    """Of a tree, held against scoring every row once more for every grid value."""
    sample = _tree_sample(spark, sf_dir)
    fitted = model.fit_tree(sample, TARGET, TREE_FEATURES, "decision_tree")
    ranked = spark.createDataFrame([(f, 1.0 if f in ("price", "quantity", "discount") else 0.0) for f in TREE_FEATURES], "feature string, importance double")
    curves = stage(explain.partial_dependence(sample, fitted, TREE_FEATURES, ranked, top=3, grid_points=100))
    parts = []
    for f in ("price", "quantity", "discount"):
        grid = [(r.grid_value, r.average_prediction) for r in curves.filter(F.col("feature") == f).collect()]  # 100 values at most
        points = F.array(*[F.struct(F.lit(g).alias("at"), F.lit(a).alias("average_prediction")) for g, a in grid])
        rows = sample.select("*", F.lit(f).alias("feature"), F.inline(points)).withColumn(f, F.col("at"))
        scored_rows = model.apply_tree(fitted, rows, TREE_FEATURES).groupBy("feature", "at", "average_prediction").agg(F.avg(metrics.PROBABILITY).alias("again"))
        gap = F.max(F.abs(F.col("again") - F.col("average_prediction")))
        parts.append(scored_rows.groupBy("feature").agg(F.count(F.lit(1)).alias("points"), (gap <= 1e-6).alias("equals_rescoring")))
    return parts[0].union(parts[1]).union(parts[2])


@query("native_explanation", f"{LOGIT_CTE} SELECT feature, round(abs(coefficient), 6) AS importance FROM coefs WHERE feature <> '(Intercept)'")
def native_explanation(spark, sf_dir):
    frame, _ = _woe_frame(spark, sf_dir)
    return explain.coefficient_magnitude(model.fit_logistic(frame, TARGET))

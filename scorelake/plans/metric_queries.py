"""Validation, stability, strategy and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.state import stage
from scorelake.operators import fairness, metrics, strategy
from scorelake.plans.registry import query
from scorelake.plans.views import SCORED_CTE, TARGET, scored

_SHOWN = ["role", "outcome", "predicted_bad_probability", "score", "segment"]


def scored_sample(spark, sf_dir, weight="6.0", extra=()):
    """Scored rows of every role, staged: metrics read them more than once."""
    return stage(scored(spark, sf_dir, weight).select(*_SHOWN, *extra))


# Value counts with running totals, per role; {v} is the ranked column.
KNOWN_CTE = f"""{SCORED_CTE}, known AS (SELECT role, CASE WHEN outcome = 'bad' THEN 1 ELSE 0 END AS y,
   predicted_bad_probability AS p, score FROM scored WHERE outcome IN ('good', 'bad'))"""


def ranking_cte(value: str, source: str = "known", name: str = "pre") -> str:
    return f""", {name}_vc AS (SELECT role, {value} AS v, count(*) AS n, CAST(sum(y) AS BIGINT) AS bad,
     CAST(sum(1 - y) AS BIGINT) AS good FROM {source} GROUP BY ALL),
    {name} AS (SELECT *, coalesce(sum(good) OVER w, 0) AS bg, coalesce(sum(bad) OVER w, 0) AS bb,
      coalesce(sum(n) OVER w, 0) AS bn, sum(good) OVER (PARTITION BY role) AS tg, sum(bad) OVER (PARTITION BY role) AS tb
      FROM {name}_vc WINDOW w AS (PARTITION BY role ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


AUC_SELECT = """SELECT role, CAST(max(tb) AS BIGINT) AS bad_count, CAST(max(tg) AS BIGINT) AS good_count,
   round(sum(CAST(bad AS DOUBLE) * (bg + good * 0.5::DOUBLE)) / (max(tb)::DOUBLE * max(tg)::DOUBLE), 6) AS auc FROM {pre} GROUP BY role"""


@query(
    "auc_gini",
    f"{KNOWN_CTE}{ranking_cte('p')}, a AS ({AUC_SELECT.format(pre='pre')}) SELECT *, round(2 * auc - 1, 6) AS gini FROM a",
)
def auc_gini(spark, sf_dir):
    return metrics.auc_gini(metrics.score_ranking(scored(spark, sf_dir), TARGET, metrics.PROBABILITY))


KS_SELECT = """SELECT role, round(max(g), 6) AS ks, round(min(v) FILTER (g = mx), 2) AS ks_at_score FROM
   (SELECT *, max(g) OVER (PARTITION BY role) AS mx FROM
    (SELECT role, v, abs((bg + good)::DOUBLE / tg::DOUBLE - (bb + bad)::DOUBLE / tb::DOUBLE) AS g FROM {pre}) i) q GROUP BY role"""


@query("ks", f"{KNOWN_CTE}{ranking_cte('score')} {KS_SELECT.format(pre='pre')}")
def ks(spark, sf_dir):
    return metrics.ks(metrics.score_ranking(scored(spark, sf_dir), TARGET, metrics.SCORE))


CUTOFFS = [0.1, 0.2, 0.3, 0.5]


@query(
    "confusion_at_cutoff",
    f"""{KNOWN_CTE}, c AS (SELECT role, cutoff, count(*) FILTER (y = 1 AND p >= cutoff) AS tp, count(*) FILTER (y = 0 AND p >= cutoff) AS fp,
      count(*) FILTER (y = 1 AND p < cutoff) AS fn, count(*) FILTER (y = 0 AND p < cutoff) AS tn
      FROM known, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.5]) AS cutoff) u GROUP BY ALL),
    r AS (SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
      CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision,
      CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
      CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) ELSE 0 END AS specificity,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c)
    SELECT *, round(sqrt(recall * specificity), 6) AS g_mean FROM r""",
)
def confusion_at_cutoff(spark, sf_dir):
    return metrics.confusion_at(scored(spark, sf_dir), TARGET, CUTOFFS)


_DECILES = "[" + ", ".join(repr(k / 10) for k in range(1, 10)) + "]"
_CALIBRATION_CTE = f"""{KNOWN_CTE}, e AS (SELECT role, list_distinct(quantile_cont(p, {_DECILES})) AS b FROM known GROUP BY role),
    k AS (SELECT known.role, y, p, len(list_filter(b, lambda x: x < p)) AS cell FROM known JOIN e ON known.role = e.role),
    c AS (SELECT role, cell, count(*) AS count, round(avg(p), 6) AS avg_predicted_probability, round(avg(y), 6) AS actual_bad_rate
      FROM k GROUP BY ALL),
    cal AS (SELECT role, CAST(row_number() OVER (PARTITION BY role ORDER BY cell) - 1 AS INT) AS bin, count, avg_predicted_probability,
      actual_bad_rate FROM c)"""


@query("calibration_deciles", f"{_CALIBRATION_CTE} SELECT * FROM cal")
def calibration_deciles(spark, sf_dir):
    return metrics.calibration_deciles(scored_sample(spark, sf_dir), TARGET)


@query(
    "calibration_curve",
    f"{_CALIBRATION_CTE} SELECT role, bin, actual_bad_rate AS prob_true, avg_predicted_probability AS prob_pred FROM cal",
)
def calibration_curve(spark, sf_dir):
    return metrics.calibration_curve(scored_sample(spark, sf_dir), TARGET)


_HOSMER_LEMESHOW = f"""WITH RECURSIVE {KNOWN_CTE[5:]}{ranking_cte('p')},
    cum AS (SELECT role, v, n, bad, bn + n AS upto, n * v AS ex FROM pre),
    sz AS (SELECT role, sum(n) AS total, ceil(sum(n) / greatest(2, least(10, sum(n) // 5))) AS size FROM pre GROUP BY role),
    ends AS (SELECT role, 0 AS k, CAST(0 AS HUGEINT) AS pos FROM sz
      UNION ALL
      SELECT ends.role, ends.k + 1, (SELECT min(upto) FROM cum WHERE cum.role = ends.role AND upto >= least(ends.pos + sz.size, sz.total))
      FROM ends JOIN sz ON ends.role = sz.role WHERE ends.pos < sz.total),
    g AS (SELECT cum.role, (SELECT min(k) FROM ends WHERE ends.role = cum.role AND ends.pos >= cum.upto) AS grp,
      sum(n) AS n, sum(bad) AS ob, sum(ex) AS ex FROM cum GROUP BY ALL)"""
_HL_COLUMNS = """CAST(sum(n) AS BIGINT) AS known_count, count(*) AS n_bins,
      round(sum((ob - ex) * (ob - ex) / ex + (ob - ex) * (ob - ex) / (n - ex)), 4) AS statistic,
      CAST(greatest(1, count(*) - 2) AS INT) AS degrees_of_freedom,
      round(avg(round(abs(ob / n - ex / n), 6)), 6) AS calibration_error"""


@query("hosmer_lemeshow", f"{_HOSMER_LEMESHOW} SELECT role, {_HL_COLUMNS} FROM g GROUP BY role")
def hosmer_lemeshow(spark, sf_dir):
    return metrics.hosmer_lemeshow(scored(spark, sf_dir), TARGET).drop("p_value")


@query(
    "hosmer_lemeshow_p_value",
    # The chi-square tail has a closed form for even degrees of freedom; ten groups leave eight.
    f"""{_HOSMER_LEMESHOW}, h AS (SELECT role, {_HL_COLUMNS}, sum((ob - ex) * (ob - ex) / ex + (ob - ex) * (ob - ex) / (n - ex)) / 2 AS half FROM g GROUP BY role)
    SELECT role, known_count, n_bins, statistic, degrees_of_freedom, calibration_error,
      round(exp(-half) * list_sum(list_transform(range(degrees_of_freedom // 2), lambda k: pow(half, k) / factorial(CAST(k AS INT)))), 6) AS p_value FROM h""",
)
def hosmer_lemeshow_p_value(spark, sf_dir):
    return metrics.hosmer_lemeshow(scored(spark, sf_dir), TARGET)


@query(
    "score_distribution",
    f"""{KNOWN_CTE} SELECT role, round(avg(score), 2) AS mean, round(min(score), 2) AS min, round(max(score), 2) AS max,
    round(stddev_pop(score), 2) AS std, round(quantile_cont(score, 0.05), 2) AS p5, round(quantile_cont(score, 0.25), 2) AS p25,
    round(quantile_cont(score, 0.5), 2) AS median, round(quantile_cont(score, 0.75), 2) AS p75,
    round(quantile_cont(score, 0.95), 2) AS p95 FROM known GROUP BY role""",
)
def score_distribution(spark, sf_dir):
    return metrics.score_distribution(scored_sample(spark, sf_dir), TARGET)


PSI_CTE = f"""{KNOWN_CTE}, e AS (SELECT list_distinct(quantile_cont(score, {_DECILES})) AS b FROM known WHERE role = 'train'),
    k AS (SELECT role, len(list_filter(b, lambda x: x <= score)) AS cell FROM known, e),
    slots AS (SELECT role, total, unnest(range(0, CAST((SELECT len(b) + 1 FROM e) AS BIGINT))) AS cell
       FROM (SELECT role, count(*) AS total FROM known GROUP BY role) t),
    f AS (SELECT s.role, s.cell, total, count(k.role) AS n FROM slots s LEFT JOIN k ON k.role = s.role AND k.cell = s.cell GROUP BY ALL),
    pq AS (SELECT a.role, a.n AS an, t.n AS en, CASE WHEN a.n = 0 THEN 0.5 / a.total ELSE a.n / a.total END AS ap,
      CASE WHEN t.n = 0 THEN 0.5 / t.total ELSE t.n / t.total END AS ep
      FROM f a JOIN f t ON t.role = 'train' AND a.cell = t.cell WHERE a.role <> 'train'),
    psi AS (SELECT 'train' AS baseline, role, round(sum((ap - ep) * ln(ap / ep)), 6) AS psi,
      count(*) FILTER (an = 0 OR en = 0) AS empty_bins FROM pq GROUP BY role)"""


@query("psi", f"{PSI_CTE} SELECT * FROM psi")
def psi(spark, sf_dir):
    return metrics.psi(scored_sample(spark, sf_dir), TARGET)


_AVAILABILITY = """SELECT role, count(*) AS row_count, count(*) FILTER (outcome IN ('good', 'bad')) AS known_count,
    count(*) FILTER (outcome NOT IN ('good', 'bad')) AS unknown_count, count(*) FILTER (outcome = 'bad') AS bad_count,
    count(*) FILTER (outcome = 'good') AS good_count FROM scored GROUP BY role"""


@query(
    "target_availability",
    f"""{SCORED_CTE}, a AS ({_AVAILABILITY}) SELECT *, CASE WHEN known_count = 0 THEN 'NO_KNOWN_TARGET_VALUES'
    WHEN bad_count = 0 THEN 'SINGLE_CLASS_ONLY_GOOD' WHEN good_count = 0 THEN 'SINGLE_CLASS_ONLY_BAD'
    WHEN unknown_count > 0 THEN 'UNKNOWN_TARGET_VALUES' ELSE 'ok' END AS status FROM a""",
)
def target_availability(spark, sf_dir):
    return metrics.target_availability(scored(spark, sf_dir), TARGET)


@query(
    "validation_gates",
    f"""{PSI_CTE}{ranking_cte('p')}, a AS ({AUC_SELECT.format(pre='pre')})
    SELECT upper(role) || '_SAMPLE_PRESENT' AS gate, role, 'pass' AS status FROM a
    UNION ALL SELECT 'TARGET_AVAILABLE', role, 'pass' FROM a
    UNION ALL SELECT 'MINIMUM_AUC', role, CASE WHEN auc >= 0.62 THEN 'pass' ELSE 'fail' END FROM a
    UNION ALL SELECT 'MAXIMUM_PSI', role, CASE WHEN psi <= 0.1 THEN 'pass' ELSE 'fail' END FROM psi""",
)
def validation_gates(spark, sf_dir):
    sample = scored_sample(spark, sf_dir)
    return metrics.validation_gates(
        metrics.auc_gini(metrics.score_ranking(sample, TARGET, metrics.PROBABILITY)),
        metrics.psi(sample, TARGET),
        metrics.target_availability(sample, TARGET),
        min_auc=0.62,
        max_psi=0.1,
        require_oot=True,
    )


# --- strategy ---------------------------------------------------------------------


def bands_cte(breaks: str, source: str = "scored", name: str = "bands") -> str:
    return f""", {name}_b AS (SELECT role, lo, hi, {breaks} AS b FROM (SELECT role, min(score) AS lo, max(score) AS hi FROM {source} GROUP BY role) q),
    {name}_k AS (SELECT s.role, outcome, len(list_filter(b, lambda x: x < score)) AS band FROM {source} s JOIN {name}_b e ON s.role = e.role),
    {name}_s AS (SELECT role, b, unnest(range(0, len(b) + 1)) AS band FROM {name}_b),
    {name}_f AS (SELECT s.role, s.b, s.band, count(k.role) AS count, count(*) FILTER (outcome = 'bad') AS bad_count
      FROM {name}_s s LEFT JOIN {name}_k k ON k.role = s.role AND k.band = s.band GROUP BY ALL),
    {name}_t AS (SELECT *, sum(count) OVER (PARTITION BY role) AS n, sum(bad_count) OVER (PARTITION BY role) AS bads,
      coalesce(sum(count) OVER (PARTITION BY role ORDER BY band ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS n_above FROM {name}_f),
    {name} AS (SELECT role, CAST(band + 1 AS INT) AS band, CASE WHEN band > 0 THEN round(b[band], 2) END AS lower, round(b[band + 1], 2) AS upper,
      count, bad_count, round(1::DOUBLE - count / n, 4) AS approval_rate, round(n_above / n, 4) AS approval_above,
      CASE WHEN count > 0 THEN round(bad_count / count, 4) ELSE 0 END AS bad_rate, round(bad_count / bads, 4) AS capture_rate FROM {name}_t)"""


EQUAL_BANDS = "list_transform(range(1, 20), lambda i: lo + i * ((hi - lo) / 20))"


@query("cutoff_bands", f"{SCORED_CTE}{bands_cte(EQUAL_BANDS)} SELECT * FROM bands")
def cutoff_bands(spark, sf_dir):
    return strategy.cutoff_bands(scored_sample(spark, sf_dir), TARGET)


@query(
    "cutoff_bands_explicit",
    f"{SCORED_CTE}{bands_cte('[480::DOUBLE, 500, 520, 540, 560]')} SELECT * FROM bands",
)
def cutoff_bands_explicit(spark, sf_dir):
    return strategy.cutoff_bands(scored_sample(spark, sf_dir), TARGET, cutoffs=[480, 500, 520, 540, 560])


def _threshold_oracle(value: str) -> str:
    return f"""{KNOWN_CTE}, t AS (SELECT i, CASE WHEN i = 199 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 199) END AS threshold FROM range(0, 200) r(i)),
    m AS (SELECT role, i, threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
       count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM known, t GROUP BY ALL),
    r AS (SELECT *, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
       1.0::DOUBLE * fp + 10.0::DOUBLE * fn AS cost FROM m),
    s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
       sqrt(recall * specificity) AS g_mean, recall + specificity - 1 AS youden_j FROM r),
    b AS (SELECT *, {value} AS objective_value, row_number() OVER (PARTITION BY role ORDER BY {value} DESC, i) AS rk FROM s)
    SELECT role, round(objective_value, 6) AS objective_value, round(threshold, 6) AS threshold, round(recall, 6) AS recall,
      round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS f1, round(g_mean, 6) AS g_mean,
      round(cost, 6) AS cost, round(youden_j, 6) AS youden_j, role = 'test' AS selected FROM b WHERE rk = 1"""


@query("threshold_youden", _threshold_oracle("youden_j"))
def threshold_youden(spark, sf_dir):
    return strategy.optimise_threshold(scored(spark, sf_dir), TARGET, "youden")


@query("threshold_f1", _threshold_oracle("f1"))
def threshold_f1(spark, sf_dir):
    return strategy.optimise_threshold(scored(spark, sf_dir), TARGET, "max_f1")


@query("threshold_gmean", _threshold_oracle("g_mean"))
def threshold_gmean(spark, sf_dir):
    return strategy.optimise_threshold(scored(spark, sf_dir), TARGET, "max_g_mean")


@query("threshold_cost", _threshold_oracle("(-cost)"))
def threshold_cost(spark, sf_dir):
    return strategy.optimise_threshold(scored(spark, sf_dir), TARGET, "cost_minimize")


# --- fairness ----------------------------------------------------------------------

_GROUPS_CTE = f"""{SCORED_CTE}, g AS (SELECT role, segment AS "group", count(*) AS n,
      count(*) FILTER (predicted_bad_probability >= 0.22) AS rej, count(*) FILTER (outcome = 'bad') AS nb,
      count(*) FILTER (outcome = 'bad' AND predicted_bad_probability >= 0.22) AS tp,
      avg(score) AS m, quantile_cont(score, [0.25, 0.5, 0.75]) AS q FROM scored GROUP BY ALL),
    x AS (SELECT *, rej - tp AS fp, nb - tp AS fn, n - nb - (rej - tp) AS tn, n >= 2400 AS ok FROM g),
    groups AS (SELECT role, "group", n, CASE WHEN ok THEN 'ok' ELSE 'insufficient_evidence' END AS status,
      CASE WHEN ok THEN round(1::DOUBLE - rej / n, 4) END AS approval_rate, CASE WHEN ok THEN nb END AS n_bad,
      CASE WHEN ok THEN round(nb / n, 4) END AS bad_rate,
      CASE WHEN ok THEN CASE WHEN rej > 0 THEN round(tp / rej, 4) ELSE 0 END END AS precision,
      CASE WHEN ok THEN CASE WHEN nb > 0 THEN round(tp / nb, 4) ELSE 0 END END AS recall,
      CASE WHEN ok THEN CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 4) ELSE 0 END END AS specificity,
      CASE WHEN ok THEN CASE WHEN tn + fp > 0 THEN round(fp / (fp + tn), 4) ELSE 0 END END AS false_positive_rate,
      CASE WHEN ok THEN round(m, 2) END AS score_mean, CASE WHEN ok THEN round(q[2], 2) END AS score_median,
      CASE WHEN ok THEN round(q[1], 2) END AS score_p25, CASE WHEN ok THEN round(q[3], 2) END AS score_p75 FROM x)"""


def _groups(spark, sf_dir):
    return fairness.fairness_groups(scored_sample(spark, sf_dir), TARGET, "segment", cutoff=0.22, min_group=2400)


@query("fairness_groups", f"{_GROUPS_CTE} SELECT * FROM groups")
def fairness_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(
    "fairness_parity",
    f"""{_GROUPS_CTE} SELECT role, count(*) AS group_count, round(max(approval_rate) - min(approval_rate), 4) AS max_approval_rate_difference,
    round(max(bad_rate) - min(bad_rate), 4) AS max_bad_rate_difference,
    round(max(false_positive_rate) - min(false_positive_rate), 4) AS max_false_positive_rate_difference
    FROM groups WHERE status = 'ok' GROUP BY role HAVING count(*) >= 2""",
)
def fairness_parity(spark, sf_dir):
    return fairness.fairness_parity(_groups(spark, sf_dir))


@query(
    "proxy_risk",
    f"""{SCORED_CTE}, s AS (SELECT *, CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS builder FROM scored),
    c AS (SELECT round(abs(corr(builder, z)), 4) AS bz, round(abs(corr(builder, discount)), 4) AS bd, round(abs(corr(builder, quantity)), 4) AS bq,
      round(abs(corr(rejected, z)), 4) AS rz, round(abs(corr(rejected, discount)), 4) AS rd, round(abs(corr(rejected, quantity)), 4) AS rq FROM s),
    l AS (SELECT 'builder' AS sensitive_column, 'z' AS feature, bz AS correlation FROM c UNION ALL SELECT 'builder', 'discount', bd FROM c
      UNION ALL SELECT 'builder', 'quantity', bq FROM c UNION ALL SELECT 'rejected', 'z', rz FROM c
      UNION ALL SELECT 'rejected', 'discount', rd FROM c UNION ALL SELECT 'rejected', 'quantity', rq FROM c)
    SELECT *, correlation > 0.3 AS is_proxy, CASE WHEN bool_or(correlation > 0.3) OVER (PARTITION BY sensitive_column) THEN 'high'
      WHEN sensitive_column = 'rejected' THEN 'medium' ELSE 'low' END AS risk_level FROM l""",
)
def proxy_risk(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("builder", F.when(F.col("segment") == "BUILDING", 1).otherwise(0))
    return fairness.proxy_risk(
        df, ["builder", "rejected"], ["z", "discount", "quantity"], {"rejected": 0.2}, correlation_threshold=0.3
    )

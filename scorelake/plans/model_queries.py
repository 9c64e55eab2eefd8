"""WOE application, selection, scaling, scoring and comparison queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from scorelake.functions.state import stage, staging_path
from scorelake.operators import (
    binning, cluster, compare, corr, diagnostics, metrics, scaling, scoring, select, strategy, woe,
)
from scorelake.plans.binning_queries import BINS_CTE, FEATURES, fitted_bins, fitted_cells
from scorelake.plans.metric_queries import AUC_SELECT, KS_SELECT, bands_cte, ranking_cte, scored_sample
from scorelake.plans.newton_sql import eliminated
from scorelake.plans.registry import query
from scorelake.plans.views import CHALLENGER_CTE, NUMERIC, SCORED_CTE, TARGET, development, scored
from scorelake.sources.sqlgen import scoring_sql
from scorelake.sources.writers import export_scorecard

MODEL = {"quantity_woe": -0.9, "discount_woe": -0.8, "segment_woe": -1.1}
INTERCEPT = -1.36
MODEL_VARIABLES = ["quantity", "discount", "segment"]


def _match(variable: str, row: str, entry: str) -> str:
    """DuckDB join condition of a row's value to its bin."""
    x = f"{row}.{variable}"
    if variable in NUMERIC:
        return f"""{entry}.variable = '{variable}' AND (({x} IS NULL AND {entry}.is_missing) OR ({x} IS NOT NULL AND NOT {entry}.is_missing
          AND ({entry}.lower IS NULL OR {x} > {entry}.lower) AND ({entry}.upper IS NULL OR {x} <= {entry}.upper)))"""
    return f"""{entry}.variable = '{variable}' AND (({x} IS NULL AND {entry}.is_missing) OR {x} = {entry}.category
      OR ({entry}.is_other AND {x} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM woe o WHERE o.variable = '{variable}' AND o.category = {x})))"""


def with_woe(variables: list[str], source: str, name: str) -> str:
    columns = ", ".join(f"round(w_{v}.woe, 6) AS {v}_woe" for v in variables)
    joins = " ".join(f"LEFT JOIN woe w_{v} ON {_match(v, 's', f'w_{v}')}" for v in variables)
    return f", {name} AS (SELECT s.*, {columns} FROM {source} s {joins})"


# --- WOE columns -------------------------------------------------------------------


def _fitted(spark, sf_dir, columns=None):
    bins, cells = fitted_cells(spark, sf_dir, columns)
    return bins, woe.woe_table(cells)


@query(
    "woe_transform",
    f"{BINS_CTE}{with_woe(FEATURES, 'dev', 'x')} SELECT app_key, {', '.join(v + '_woe' for v in FEATURES)} FROM x",
)
def woe_transform(spark, sf_dir):
    dev = development(spark, sf_dir)
    bins = fitted_bins(spark, sf_dir, dev=dev)
    table = woe.woe_table(woe.woe_cells(dev, bins, TARGET))
    return woe.add_woe_columns(dev, bins, table).select("app_key", *[f"{v}_woe" for v in FEATURES])


@query(
    "apply_woe",
    f"{BINS_CTE}{with_woe(MODEL_VARIABLES, 'scored', 'x')} SELECT app_key, role, {', '.join(MODEL)} FROM x",
)
def apply_woe(spark, sf_dir):
    bins, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    return woe.apply_woe(scored(spark, sf_dir), bins, table, MODEL_VARIABLES).select("app_key", "role", *MODEL)





@query(
    "woe_unmatched",
    f"""{BINS_CTE} SELECT role, 'quantity' AS variable, count(*) AS row_count, count(*) FILTER (quantity IS NULL) AS unmatched_count
    FROM scored GROUP BY role UNION ALL SELECT role, 'segment', count(*), count(*) FILTER (segment IS NULL) FROM scored GROUP BY role""",
)
def woe_unmatched(spark, sf_dir):
    """Bins fitted without a missing bin leave null values unmatched."""
    dev = development(spark, sf_dir)
    params = binning.BinningParams(missing_policy="ignore")
    bins = binning.fit_bins(dev, TARGET, params, ["quantity", "segment"])
    table = woe.woe_table(woe.woe_cells(dev, bins, TARGET))
    raw = woe.add_woe_columns(scored(spark, sf_dir), bins, table)
    return woe.unmatched(raw, ["quantity_woe", "segment_woe"])


_RARE_CTE = f"""{BINS_CTE}, r AS (SELECT CASE WHEN discount >= 0.1 AND outcome = 'good' THEN 'only_good'
      WHEN discount < 0.005 AND outcome = 'bad' THEN 'only_bad' ELSE priority END AS priority, outcome FROM dev),
    rc AS (SELECT priority AS category, count(*) AS row_count, count(*) FILTER (outcome = 'good') AS good_count,
      count(*) FILTER (outcome = 'bad') AS bad_count FROM r GROUP BY 1),
    rs AS (SELECT rc.*, good_count = 0 OR bad_count = 0 AS zero_cell, count(*) OVER () AS nb, tg, tb FROM rc, tot),
    rd AS (SELECT *, CASE WHEN zero_cell THEN (good_count + 0.5) / (tg + 0.5 * nb) ELSE good_count / tg END AS gd,
      CASE WHEN zero_cell THEN (bad_count + 0.5) / (tb + 0.5 * nb) ELSE bad_count / tb END AS bd FROM rs)"""


@query(
    "woe_smoothed",
    f"""{_RARE_CTE} SELECT category AS label, row_count, good_count, bad_count, zero_cell, round(gd, 6) AS good_distribution,
    round(bd, 6) AS bad_distribution, round(ln(gd / bd), 6) AS woe, round((gd - bd) * ln(gd / bd), 6) AS iv_component FROM rd""",
)
def woe_smoothed(spark, sf_dir):
    """Levels that hold one class only, smoothed for a final WOE."""
    dev = development(spark, sf_dir).withColumn(
        "priority",
        F.when((F.col("discount") >= 0.1) & (F.col("outcome") == "good"), F.lit("only_good"))
        .when((F.col("discount") < 0.005) & (F.col("outcome") == "bad"), F.lit("only_bad"))
        .otherwise(F.col("priority")),
    )
    bins = binning.fit_bins(dev, TARGET, columns=["priority"])
    params = woe.WoeParams(alpha=0.5, rationale="one-class levels", purpose="final")
    cells = woe.woe_cells(dev, bins, TARGET, params)
    table = woe.woe_table(cells).drop("variable", "bin_id")
    return table.join(cells.select("label", "zero_cell"), "label")


_STEP = """(SELECT variable, count(*) AS nb, coalesce(min(d) >= 0, TRUE) OR coalesce(max(d) <= 0, TRUE) AS mono FROM
   (SELECT variable, round(woe, 6) - lag(round(woe, 6)) OVER (PARTITION BY variable ORDER BY bin_order) AS d FROM woe) q GROUP BY variable)"""


@query(
    "iv_monotonic",
    f"""{BINS_CTE} SELECT iv.variable, CASE WHEN s.nb >= 3 AND NOT mono THEN 0 ELSE iv END AS iv, bin_count,
    CASE WHEN s.nb >= 3 AND NOT mono THEN 'REJECTED' ELSE 'included' END AS status FROM iv JOIN {_STEP} s ON iv.variable = s.variable""",
)
def iv_monotonic(spark, sf_dir):
    bins, cells = fitted_cells(spark, sf_dir)
    return woe.iv_monotonic(cells, bins)


@query(
    "bin_summary",
    f"""{BINS_CTE} SELECT woe.variable, round(sum(round(iv_component, 6)), 6) AS iv, count(*) AS n_bins,
      round(coalesce(sum(row_count) FILTER (is_missing), 0) / sum(row_count), 6) AS missing_rate,
      min(row_count) FILTER (NOT is_missing) AS min_bin_count,
      round(max(row_count) FILTER (NOT is_missing) / sum(row_count), 6) AS max_bin_pct,
      any_value(mono) AS monotonic FROM woe JOIN (SELECT variable, coalesce(min(d) >= 0, TRUE) OR coalesce(max(d) <= 0, TRUE) AS mono FROM
       (SELECT variable, round(woe, 6) - lag(round(woe, 6)) OVER (PARTITION BY variable ORDER BY bin_order) AS d FROM woe WHERE NOT is_missing) q
       GROUP BY variable) m ON woe.variable = m.variable GROUP BY woe.variable""",
)
def bin_summary(spark, sf_dir):
    bins, table = _fitted(spark, sf_dir)
    return binning.bin_summary(table, bins)


@query(
    "bin_diagnostics",
    f"""{BINS_CTE} SELECT woe.variable, count(*) AS bin_count, count(*) < 2 AS too_few_bins, count(*) FILTER (row_count < 1200) AS sparse_bins,
      count(*) FILTER (good_count > 0 AND bad_count = 0) AS pure_good_bins, count(*) FILTER (bad_count > 0 AND good_count = 0) AS pure_bad_bins,
      CASE WHEN count(*) < 3 THEN 'insufficient_bins' WHEN any_value(mono) THEN 'monotonic' ELSE 'non_monotonic' END AS monotonic_status
    FROM woe JOIN {_STEP} s ON woe.variable = s.variable GROUP BY woe.variable""",
)
def bin_diagnostics(spark, sf_dir):
    bins, table = _fitted(spark, sf_dir)
    return binning.bin_diagnostics(table, bins, min_rows=1200)


@query(
    "bin_preview",
    f"""{BINS_CTE}, t AS (SELECT variable, sum(good_count) AS g, sum(bad_count) AS b FROM bins GROUP BY variable)
    SELECT bins.variable, bin_id, CAST(bin_order AS INT) AS bin_order, row_count, round(bad_count / row_count, 6) AS event_rate,
      round(CASE WHEN good_count = 0 THEN -10 WHEN bad_count = 0 THEN 10 ELSE ln((bad_count / b) / (good_count / g)) END, 6) AS woe
    FROM bins JOIN t ON bins.variable = t.variable""",
)
def bin_preview(spark, sf_dir):
    return binning.bin_preview(fitted_bins(spark, sf_dir))


MERGES = [
    binning.BinOverride("discount", "merge_bins", "thin steps", ("discount_bin_001", "discount_bin_002", "discount_bin_003")),
    binning.BinOverride("tax", "reject_variable", "not available at decision time"),
    binning.BinOverride("quantity", "reorder_missing_bin", "show last", position="last"),
]


@query(
    "bins_merge",
    f"""{BINS_CTE}, e AS (SELECT *, CASE WHEN bin_id IN ('discount_bin_002', 'discount_bin_003') THEN 'discount_bin_001' ELSE bin_id END AS nid
      FROM bins WHERE kind = 'numeric' AND variable <> 'tax'),
    m AS (SELECT variable, nid AS bin_id, min(bin_order) AS bo, arg_min(coalesce(lower, -1e300), bin_order) AS lo,
      arg_max(coalesce(upper, 1e300), bin_order) AS hi, bool_or(is_missing) AS is_missing, CAST(sum(row_count) AS BIGINT) AS row_count,
      CAST(sum(good_count) AS BIGINT) AS good_count, CAST(sum(bad_count) AS BIGINT) AS bad_count FROM e GROUP BY ALL)
    SELECT variable, bin_id, CAST(row_number() OVER (PARTITION BY variable ORDER BY CASE WHEN variable = 'quantity' AND is_missing THEN 1000 ELSE bo END) AS INT) AS bin_order,
      CASE WHEN lo > -1e300 THEN round(lo, 6) END AS lower, CASE WHEN hi < 1e300 THEN round(hi, 6) END AS upper, row_count, good_count, bad_count FROM m""",
)
def bins_merge(spark, sf_dir):
    edited = binning.apply_overrides(fitted_bins(spark, sf_dir, NUMERIC), MERGES)
    return edited.select(
        "variable", "bin_id", "bin_order", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
        "row_count", "good_count", "bad_count",
    )


@query(
    "bins_group",
    f"""{BINS_CTE}, e AS (SELECT *, CASE WHEN bin_id IN ('segment_bin_001', 'segment_bin_003') THEN 'segment_mixed' ELSE bin_id END AS nid
      FROM bins WHERE variable = 'segment')
    SELECT variable, nid AS bin_id, string_agg(category, ',' ORDER BY category) AS categories, CAST(sum(row_count) AS BIGINT) AS row_count,
      CAST(sum(good_count) AS BIGINT) AS good_count, CAST(sum(bad_count) AS BIGINT) AS bad_count FROM e GROUP BY ALL""",
)
def bins_group(spark, sf_dir):
    edit = binning.BinOverride(
        "segment", "group_categories", "similar risk", ("segment_bin_001", "segment_bin_003"), "segment_mixed", "Mixed"
    )
    edited = binning.apply_overrides(fitted_bins(spark, sf_dir, ["segment"]), [edit])
    return edited.select(
        "variable", "bin_id", F.concat_ws(",", "categories").alias("categories"), "row_count", "good_count", "bad_count"
    ).withColumn("categories", F.when(F.col("categories") != "", F.col("categories")))


# --- correlation and selection ---------------------------------------------------------

CORRELATED = ["quantity", "price", "discount", "tax", "balance"]


def _with_gross(df):
    return df.withColumn("gross", F.col("price") * (F.lit(1.0) + F.col("tax"))).withColumn(
        "net", F.col("price") * (F.lit(1.0) - F.col("discount"))
    )


_GROSS = "SELECT *, price * (1.0::DOUBLE + tax) AS gross, price * (1.0::DOUBLE - discount) AS net FROM"
_CORR_COLUMNS = CORRELATED + ["gross", "net"]


def _corr_oracle(columns, source="wide", null_free=False):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, corr({a}, {b}) AS corr, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


_CORR_CTE = f"{SCORED_CTE}, wide AS ({_GROSS} scored), cm AS ({_corr_oracle(_CORR_COLUMNS)})"


@query("corr_matrix", f"{_CORR_CTE} SELECT variable_a, variable_b, round(corr, 6) AS corr, n, CASE WHEN n < 30 THEN 'LOW_PAIR_COUNT' END AS warning FROM cm")
def corr_matrix(spark, sf_dir):
    table = corr.correlation_matrix(_with_gross(scored(spark, sf_dir)), _CORR_COLUMNS)
    return table.withColumn("corr", F.round("corr", 6))


@query(
    "corr_products",
    f"{_CORR_CTE} SELECT variable_a, variable_b, round(corr, 6) AS corr, n FROM cm",
)
def corr_products(spark, sf_dir):
    """The cross products themselves, before names and warnings are put on."""
    table = corr._pearson(_with_gross(scored(spark, sf_dir)), _CORR_COLUMNS)
    names = F.array(*[F.lit(c) for c in _CORR_COLUMNS])
    return table.select(
        F.get(names, F.col("i")).alias("variable_a"), F.get(names, F.col("j")).alias("variable_b"),
        F.round("corr", 6).alias("corr"), "n",
    )


def _rank(c, where=""):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@query(
    "corr_spearman",
    f"""{SCORED_CTE}, cc AS (SELECT price, discount, balance FROM scored),
    r AS (SELECT {_rank('price')} AS price, {_rank('discount')} AS discount, {_rank('balance')} AS balance FROM cc),
    qd AS (SELECT {_rank('quantity')} AS a, {_rank('discount')} AS b FROM scored WHERE quantity IS NOT NULL),
    qp AS (SELECT {_rank('quantity')} AS a, {_rank('price')} AS b FROM scored WHERE quantity IS NOT NULL),
    qb AS (SELECT {_rank('quantity')} AS a, {_rank('balance')} AS b FROM scored WHERE quantity IS NOT NULL)
    SELECT 'price' AS variable_a, 'discount' AS variable_b, round(corr(price, discount), 6) AS corr, count(*) AS n FROM r
    UNION ALL SELECT 'price', 'balance', round(corr(price, balance), 6), count(*) FROM r
    UNION ALL SELECT 'discount', 'balance', round(corr(discount, balance), 6), count(*) FROM r
    UNION ALL SELECT 'quantity', 'discount', round(corr(a, b), 6), count(*) FROM qd
    UNION ALL SELECT 'quantity', 'price', round(corr(a, b), 6), count(*) FROM qp
    UNION ALL SELECT 'quantity', 'balance', round(corr(a, b), 6), count(*) FROM qb""",
)
def corr_spearman(spark, sf_dir):
    sample = stage(scored(spark, sf_dir).select("quantity", "price", "discount", "balance"))
    table = corr.correlation_matrix(sample, ["quantity", "price", "discount", "balance"], method="spearman")
    return table.withColumn("corr", F.round("corr", 6)).drop("warning")


_IV_CTE = BINS_CTE


def _cluster_stats(spark, sf_dir, sample):
    """IV of the binned numeric features; derived ones take no IV."""
    bins, cells = fitted_cells(spark, sf_dir, CORRELATED)
    missing = sample.agg(
        *[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in CORRELATED]
    ).select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing_rate")) for c in CORRELATED])))
    return woe.iv_table(cells).select("variable", "iv").join(missing, "variable")


_STATS = "SELECT variable, iv, CASE WHEN variable = 'quantity' THEN (SELECT round(avg(CASE WHEN quantity IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM scored) ELSE 0 END AS missing_rate FROM iv"


_WIDE_CTE = f"""{BINS_CTE.replace('WITH apps', 'WITH RECURSIVE apps')}, wide AS ({_GROSS} scored), cm AS ({_corr_oracle(_CORR_COLUMNS)}),
    v AS (SELECT unnest({_CORR_COLUMNS!r}) AS variable, unnest(range(0, {len(_CORR_COLUMNS)})) AS pos)"""
# Members, representatives and the largest correlation of clusters given as lab (variable, root).
_MEMBERS_SQL = f"""st AS ({_STATS}),
    mm AS (SELECT lab.variable, root, pos, iv, missing_rate, count(*) OVER (PARTITION BY root) AS size, dense_rank() OVER (ORDER BY root) AS num,
      row_number() OVER (PARTITION BY root ORDER BY RULE) AS rk
      FROM lab JOIN v ON lab.variable = v.variable LEFT JOIN st ON lab.variable = st.variable),
    mx AS (SELECT a.root, max(CORR) AS mc FROM cm JOIN lab a ON variable_a = a.variable JOIN lab b ON variable_b = b.variable WHERE a.root = b.root GROUP BY 1)
    SELECT CASE WHEN size > 1 THEN 'cluster_' || lpad(CAST(num AS VARCHAR), 3, '0') END AS cluster_id, variable, iv, missing_rate,
      size > 1 AND rk = 1 AS is_representative, CASE WHEN size > 1 THEN round(greatest(mc, 0), 4) END AS max_pairwise_corr
    FROM mm LEFT JOIN mx ON mm.root = mx.root"""
_HIGHEST_IV, _LOWEST_MISSING = "coalesce(iv, 0) DESC, pos", "coalesce(missing_rate, 'inf'::DOUBLE), pos"


def _merging_sql(cut: float, linkage: str, rule: str) -> str:
    """The closest two clusters merge, step by step, over lists of labels."""
    return f"""{_WIDE_CTE},
    pairs AS (SELECT a.pos + 1 AS i, b.pos + 1 AS j, 1 - abs(corr) AS d FROM cm JOIN v a ON a.variable = variable_a JOIN v b ON b.variable = variable_b),
    state AS (
      SELECT 0 AS step, range(0, {len(_CORR_COLUMNS)}) AS labels
      UNION ALL
      SELECT step + 1, list_transform(labels, lambda l: CASE WHEN l = hi THEN lo ELSE l END) FROM (
        SELECT step, any_value(labels) AS labels, least(labels[i], labels[j]) AS lo, greatest(labels[i], labels[j]) AS hi, {linkage}(d) AS d,
          row_number() OVER (PARTITION BY step ORDER BY {linkage}(d), lo, hi) AS place
        FROM state, pairs WHERE labels[i] <> labels[j] GROUP BY step, lo, hi) m WHERE place = 1 AND d <= {cut}),
    lab AS (SELECT variable, min(pos) OVER (PARTITION BY label) AS root FROM
      (SELECT variable, pos, (SELECT arg_max(labels, step) FROM state)[pos + 1] AS label FROM v) q),
    {_MEMBERS_SQL.replace("RULE", rule).replace("CORR", "abs(corr)")}"""


@query(
    "cluster_threshold",
    f"""{_WIDE_CTE},
    ed AS (SELECT variable_a AS a, variable_b AS b FROM cm WHERE corr >= 0.9 UNION ALL SELECT variable_b, variable_a FROM cm WHERE corr >= 0.9),
    reach AS (SELECT variable AS src, variable AS dst FROM v UNION SELECT src, b FROM reach JOIN ed ON dst = a),
    lab AS (SELECT src AS variable, min(pos) AS root FROM reach JOIN v ON dst = v.variable GROUP BY 1),
    {_MEMBERS_SQL.replace("RULE", _HIGHEST_IV).replace("CORR", "corr")}""",
)
def cluster_threshold(spark, sf_dir):
    sample = stage(scored(spark, sf_dir).select(*CORRELATED))
    table = corr.correlation_matrix(_with_gross(sample), _CORR_COLUMNS)
    return cluster.threshold_clusters(table, _CORR_COLUMNS, _cluster_stats(spark, sf_dir, sample), 0.9)


@query("cluster_hierarchical", _merging_sql(0.5, "avg", _HIGHEST_IV))
def cluster_hierarchical(spark, sf_dir):
    sample = stage(scored(spark, sf_dir).select(*CORRELATED))
    table = corr.correlation_matrix(_with_gross(sample), _CORR_COLUMNS, absolute=True)
    return cluster.hierarchical_clusters(table, _CORR_COLUMNS, _cluster_stats(spark, sf_dir, sample), cut=0.5)


@query("cluster_complete", _merging_sql(0.9995, "max", _LOWEST_MISSING))
def cluster_complete(spark, sf_dir):
    sample = stage(scored(spark, sf_dir).select(*CORRELATED))
    table = corr.correlation_matrix(_with_gross(sample), _CORR_COLUMNS, absolute=True)
    stats = _cluster_stats(spark, sf_dir, sample)
    return cluster.hierarchical_clusters(table, _CORR_COLUMNS, stats, cut=0.9995, linkage="complete", rule="lowest_missing")


@query(
    "cluster_candidates",
    f"{BINS_CTE} SELECT variable, CAST(row_number() OVER (ORDER BY iv DESC, variable) AS INT) AS position FROM iv",
)
def cluster_candidates(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir)
    iv = woe.iv_table(cells)
    chosen = cluster.candidates(iv, FEATURES)
    order = F.array(*[F.lit(c) for c in chosen])
    return iv.filter(F.col("variable").isin(*chosen)).select(
        "variable", F.array_position(order, F.col("variable")).cast("int").alias("position")
    )


SELECTION = select.SelectionParams(
    min_iv=0.002, max_variables=3, includes={"balance": "policy"}, excludes={"segment": "not allowed"}
)


@query(
    "select_variables",
    f"""{BINS_CTE}, a AS (SELECT variable, iv, variable <> 'segment' AND (variable = 'balance' OR iv >= 0.002) AS ok FROM iv),
    c AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY iv DESC, variable ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM a)
    SELECT variable, iv, CASE WHEN ok AND earlier < 3 THEN 'selected' ELSE 'rejected' END AS decision,
      CASE WHEN variable = 'segment' THEN 'not allowed' WHEN earlier >= 3 THEN 'Reached max_variables limit (3)'
        WHEN variable = 'balance' THEN 'policy' WHEN ok THEN printf('IV %.4f above threshold 0.002', iv)
        ELSE printf('IV %.4f below threshold 0.002', iv) END AS reason FROM c""",
)
def select_variables(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir)
    return select.select_variables(woe.iv_table(cells), SELECTION)


# Two clusters: (quantity, price) correlate; discount stands with tax by declaration.
_CLUSTERS = [("cluster_001", "quantity", 0.02), ("cluster_001", "price", 0.0), ("cluster_002", "discount", 0.0), ("cluster_002", "tax", 0.0)]


@query(
    "select_by_cluster",
    f"""{BINS_CTE}, cl(cluster_id, variable) AS (VALUES ('cluster_001', 'quantity'), ('cluster_001', 'price'), ('cluster_002', 'discount'), ('cluster_002', 'tax')),
    j AS (SELECT iv.variable, iv, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY iv DESC, iv.variable) AS rk FROM iv LEFT JOIN cl ON iv.variable = cl.variable),
    f AS (SELECT *, cluster_id IS NOT NULL AND rk = 1 AS rep, cluster_id IS NOT NULL AND rk > 1 AS skipped FROM j),
    a AS (SELECT *, rep OR (NOT skipped AND iv >= 0.002) AS ok FROM f),
    c AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY rep DESC, CASE WHEN rep THEN cluster_id END, iv DESC, variable
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM a)
    SELECT variable, iv, CASE WHEN ok AND earlier < 3 THEN 'selected' ELSE 'rejected' END AS decision,
      CASE WHEN skipped THEN 'Not the representative of ' || cluster_id WHEN ok AND earlier >= 3 THEN 'Reached max_variables limit (3)'
       WHEN rep THEN printf('highest IV (%.4f) in cluster', iv) WHEN ok THEN printf('IV %.4f above threshold 0.002', iv)
       ELSE printf('IV %.4f below threshold 0.002', iv) END AS reason FROM c""",
)
def select_by_cluster(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir)
    clusters = spark.createDataFrame(_CLUSTERS, "cluster_id string, variable string, missing_rate double")
    params = select.SelectionParams(min_iv=0.002, max_variables=3, cluster_rule="highest_iv")
    return select.select_variables(woe.iv_table(cells), params, clusters)


@query(
    "select_filter",
    f"""{BINS_CTE}, wide AS (SELECT *, price * (1.0::DOUBLE + tax) AS gross, 1.0::DOUBLE AS flat, CASE WHEN tax > 0.06 THEN tax END AS sparse FROM dev),
    s(variable, missing, variance) AS (
      SELECT 'quantity', (count(*) - count(quantity)) / count(*), var_samp(quantity) FROM wide UNION ALL
      SELECT 'price', 0, var_samp(price) FROM wide UNION ALL SELECT 'discount', 0, var_samp(discount) FROM wide UNION ALL
      SELECT 'tax', 0, var_samp(tax) FROM wide UNION ALL SELECT 'balance', 0, var_samp(balance) FROM wide UNION ALL
      SELECT 'flat', 0, 0 FROM wide UNION ALL SELECT 'sparse', (count(*) - count(sparse)) / count(*), var_samp(sparse) FROM wide),
    d AS (SELECT DISTINCT s.variable, missing, variance, coalesce(iv, 0) AS iv FROM s LEFT JOIN iv ON s.variable = iv.variable),
    o AS (SELECT variable, CASE WHEN missing > 0.5 THEN 'missingness' WHEN variance < 1e-6 THEN 'variance' WHEN iv < 0.0005 THEN 'iv' END AS method, missing, variance, iv FROM d),
    left_ AS (SELECT variable, iv, row_number() OVER (ORDER BY iv DESC) AS rk FROM o WHERE method IS NULL)
    SELECT o.variable, CASE WHEN method IS NULL AND rk <= 3 THEN 'selected' ELSE 'rejected' END AS decision,
      CASE WHEN method IS NOT NULL THEN method WHEN rk <= 3 THEN 'filter' ELSE 'max_features' END AS method,
      CASE method WHEN 'missingness' THEN round(missing, 6) WHEN 'variance' THEN round(variance, 6) ELSE o.iv END AS score
    FROM o LEFT JOIN left_ ON o.variable = left_.variable""",
)
def select_filter(spark, sf_dir):
    dev = development(spark, sf_dir)
    _, cells = fitted_cells(spark, sf_dir, CORRELATED)
    wide = dev.withColumns({"flat": F.lit(1.0), "sparse": F.when(F.col("tax") > 0.06, F.col("tax"))})
    params = select.FilterParams(min_iv=0.0005, max_correlation=0.999, max_features=3)
    return select.select_by_filters(wide, CORRELATED + ["flat", "sparse"], woe.iv_table(cells), params)


_FILTERED = ["gross", "net", *CORRELATED]


@query(
    "select_filter_correlated",
    f"""{_WIDE_CTE}, f AS (SELECT unnest({_FILTERED!r}) AS variable, unnest(range(0, {len(_FILTERED)})) AS place),
    fi AS (SELECT f.variable, place, iv FROM f LEFT JOIN iv ON iv.variable = f.variable),
    pr AS (SELECT row_number() OVER (ORDER BY a.place, b.place) AS idx, a.variable AS a, b.variable AS b,
      CASE WHEN coalesce(a.iv, 0) >= coalesce(b.iv, 0) THEN b.variable ELSE a.variable END AS loser,
      EXISTS (SELECT 1 FROM cm WHERE abs(corr) > 0.9 AND variable_a IN (a.variable, b.variable) AND variable_b IN (a.variable, b.variable) AND variable_a <> variable_b) AS close
      FROM fi a JOIN fi b ON a.place < b.place),
    walk AS (SELECT CAST(0 AS BIGINT) AS idx, CAST([] AS VARCHAR[]) AS gone UNION ALL
      SELECT pr.idx, CASE WHEN close AND NOT list_contains(gone, a) AND NOT list_contains(gone, b) THEN list_append(gone, loser) ELSE gone END
      FROM walk JOIN pr ON pr.idx = walk.idx + 1),
    done AS (SELECT gone FROM walk ORDER BY idx DESC LIMIT 1)
    SELECT variable, CASE WHEN list_contains(gone, variable) THEN 'rejected' ELSE 'selected' END AS decision,
      CASE WHEN list_contains(gone, variable) THEN 'correlation' ELSE 'filter' END AS method,
      CASE WHEN list_contains(gone, variable) THEN 1.0::DOUBLE ELSE iv END AS score FROM fi, done""",
)
def select_filter_correlated(spark, sf_dir):
    """Derived amounts that correlate with the price; the walk over close pairs decides."""
    _, cells = fitted_cells(spark, sf_dir, CORRELATED)
    params = select.FilterParams(min_iv=0.0, max_correlation=0.9)
    return select.select_by_filters(_with_gross(scored(spark, sf_dir)), _FILTERED, woe.iv_table(cells), params)


# --- model tables on fixed coefficients ---------------------------------------------------


def _coefficients(df):
    return scaling.coefficients_table(df, INTERCEPT, MODEL)


SCALING = scaling.Scaling(600, "50:1", 20)
_FACTOR = "(20::DOUBLE / ln(2))"
_OFFSET = f"(600::DOUBLE - {_FACTOR} * ln(50))"
_SLOPES = "(VALUES ('quantity', -0.9::DOUBLE), ('discount', -0.8), ('segment', -1.1)) AS sl(variable, coefficient)"
_CARD = f"""card AS (SELECT woe.variable, bin_id, round(woe, 6) AS woe, coefficient, round(-1::DOUBLE * {_FACTOR} * coefficient * round(woe, 6), 2) AS points,
   is_missing, is_other, category, lower, upper, bin_order FROM woe JOIN {_SLOPES} ON woe.variable = sl.variable)"""
_BASE = f"round({_OFFSET} - {_FACTOR} * -1.36, 2)"


@query("scorecard_points", f"{BINS_CTE}, {_CARD} SELECT variable, bin_id, woe, coefficient, points FROM card")
def scorecard_points(spark, sf_dir):
    _, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    return scaling.scorecard(table, _coefficients(table), SCALING).drop("label")


@query(
    "scorecard_table",
    f"""{BINS_CTE}, {_CARD} SELECT variable, bin_id, points, round({_FACTOR}, 6) AS factor, round({_OFFSET}, 6) AS "offset", {_BASE} AS base_points FROM card""",
)
def scorecard_table(spark, sf_dir):
    """The exported points table, read back from CSV with its scaling constants."""
    _, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    coefficients = _coefficients(table)
    path = staging_path(spark)
    export_scorecard(scaling.scorecard(table, coefficients, SCALING), path)
    rows = spark.read.csv(path, header=True, schema="variable string, bin_id string, label string, woe double, coefficient double, points double")
    constants = scaling.scaling_constants(coefficients, SCALING).first()
    return rows.select(
        "variable", "bin_id", "points", *[F.lit(constants[c]).alias(c) for c in ("factor", "offset", "base_points")]
    )


_SCORED_MODEL = f"""{BINS_CTE}{with_woe(MODEL_VARIABLES, 'scored', 'x')},
  m AS (SELECT app_key, role, outcome, -1.36::DOUBLE + quantity_woe * -0.9::DOUBLE + discount_woe * -0.8::DOUBLE + segment_woe * -1.1::DOUBLE AS raw FROM x),
  out AS (SELECT app_key, role, outcome, raw, 1.0::DOUBLE / (1.0::DOUBLE + exp(-raw)) AS p, {_OFFSET} - {_FACTOR} * raw AS score FROM m)"""
_SCORED_SELECT = "SELECT app_key, role, round(raw, 8) AS raw_model_output, round(p, 6) AS predicted_bad_probability, round(score, 4) AS score FROM out"


def _model_scored(spark, sf_dir):
    bins, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    sample = scored(spark, sf_dir).drop("predicted_bad_probability", "score")
    return scoring.apply_logistic(woe.apply_woe(sample, bins, table), _coefficients(table), SCALING)


def _rounded_scores(df):
    return df.select(
        "app_key", "role", F.round("raw_model_output", 8).alias("raw_model_output"),
        F.round("predicted_bad_probability", 6).alias("predicted_bad_probability"), F.round("score", 4).alias("score"),
    )


@query("score_logit", f"{_SCORED_MODEL} {_SCORED_SELECT}")
def score_logit(spark, sf_dir):
    return _rounded_scores(_model_scored(spark, sf_dir))


@query("score_sql", f"{_SCORED_MODEL} {_SCORED_SELECT}")
def score_sql(spark, sf_dir):
    """The generated statement run over the scored view."""
    bins, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    text = scoring_sql(bins, table, _coefficients(table), "{sample}", ["app_key", "role"], SCALING)
    return _rounded_scores(spark.sql(text, sample=scored(spark, sf_dir)))


@query(
    "score_points",
    f"""{BINS_CTE}{with_woe(MODEL_VARIABLES, 'scored', 'x')}
    SELECT app_key, round({_BASE} + round(-1::DOUBLE * {_FACTOR} * -0.9::DOUBLE * quantity_woe, 2) + round(-1::DOUBLE * {_FACTOR} * -0.8::DOUBLE * discount_woe, 2)
      + round(-1::DOUBLE * {_FACTOR} * -1.1::DOUBLE * segment_woe, 2), 2) AS total_points FROM x""",
)
def score_points(spark, sf_dir):
    bins, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    coefficients = _coefficients(table)
    card = scaling.scorecard(table, coefficients, SCALING)
    base = scaling.scaling_constants(coefficients, SCALING).first().base_points
    pointed = scoring.add_points(scored(spark, sf_dir), bins, card, base)
    return pointed.select("app_key", F.round("total_points", 2).alias("total_points"))


@query(
    "score_summary",
    f"""{_SCORED_MODEL} SELECT role, count(*) AS row_count, round(min(p), 6) AS min_probability, round(max(p), 6) AS max_probability,
    round(avg(p), 6) AS mean_probability, round(min(score), 2) AS min_score, round(max(score), 2) AS max_score, round(avg(score), 2) AS mean_score
    FROM out GROUP BY role""",
)
def score_summary(spark, sf_dir):
    return scoring.score_summary(_model_scored(spark, sf_dir))


# --- checks on coefficients estimated from the data ------------------------------------------


def _slopes(woe_frame, features):
    """Least-squares slope of the bad flag on each WOE column: a coefficient table in one pass."""
    y = F.when(F.col("outcome") == "bad", F.lit(1.0)).otherwise(F.lit(0.0))
    row = woe_frame.agg(*[F.round(F.regr_slope(y, F.col(f)), 6).alias(f) for f in features])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("coefficient")) for f in features])))


def _slope_oracle(features, source="x"):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(regr_slope(CASE WHEN outcome = 'bad' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, {f}), 6) AS coefficient FROM {source}"
        for f in features
    )


_WOE_FEATURES = [f"{v}_woe" for v in FEATURES]
_SLOPES_CTE = f"{BINS_CTE}{with_woe(FEATURES, 'dev', 'x')}, cf AS ({_slope_oracle(_WOE_FEATURES)})"


def _woe_frame(spark, sf_dir, columns=None):
    dev = development(spark, sf_dir)
    bins = fitted_bins(spark, sf_dir, columns, dev)
    table = woe.woe_table(woe.woe_cells(dev, bins, TARGET))
    return woe.add_woe_columns(dev, bins, table), table


@query(
    "coef_sign",
    f"""{_SLOPES_CTE} SELECT feature, coefficient, CASE WHEN coefficient > 0 THEN 'positive' WHEN coefficient < 0 THEN 'negative' ELSE 'zero' END AS sign,
    CASE WHEN coefficient > 0 THEN 'warning' WHEN coefficient = 0 THEN 'neutral' ELSE 'pass' END AS status FROM cf""",
)
def coef_sign(spark, sf_dir):
    frame, _ = _woe_frame(spark, sf_dir)
    return diagnostics.coefficient_signs(_slopes(frame, _WOE_FEATURES))


@query(
    "separation",
    f"""{_SLOPES_CTE} SELECT feature, abs(coefficient) AS abs_coefficient, CASE WHEN isinf(coefficient) THEN 'fail'
    WHEN abs(coefficient) > 0.16 THEN 'warning' ELSE 'pass' END AS status FROM cf""",
)
def separation(spark, sf_dir):
    frame, _ = _woe_frame(spark, sf_dir)
    return diagnostics.separation(_slopes(frame, _WOE_FEATURES), limit=0.16)


@query(
    "vif",
    f"""{BINS_CTE}{with_woe(['quantity', 'price'], 'dev', 'x')}, r AS (SELECT corr(quantity_woe, price_woe) AS c FROM x),
    v AS (SELECT 1 / (1 - c * c) AS vif FROM r)
    SELECT feature, round(vif, 6) AS vif, round(1 - 1 / vif, 6) AS r_squared, CASE WHEN vif < 10 THEN 'pass' ELSE 'warning' END AS status
    FROM v, (VALUES ('quantity_woe'), ('price_woe')) f(feature)""",
)
def vif(spark, sf_dir):
    frame, _ = _woe_frame(spark, sf_dir, ["quantity", "price"])
    return diagnostics.vif(frame, ["quantity_woe", "price_woe"])


@query(
    "vif_all",
    f"""{BINS_CTE}{with_woe(FEATURES, 'dev', 'x')}, names AS (SELECT unnest({_WOE_FEATURES!r}) AS feature, unnest(range(1, {len(FEATURES) + 1})) AS i),
    long AS (SELECT r, i, v FROM (SELECT row_number() OVER () AS r, [{", ".join(_WOE_FEATURES)}] AS l FROM x) q, LATERAL (SELECT unnest(range(1, {len(FEATURES) + 1})) AS i, unnest(l) AS v)),
    pairs AS (SELECT a.i, b.i AS j, corr(a.v, b.v) AS c FROM long a JOIN long b ON a.r = b.r GROUP BY ALL),
    lines AS (SELECT i, list(c ORDER BY j) || list_transform(range(1, {len(FEATURES) + 1}), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0 END) AS line FROM pairs GROUP BY i),
    solved AS (SELECT {eliminated("list(line ORDER BY i)", len(FEATURES))} AS m FROM lines),
    v AS (SELECT feature, m[i][{len(FEATURES)} + i] AS vif FROM names, solved)
    SELECT feature, round(vif, 6) AS vif, round(1 - 1 / vif, 6) AS r_squared, CASE WHEN vif < 10 THEN 'pass' ELSE 'warning' END AS status FROM v""",
)
def vif_all(spark, sf_dir):
    frame, _ = _woe_frame(spark, sf_dir)
    return diagnostics.vif(frame, _WOE_FEATURES)


@query(
    "bundle_check",
    f"""{BINS_CTE}, need(variable) AS (VALUES ('quantity'), ('discount'), ('segment'), ('utilisation'))
    SELECT 'VARIABLE_WITHOUT_WOE' AS "check", variable AS detail FROM need WHERE variable NOT IN (SELECT variable FROM woe)
    UNION ALL SELECT 'INTERCEPT_DIFFERS', '-1.36' UNION ALL SELECT 'SCORECARD_TARGET_DIFFERS', 'default_flag'""",
)
def bundle_check(spark, sf_dir):
    _, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    coefficients = scaling.coefficients_table(table, INTERCEPT, {**MODEL, "utilisation_woe": -0.4})
    return scaling.bundle_violations(coefficients, table, -1.3, "outcome", "default_flag", "outcome")


@query(
    "bundle_feature_order",
    f"""{BINS_CTE}, need(variable) AS (VALUES ('quantity'), ('discount'), ('segment'))
    SELECT 'VARIABLE_WITHOUT_WOE' AS "check", variable AS detail FROM need WHERE variable NOT IN (SELECT variable FROM woe WHERE variable <> 'segment')
    UNION ALL SELECT 'FEATURE_ORDER_DIFFERS', 'segment_woe,quantity_woe,discount_woe'""",
)
def bundle_feature_order(spark, sf_dir):
    """A bundle that would score the features in another order than the model was fitted in, without bins of one."""
    _, table = _fitted(spark, sf_dir, MODEL_VARIABLES)
    fitted = scaling.feature_order_hash(list(MODEL))
    coefficients = scaling.coefficients_table(table, INTERCEPT, MODEL)
    order = ["segment_woe", "quantity_woe", "discount_woe"]
    return scaling.bundle_violations(coefficients, table.filter("variable <> 'segment'"), INTERCEPT, feature_order=order, frozen_order=fitted)


@query(
    "build_summary",
    f"""{BINS_CTE}, {_CARD} SELECT 'features' AS item, CAST(3 AS BIGINT) AS row_count UNION ALL SELECT 'iv_rows', count(*) FROM iv WHERE variable IN ('quantity', 'discount', 'segment')
    UNION ALL SELECT 'woe_rows', count(*) FROM woe WHERE variable IN ('quantity', 'discount', 'segment') UNION ALL SELECT 'scorecard_attributes', count(*) FROM card""",
)
def build_summary(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir, MODEL_VARIABLES)
    table = woe.woe_table(cells)
    coefficients = _coefficients(table)
    return scaling.build_summary(coefficients, woe.iv_table(cells), table, scaling.scorecard(table, coefficients, SCALING))


_RESAMPLED_CTE = BINS_CTE.replace("WHERE role = 'train' AND", "WHERE role = 'train' AND priority <> '1-URGENT' AND")


@query(
    "compare_iv_refitted",
    f"""WITH b AS ({BINS_CTE} SELECT * FROM iv WHERE variable <> 'balance'), c AS ({_RESAMPLED_CTE} SELECT * FROM iv WHERE variable <> 'flag')
    SELECT coalesce(b.variable, c.variable) AS variable, b.variable IS NOT NULL AS in_baseline, c.variable IS NOT NULL AS in_challenger,
      b.iv AS baseline_iv, c.iv AS challenger_iv, b.bin_count AS baseline_bin_count, c.bin_count AS challenger_bin_count,
      round(coalesce(c.iv, 0) - coalesce(b.iv, 0), 6) AS iv_delta, coalesce(c.bin_count, 0) - coalesce(b.bin_count, 0) AS bin_count_delta
    FROM b FULL JOIN c ON b.variable = c.variable""",
)
def compare_iv_refitted(spark, sf_dir):
    """Against a challenger that is binned anew without urgent orders, so shared variables differ."""
    rows = development(spark, sf_dir)
    cells = woe.woe_cells(rows, fitted_bins(spark, sf_dir, dev=rows), TARGET)
    dev = rows.filter("priority <> '1-URGENT'")
    challenger = woe.woe_cells(dev, fitted_bins(spark, sf_dir, dev=dev), TARGET)
    return compare.compare_iv(woe.iv_table(cells).filter("variable <> 'balance'"), woe.iv_table(challenger).filter("variable <> 'flag'"))


# --- challenger -----------------------------------------------------------------------------


@query(
    "compare_iv",
    f"""{BINS_CTE}, ivb AS (SELECT * FROM iv WHERE variable <> 'balance'), ivc AS (SELECT * FROM iv WHERE variable NOT IN ('tax', 'flag'))
    SELECT coalesce(b.variable, c.variable) AS variable, b.variable IS NOT NULL AS in_baseline, c.variable IS NOT NULL AS in_challenger,
      b.iv AS baseline_iv, c.iv AS challenger_iv, b.bin_count AS baseline_bin_count, c.bin_count AS challenger_bin_count,
      round(coalesce(c.iv, 0) - coalesce(b.iv, 0), 6) AS iv_delta, coalesce(c.bin_count, 0) - coalesce(b.bin_count, 0) AS bin_count_delta
    FROM ivb b FULL JOIN ivc c ON b.variable = c.variable""",
)
def compare_iv(spark, sf_dir):
    _, cells = fitted_cells(spark, sf_dir)
    iv = woe.iv_table(cells)
    return compare.compare_iv(iv.filter("variable <> 'balance'"), iv.filter("variable NOT IN ('tax', 'flag')"))


@query(
    "compare_coefficients",
    f"""{_SLOPES_CTE}, cb AS (SELECT * FROM cf WHERE feature <> 'tax_woe'), cc AS ({_slope_oracle(_WOE_FEATURES[:5], "(SELECT * FROM x WHERE priority <> '1-URGENT') y")})
    SELECT coalesce(b.feature, c.feature) AS feature, b.feature IS NOT NULL AS in_baseline, c.feature IS NOT NULL AS in_challenger,
      b.coefficient AS baseline_coefficient, c.coefficient AS challenger_coefficient,
      round(coalesce(c.coefficient, 0) - coalesce(b.coefficient, 0), 6) AS coefficient_delta FROM cb b FULL JOIN cc c ON b.feature = c.feature""",
)
def compare_coefficients(spark, sf_dir):
    """Baseline on all training rows without tax; challenger without urgent orders and category features."""
    frame, _ = _woe_frame(spark, sf_dir)
    baseline = _slopes(frame, _WOE_FEATURES).filter("feature <> 'tax_woe'")
    challenger = _slopes(frame.filter("priority <> '1-URGENT'"), _WOE_FEATURES[:5])
    return compare.compare_coefficients(baseline, challenger)


def _validation(sample):
    auc = metrics.auc_gini(metrics.score_ranking(sample, TARGET, metrics.PROBABILITY))
    return auc.join(metrics.ks(metrics.score_ranking(sample, TARGET, metrics.SCORE)), "role")


_KNOWN = "SELECT role, CASE WHEN outcome = 'bad' THEN 1 ELSE 0 END AS y, predicted_bad_probability AS p, score FROM {s} WHERE outcome IN ('good', 'bad')"


@query(
    "compare_validation",
    f"""{CHALLENGER_CTE}, kb AS ({_KNOWN.format(s='scored')}), kc AS ({_KNOWN.format(s='challenger')})
    {ranking_cte('p', 'kb', 'pb')}{ranking_cte('p', 'kc', 'pc')}{ranking_cte('score', 'kb', 'sb')}{ranking_cte('score', 'kc', 'sc')},
    ab AS ({AUC_SELECT.format(pre='pb')}), ac AS ({AUC_SELECT.format(pre='pc')}), qb AS ({KS_SELECT.format(pre='sb')}), qc AS ({KS_SELECT.format(pre='sc')})
    SELECT ab.role, TRUE AS in_baseline, TRUE AS in_challenger, ab.auc AS baseline_auc, ac.auc AS challenger_auc,
      round(2 * ab.auc - 1, 6) AS baseline_gini, round(2 * ac.auc - 1, 6) AS challenger_gini, qb.ks AS baseline_ks, qc.ks AS challenger_ks,
      round(ac.auc - ab.auc, 6) AS auc_delta, round(round(2 * ac.auc - 1, 6) - round(2 * ab.auc - 1, 6), 6) AS gini_delta, round(qc.ks - qb.ks, 6) AS ks_delta
    FROM ab JOIN ac ON ab.role = ac.role JOIN qb ON ab.role = qb.role JOIN qc ON ab.role = qc.role""",
)
def compare_validation(spark, sf_dir):
    return compare.compare_validation(
        _validation(scored_sample(spark, sf_dir)), _validation(scored_sample(spark, sf_dir, "3.0"))
    )


_EXPLICIT = "[480::DOUBLE, 490, 500, 510, 520, 530, 540, 550, 560]"


@query(
    "compare_cutoffs",
    f"""{CHALLENGER_CTE}{bands_cte(_EXPLICIT, 'scored', 'bb')}{bands_cte(_EXPLICIT, 'challenger', 'bc')}
    SELECT b.role, b.upper AS cutoff, TRUE AS in_baseline, TRUE AS in_challenger, b.approval_rate AS baseline_approval_rate,
      c.approval_rate AS challenger_approval_rate, b.bad_rate AS baseline_bad_rate, c.bad_rate AS challenger_bad_rate,
      b.capture_rate AS baseline_capture_rate, c.capture_rate AS challenger_capture_rate, b.count AS baseline_count, c.count AS challenger_count
    FROM bb b JOIN bc c ON b.role = c.role AND b.upper = c.upper WHERE b.upper IS NOT NULL""",
)
def compare_cutoffs(spark, sf_dir):
    cutoffs = [480, 490, 500, 510, 520, 530, 540, 550, 560]
    return compare.compare_cutoffs(
        strategy.cutoff_bands(scored_sample(spark, sf_dir), TARGET, cutoffs=cutoffs),
        strategy.cutoff_bands(scored_sample(spark, sf_dir, "3.0"), TARGET, cutoffs=cutoffs),
    )


# --- cases outside the usual route ------------------------------------------------------

_NAN_COLUMNS = ["quantity", "price", "discount", "tax", "balance"]


@query(
    "corr_nan",
    f"""{SCORED_CTE}, wide AS (SELECT CASE WHEN quantity % 7 = 0 THEN NULL ELSE quantity END AS quantity, price, discount, tax, balance FROM scored),
    cm AS ({_corr_oracle(_NAN_COLUMNS)}) SELECT variable_a, variable_b, round(corr, 6) AS corr, n FROM cm""",
)
def corr_nan(spark, sf_dir):
    """NaN counts as missing, pair by pair."""
    holed = F.when(F.col("quantity") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("quantity"))
    table = corr.correlation_matrix(scored(spark, sf_dir).withColumn("quantity", holed), _NAN_COLUMNS)
    return table.select("variable_a", "variable_b", F.round("corr", 6).alias("corr"), "n")


def _special_model(spark):
    """Bins of quantity with a special code, and one bin of discount that leaves values unmatched."""
    row = dict.fromkeys(["lower", "upper", "categories"]) | {"is_missing": False, "is_special": False, "is_other": False}
    row |= {"kind": "numeric", "lower_inclusive": True, "upper_inclusive": False, "row_count": 1, "good_count": 1, "bad_count": 0}
    entries = [
        ("quantity", "q_missing", {"is_missing": True}, -0.4), ("quantity", "q_special", {"is_special": True, "categories": ["25.0", "26.0"]}, 0.9),
        ("quantity", "q_low", {"upper": 20.0}, 0.2), ("quantity", "q_high", {"lower": 20.0}, -0.3), ("discount", "d_low", {"upper": 0.05}, 0.5),
    ]
    names = [c.strip().split(" ")[0] for c in binning.BINS_SCHEMA.split(",")]
    rows = [
        tuple((row | changed | {"variable": v, "bin_id": b, "bin_order": i, "label": b})[n] for n in names)
        for i, (v, b, changed, _) in enumerate(entries)
    ]
    bins = spark.createDataFrame(rows, binning.BINS_SCHEMA)
    values = spark.createDataFrame([(v, b, w) for v, b, _, w in entries], "variable string, bin_id string, woe double")
    return bins, values, scaling.coefficients_table(bins, -1.0, {"quantity_woe": -0.8, "discount_woe": -1.2})


def _special_oracle(unmatched):
    return f"""{SCORED_CTE}, x AS (SELECT app_key, -1.0::DOUBLE - 0.8::DOUBLE * CASE WHEN quantity IS NULL THEN -0.4::DOUBLE WHEN quantity IN (25, 26) THEN 0.9
        WHEN quantity < 20 THEN 0.2 ELSE -0.3 END - 1.2::DOUBLE * CASE WHEN discount < 0.05 THEN 0.5::DOUBLE ELSE {unmatched} END AS raw FROM scored)
      SELECT app_key, round(raw, 8) AS raw_model_output, round({_OFFSET} - {_FACTOR} * raw, 4) AS score FROM x"""


def _special_scores(spark, sf_dir, policy):
    bins, values, coefficients = _special_model(spark)
    text = scoring_sql(bins, values, coefficients, "{sample}", ["app_key"], SCALING, policy, "spark")
    out = spark.sql(text, sample=scored(spark, sf_dir))
    return out.select("app_key", F.round("raw_model_output", 8).alias("raw_model_output"), F.round("score", 4).alias("score"))


@query("score_sql_special", _special_oracle("NULL"))
def score_sql_special(spark, sf_dir):
    """Special codes have a bin of their own; a value without a bin has no score."""
    return _special_scores(spark, sf_dir, "error")


@query("score_sql_zero", _special_oracle("0.0"))
def score_sql_zero(spark, sf_dir):
    """A value without a bin counts with a WOE of zero."""
    return _special_scores(spark, sf_dir, "zero")

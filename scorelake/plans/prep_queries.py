"""Sources, preparation, profiling, splitting and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import target as target_ops
from scorelake.functions.state import stage, staging_path
from scorelake.operators import prep, profile, resample, split
from scorelake.operators.prep import RejectRules, Rule, Treatment
from scorelake.plans.registry import query
from scorelake.plans.views import APPS_CTE, NUMERIC, SCORED_CTE, TARGET, apps, development, scored, table
from scorelake.sources import readers, writers

# --- sources ------------------------------------------------------------------


@query(
    "scan_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         o_orderpriority, o_totalprice FROM orders""",
)
def scan_csv(spark, sf_dir):
    """Orders exported as tab-separated latin-1 text and imported again."""
    path = staging_path(spark) + ".tsv"
    table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    ).write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    return readers.read_table(
        spark, path, encoding="latin-1", null_values=["F", "P"],
        overrides={"o_orderkey": "string", "o_totalprice": "float64"},
    )


@query("scan_parquet", "SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal FROM customer")
def scan_parquet(spark, sf_dir):
    return readers.read_table(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"
    )


@query("scan_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey, o_custkey LIMIT 1000")
def scan_limit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return readers.cap_rows(orders, ["o_orderkey", "o_custkey"], 1000)


@query(
    "scan_limit_warning",
    """SELECT count(*) AS source_rows, least(count(*), 1000) AS kept_rows,
       CASE WHEN count(*) > 1000 THEN 'SOURCE_ROW_LIMIT_APPLIED' END AS warning FROM orders""",
)
def scan_limit_warning(spark, sf_dir):
    return readers.cap_warning(table(spark, sf_dir, "orders"), 1000)


@query("sink_roundtrip", f"{SCORED_CTE} SELECT app_key, quantity, price, segment, outcome, score, role FROM scored")
def sink_roundtrip(spark, sf_dir):
    path = staging_path(spark)
    writers.write_table(
        scored(spark, sf_dir).select("app_key", "quantity", "price", "segment", "outcome", "score", "role"), path
    )
    return spark.read.parquet(path)


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf_dir):
    return writers.fingerprint(apps(spark, sf_dir))


# --- rules, target and treatment ---------------------------------------------

RULES = [
    Rule("rejected", "==", 1, "declined at the door"),
    Rule("quantity", "<", 3, "too small"),
    Rule("priority", "in", ("5-LOW",), "out of scope"),
    Rule("flag", "is_null", None, "no return flag"),
    Rule("balance", ">=", 9000.0, "private banking"),
]
_FIRST = """CASE WHEN coalesce(rejected = 1, TRUE) THEN 0 WHEN coalesce(quantity < 3, TRUE) THEN 1
 WHEN coalesce(priority IN ('5-LOW'), TRUE) THEN 2 WHEN flag IS NULL THEN 3
 WHEN coalesce(balance >= 9000, TRUE) THEN 4 END"""


@query("exclusions", f"{APPS_CTE} SELECT app_key, quantity, priority, flag, balance FROM apps WHERE ({_FIRST}) IS NULL")
def exclusions(spark, sf_dir):
    return prep.apply_exclusions(apps(spark, sf_dir), RULES).select("app_key", "quantity", "priority", "flag", "balance")


@query(
    "exclusion_waterfall",
    f"""{APPS_CTE}, f AS (SELECT *, {_FIRST} AS first FROM apps),
    r(rule, "column", operator, reason) AS (VALUES (1, 'rejected', '==', 'declined at the door'),
      (2, 'quantity', '<', 'too small'), (3, 'priority', 'in', 'out of scope'),
      (4, 'flag', 'is_null', 'no return flag'), (5, 'balance', '>=', 'private banking'))
    SELECT rule, "column", operator, reason,
      count(*) FILTER (first = rule - 1 AND CASE rule WHEN 1 THEN rejected = 1 WHEN 2 THEN quantity < 3
        WHEN 3 THEN priority IN ('5-LOW') WHEN 4 THEN flag IS NULL ELSE balance >= 9000 END) AS rows_removed,
      count(*) FILTER (first = rule - 1) AS rows_dropped,
      count(*) FILTER (first IS NULL OR first >= rule) AS rows_left
    FROM r, f GROUP BY ALL""",
)
def exclusion_waterfall(spark, sf_dir):
    return prep.exclusion_waterfall(apps(spark, sf_dir), RULES)


@query(
    "segment_filter",
    f"{APPS_CTE} SELECT app_key, segment, balance FROM apps WHERE segment IN ('BUILDING', 'MACHINERY') AND balance > 0",
)
def segment_filter(spark, sf_dir):
    rules = [
        Rule("segment", "in", ("BUILDING", "MACHINERY"), "two segments"),
        Rule("balance", ">", 0, "in credit"),
    ]
    return prep.segment_filter(apps(spark, sf_dir), rules).select("app_key", "segment", "balance")


@query(
    "target_counts",
    f"""{APPS_CTE} SELECT count(*) AS row_count, count(*) FILTER (outcome = 'bad') AS bad_count,
    count(*) FILTER (outcome = 'good') AS good_count, count(*) FILTER (outcome = 'unknown') AS indeterminate_count,
    count(*) FILTER (outcome NOT IN ('good', 'bad')) AS strict_violations,
    count(*) FILTER (outcome NOT IN ('good', 'bad', 'unknown')) AS undeclared_count FROM apps""",
)
def target_counts(spark, sf_dir):
    return target_ops.target_counts(apps(spark, sf_dir), TARGET)


@query(
    "target_audit",
    f"""{APPS_CTE}, o AS (SELECT outcome AS value, count(*) AS n FROM apps GROUP BY 1),
    d(value, declared_as) AS (VALUES ('good', 'good'), ('bad', 'bad'), ('fraud', 'bad'), ('withdrawn', 'indeterminate'))
    SELECT coalesce(o.value, d.value) AS value, coalesce(declared_as, 'undeclared') AS declared_as,
      coalesce(n, 0) AS n_rows, CASE WHEN declared_as IS NULL THEN 'undeclared'
        WHEN n IS NULL AND declared_as <> 'indeterminate' THEN 'declared_not_observed' ELSE 'ok' END AS status
    FROM o FULL JOIN d ON o.value = d.value""",
)
def target_audit(spark, sf_dir):
    declared = target_ops.TargetSpec("outcome", ("good",), ("bad", "fraud"), ("withdrawn",))
    return target_ops.target_audit(apps(spark, sf_dir), declared)


@query(
    "target_validate",
    f"""{APPS_CTE}, c AS (SELECT outcome AS value, count(*) AS n_rows FROM apps GROUP BY 1)
    SELECT value, n_rows, (SELECT count(*) FROM c) AS distinct_count, CAST(0 AS BIGINT) AS null_count,
      (SELECT count(*) FROM c) = 2 AS is_binary FROM c""",
)
def target_validate(spark, sf_dir):
    return target_ops.validate_binary_target(apps(spark, sf_dir), "outcome")


TREATMENTS = [
    Treatment("quantity", "impute", 25.0, "median"),
    Treatment("flag", "impute", "X", "own level"),
    Treatment("quantity", "cap", 45.0, "thin tail"),
    Treatment("price", "cap", 60000.0, "outliers"),
    Treatment("balance", "floor", 0.0, "overdrafts"),
]


@query(
    "treat_missing_outlier",
    f"""{APPS_CTE} SELECT app_key,
      CASE WHEN coalesce(quantity, 25) > 45 THEN 45.0::DOUBLE ELSE coalesce(quantity, 25.0::DOUBLE) END AS quantity,
      coalesce(flag, 'X') AS flag, CASE WHEN price > 60000 THEN 60000.0::DOUBLE ELSE price END AS price,
      CASE WHEN balance < 0 THEN 0.0::DOUBLE ELSE balance END AS balance FROM apps""",
)
def treat_missing_outlier(spark, sf_dir):
    return prep.treat(apps(spark, sf_dir), TREATMENTS).select("app_key", "quantity", "flag", "price", "balance")


@query(
    "treatment_counts",
    f"""{APPS_CTE} SELECT 'quantity' AS "column", 'impute' AS kind, 'median' AS reason, count(*) FILTER (quantity IS NULL) AS changed FROM apps
    UNION ALL SELECT 'flag', 'impute', 'own level', count(*) FILTER (flag IS NULL) FROM apps
    UNION ALL SELECT 'quantity', 'cap', 'thin tail', count(*) FILTER (coalesce(quantity, 25) > 45) FROM apps
    UNION ALL SELECT 'price', 'cap', 'outliers', count(*) FILTER (price > 60000) FROM apps
    UNION ALL SELECT 'balance', 'floor', 'overdrafts', count(*) FILTER (balance < 0) FROM apps""",
)
def treatment_counts(spark, sf_dir):
    return prep.treatment_summary(apps(spark, sf_dir), TREATMENTS)


REJECTS = RejectRules("ttd", "flag_column", "rejected", exclude=(("staff", "segment", ("FURNITURE",)),))


@query(
    "reject_population",
    f"""{APPS_CTE}, p AS (SELECT *, coalesce(segment = 'FURNITURE', FALSE) AS ex,
      NOT coalesce(segment = 'FURNITURE', FALSE) AND rejected = 0 AND outcome IN ('good', 'bad') AS fin FROM apps)
    SELECT count(*) AS total_rows, count(*) FILTER (fin) AS financed_rows,
      count(*) FILTER (NOT ex AND NOT fin) AS non_financed_rows, count(*) FILTER (ex) AS excluded_rows,
      count(*) FILTER (outcome = 'unknown') AS indeterminate_rows, CAST(0 AS BIGINT) AS unlabeled_accepted_rows FROM p""",
)
def reject_population(spark, sf_dir):
    return prep.reject_population(apps(spark, sf_dir), TARGET, REJECTS)


@query(
    "reject_none",
    f"""{APPS_CTE} SELECT app_key, segment, rejected, outcome FROM apps
    WHERE NOT coalesce(segment = 'FURNITURE', FALSE) AND rejected = 0 AND outcome IN ('good', 'bad')""",
)
def reject_none(spark, sf_dir):
    classified = prep.classify_population(apps(spark, sf_dir), TARGET, REJECTS)
    return prep.reject_none(classified).select("app_key", "segment", "rejected", "outcome")


@query("sample_definition", f"{APPS_CTE} SELECT 'ttd' AS domain, count(*) AS row_count, round(sum(discount), 2) AS weight_sum FROM apps")
def sample_definition(spark, sf_dir):
    row = prep.sample_definition(apps(spark, sf_dir), "ttd", "discount")
    return row.withColumn("weight_sum", F.round("weight_sum", 2))


# --- profile and quality --------------------------------------------------------


@query(
    "profile_numeric",
    APPS_CTE
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls, min({c}) AS min, max({c}) AS max,
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM apps"""
        for c in NUMERIC
    ),
)
def profile_numeric(spark, sf_dir):
    return profile.profile_numeric(apps(spark, sf_dir), NUMERIC)


_APP_COLUMNS = [
    "app_key", "quantity", "price", "discount", "tax", "flag", "priority", "segment",
    "balance", "shipdate", "rejected", "outcome",
]


@query(
    "profile_nulls",
    APPS_CTE
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count FROM apps"""
        for c in _APP_COLUMNS
    ),
)
def profile_nulls(spark, sf_dir):
    return profile.profile_nulls(apps(spark, sf_dir)).drop("dtype")


_DUP = ["quantity", "discount", "tax", "flag", "priority", "segment", "outcome", "rejected"]


@query(
    "dup_rows",
    f"""{APPS_CTE} SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM
    (SELECT count(*) AS n FROM apps GROUP BY {', '.join(_DUP)}) q""",
)
def dup_rows(spark, sf_dir):
    return profile.duplicate_rows(apps(spark, sf_dir).select(*_DUP))


_QUALITY_CTE = (
    APPS_CTE
    + ", wide AS (SELECT *, CASE WHEN tax > 0.06 THEN 'high' END AS tax_note, 1 AS batch, "
    + "CASE WHEN quantity = 50 THEN 1 ELSE 0 END AS bulk FROM apps), long AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c in NUMERIC + ['rejected', 'batch', 'bulk']} AS num, CAST({c} AS VARCHAR) AS v FROM wide"""
        for c in _APP_COLUMNS + ["tax_note", "batch", "bulk"]
    )
    + """), pv AS (SELECT "column", num, v, count(*) AS n FROM long GROUP BY ALL),
 st AS (SELECT "column", num, sum(n) AS rows_, coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS filled,
   count(*) FILTER (v IS NOT NULL) AS u, max(n) FILTER (v IS NOT NULL) AS top FROM pv GROUP BY ALL),
 w AS (
  SELECT "column", 'CONSTANT_COLUMN' AS code, CAST(u AS DOUBLE) AS value FROM st WHERE filled > 0 AND u <= 1
  UNION ALL SELECT "column", 'NEAR_UNIQUE_COLUMN', round(u / filled, 6) FROM st WHERE filled >= 20 AND u / filled >= 0.95
  UNION ALL SELECT "column", 'DOMINANT_VALUE_COLUMN', round(top / filled, 6) FROM st WHERE num AND filled > 0 AND top / filled >= 0.95
  UNION ALL SELECT "column", 'HIGH_CARDINALITY_CATEGORICAL', CAST(u AS DOUBLE) FROM st WHERE NOT num AND filled > 0 AND (u > 50 OR u / filled >= 0.5)
  UNION ALL SELECT "column", 'NULL_HEAVY_COLUMN', round((rows_ - filled) / rows_, 6) FROM st WHERE (rows_ - filled) / rows_ >= 0.5
  UNION ALL SELECT 'shipdate', 'SUSPECT_DATE_COLUMN', NULL
  UNION ALL SELECT 'outcome', 'SUSPECT_LEAKAGE_COLUMN', NULL)"""
)


def _quality_input(spark, sf_dir):
    return apps(spark, sf_dir).withColumns(
        {
            "tax_note": F.when(F.col("tax") > 0.06, F.lit("high")),
            "batch": F.lit(1),
            "bulk": F.when(F.col("quantity") == 50, F.lit(1)).otherwise(F.lit(0)),
        }
    )


@query("quality_warnings", f"{_QUALITY_CTE} SELECT * FROM w")
def quality_warnings(spark, sf_dir):
    return profile.quality_warnings(_quality_input(spark, sf_dir))


@query(
    "recommended_exclude",
    f"""{_QUALITY_CTE} SELECT DISTINCT "column" FROM w WHERE code IN ('SUSPECT_DATE_COLUMN', 'SUSPECT_LEAKAGE_COLUMN',
    'CONSTANT_COLUMN', 'NEAR_UNIQUE_COLUMN')""",
)
def recommended_exclude(spark, sf_dir):
    return profile.recommended_exclusions(profile.quality_warnings(_quality_input(spark, sf_dir)))


@query(
    "string_numeric",
    """WITH s AS (SELECT '$' || format('{:,.2f}', l_extendedprice) AS amount, l_returnflag AS flag,
        CASE WHEN l_linenumber < 3 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END AS part FROM lineitem),
    l AS (SELECT 'amount' AS "column", amount AS v FROM s UNION ALL SELECT 'flag', flag FROM s UNION ALL SELECT 'part', part FROM s),
    c AS (SELECT "column", count(v) AS filled, count(TRY_CAST(
        regexp_replace(regexp_replace(v, '^([^,]*),', '\\1'), '^\\s*\\$', '') AS DOUBLE)) AS parsed FROM l GROUP BY 1)
    SELECT "column", filled, parsed, round(parsed / filled, 6) AS share,
      CASE WHEN filled >= 2 AND parsed / filled >= 0.9 THEN 'STRING_CODED_NUMERIC' ELSE 'OK' END AS code FROM c""",
)
def string_numeric(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("amount"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") < 3, F.lit("n/a")).otherwise(F.col("l_partkey").cast("string")).alias("part"),
    )
    return profile.string_numeric(text)


@query(
    "string_dates",
    """WITH s AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS shipped, strftime(l_shipdate, '%d/%m/%Y') AS local_day,
        CASE WHEN l_linenumber = 1 THEN 'soon' ELSE strftime(l_shipdate, '%Y%m%d') END AS mixed, l_returnflag AS flag FROM lineitem),
    l AS (SELECT 'shipped' AS "column", shipped AS v FROM s UNION ALL SELECT 'local_day', local_day FROM s
      UNION ALL SELECT 'mixed', mixed FROM s UNION ALL SELECT 'flag', flag FROM s),
    c AS (SELECT "column", count(v) AS filled, count(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'),
      try_strptime(v, '%Y%m%d'))) AS parsed FROM l GROUP BY 1)
    SELECT "column", filled, parsed, round(parsed / filled, 6) AS share,
      CASE WHEN filled >= 2 AND parsed / filled >= 0.8 THEN 'DATE_LIKE_STRING' ELSE 'OK' END AS code FROM c""",
)
def string_dates(spark, sf_dir):
    day = lambda f: F.date_format("l_shipdate", f)
    text = table(spark, sf_dir, "lineitem").select(
        day("yyyy-MM-dd").alias("shipped"),
        day("dd/MM/yyyy").alias("local_day"),
        F.when(F.col("l_linenumber") == 1, F.lit("soon")).otherwise(day("yyyyMMdd")).alias("mixed"),
        F.col("l_returnflag").alias("flag"),
    )
    return profile.string_dates(text)


@query(
    "role_target_counts",
    f"{SCORED_CTE} SELECT role, outcome AS value, count(*) AS n_rows, 'ok' AS status FROM scored GROUP BY ALL",
)
def role_target_counts(spark, sf_dir):
    return profile.role_target_counts(scored(spark, sf_dir), "outcome")


SOURCES = [("bureau", ["quantity", "flag"]), ("bank", ["balance", "utilisation"])]


@query(
    "source_coverage",
    f"""{APPS_CTE}, c AS (SELECT round(count(quantity) / count(*), 4) AS q, round(count(flag) / count(*), 4) AS f,
      round(count(balance) / count(*), 4) AS b FROM apps),
    l AS (SELECT 'bureau' AS source, 'quantity' AS "column", q AS coverage FROM c UNION ALL SELECT 'bureau', 'flag', f FROM c
     UNION ALL SELECT 'bank', 'balance', b FROM c UNION ALL SELECT 'bank', 'utilisation', 0 FROM c)
    SELECT source, "column", CAST(coverage AS DOUBLE) AS coverage, CAST(round(1 - coverage, 4) AS DOUBLE) AS missingness FROM l""",
)
def source_coverage(spark, sf_dir):
    return prep.source_coverage(apps(spark, sf_dir), SOURCES)


@query(
    "feature_health",
    f"""{APPS_CTE}, c AS (SELECT count(*) AS n, count(*) - count(quantity) AS q,
       count(*) FILTER (coalesce(tax, 0) <= 0.06) AS t FROM apps)
    SELECT 'quantity' AS feature, round(q / n, 6) AS value, CASE WHEN q > n * 0.5 THEN 'HIGH_NULL_FEATURE' ELSE 'OK' END AS code FROM c
    UNION ALL SELECT 'tax_note', round(t / n, 6), CASE WHEN t > n * 0.5 THEN 'HIGH_NULL_FEATURE' ELSE 'OK' END FROM c
    UNION ALL SELECT 'utilisation', NULL, 'MISSING_FEATURE_COLUMN' FROM c
    UNION ALL SELECT '(all features)', round(3 / n, 6), CASE WHEN 3 / n > 0.5 THEN 'HIGH_DIMENSIONALITY' ELSE 'DIMENSIONALITY_OK' END FROM c""",
)
def feature_health(spark, sf_dir):
    return prep.feature_health(_quality_input(spark, sf_dir), ["quantity", "tax_note", "utilisation"])


# --- splits and resampling --------------------------------------------------------


@query(
    "split_stratified",
    f"""{APPS_CTE}, r AS (SELECT app_key, outcome,
       row_number() OVER (PARTITION BY outcome ORDER BY md5(concat_ws('|', app_key, '42'))) AS rn,
       count(*) OVER (PARTITION BY outcome) AS n FROM apps)
    SELECT app_key, outcome, CASE WHEN rn <= greatest(1, floor(n * 0.6::DOUBLE)) THEN 'train'
      WHEN rn <= greatest(1, floor(n * 0.6::DOUBLE)) + greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'oot' END AS role FROM r""",
)
def split_stratified(spark, sf_dir):
    source = stage(apps(spark, sf_dir).select("app_key", "outcome"))
    return split.stratified_split(source, "outcome", ["app_key"])


@query("split_preassigned", f"{SCORED_CTE} SELECT role, count(*) AS n_rows FROM scored GROUP BY 1")
def split_preassigned(spark, sf_dir):
    ready = scored(spark, sf_dir).select(F.col("role").alias("sample"))
    return split.preassigned_split(ready, "sample").groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "resample_under",
    f"""{SCORED_CTE}, dev AS (SELECT * FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad')),
    r AS (SELECT app_key, outcome, row_number() OVER (PARTITION BY outcome ORDER BY md5(concat_ws('|', app_key, '7'))) AS rn FROM dev)
    SELECT app_key, outcome, FALSE AS _is_synthetic_row FROM r
    WHERE outcome = 'bad' OR rn <= (SELECT floor(count(*) * 0.8::DOUBLE) FROM dev WHERE outcome = 'bad')""",
)
def resample_under(spark, sf_dir):
    dev = development(spark, sf_dir).select("app_key", "outcome")
    return resample.resample(dev, TARGET, ["app_key"], "undersample_majority", 0.8, seed=7)


def _resampled_sizes(df):
    return df.groupBy("outcome", resample.SYNTHETIC).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "resample_over",
    f"""{SCORED_CTE}, dev AS (SELECT * FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad')),
    n AS (SELECT count(*) FILTER (outcome = 'bad') AS b, count(*) FILTER (outcome = 'good') AS g FROM dev)
    SELECT 'good' AS outcome, FALSE AS _is_synthetic_row, g AS n_rows FROM n
    UNION ALL SELECT 'bad', FALSE, b FROM n UNION ALL SELECT 'bad', TRUE, g - b FROM n""",
)
def resample_over(spark, sf_dir):
    dev = development(spark, sf_dir).select("app_key", "outcome")
    return _resampled_sizes(resample.resample(dev, TARGET, ["app_key"], "oversample_minority", 1.0, seed=7))


@query(
    "resample_combined",
    f"""{SCORED_CTE}, dev AS (SELECT * FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad')),
    n AS (SELECT count(*) FILTER (outcome = 'bad') AS b, count(*) // 2 AS m FROM dev)
    SELECT 'good' AS outcome, FALSE AS _is_synthetic_row, m AS n_rows FROM n
    UNION ALL SELECT 'bad', FALSE, b FROM n UNION ALL SELECT 'bad', TRUE, m - b FROM n""",
)
def resample_combined(spark, sf_dir):
    dev = development(spark, sf_dir).select("app_key", "outcome")
    return _resampled_sizes(resample.resample(dev, TARGET, ["app_key"], "combined", 1.0, seed=7))


_SMOTE_FEATURES = ["quantity", "discount", "tax", "balance"]
_SMOTE_GAP = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _SMOTE_FEATURES)
_SMOTE_LIST = ", ".join(_SMOTE_FEATURES)
_U = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"

# Distinct points, the five nearest of each by trying all, and the hashed draws.
SMOTE_CTE = f"""{SCORED_CTE},
dev AS (SELECT app_key, outcome, coalesce(CAST(quantity AS DOUBLE), 25) AS quantity, CAST(discount AS DOUBLE) AS discount, CAST(tax AS DOUBLE) AS tax,
  CAST(balance AS DOUBLE) AS balance FROM scored WHERE role = 'train' AND outcome IN ('good', 'bad')),
n AS (SELECT count(*) FILTER (outcome = 'bad') AS n_min, count(*) FILTER (outcome = 'good') - count(*) FILTER (outcome = 'bad') AS new_rows FROM dev),
pts AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', {_SMOTE_LIST}))) - 1 AS point
  FROM (SELECT {_SMOTE_LIST}, count(*) AS copies FROM dev WHERE outcome = 'bad' GROUP BY ALL) q),
near AS (
  SELECT point, i AS rank, found[i].neighbour AS neighbour, found[i].gap AS gap FROM (
    SELECT a.point, min({{'gap': {_SMOTE_GAP}, 'neighbour': b.point}}, 5) AS found FROM pts a JOIN pts b ON a.point <> b.point GROUP BY a.point) f,
    range(1, 6) r(i))"""


@query(
    "smote_neighbours",
    f"""{SMOTE_CTE} SELECT {", ".join("a." + c for c in _SMOTE_FEATURES)}, CAST(rank AS INT) AS rank, round(sqrt(gap), 6) AS distance,
    b.balance AS neighbour_balance FROM near JOIN pts a ON a.point = near.point JOIN pts b ON b.point = neighbour""",
)
def smote_neighbours(spark, sf_dir):
    """The five nearest of every distinct minority point; equal distances by hash order."""
    dev = development(spark, sf_dir, ["outcome", *_SMOTE_FEATURES]).fillna({"quantity": 25.0}).filter(TARGET.is_bad)
    points = resample.indexed_points(dev, _SMOTE_FEATURES)
    near = resample.nearest_neighbours(points, _SMOTE_FEATURES, 5)
    other = points.select(F.col("point").alias("neighbour"), F.col("balance").alias("neighbour_balance"))
    return near.join(points, "point").join(other, "neighbour").select(*_SMOTE_FEATURES, "rank", F.round("distance", 6).alias("distance"), "neighbour_balance")


@query(
    "smote",
    f"""{SMOTE_CTE}, quota AS (
      SELECT *, CAST(floor(copies * (new_rows::DOUBLE / n_min::DOUBLE)) AS BIGINT) AS whole,
        row_number() OVER (ORDER BY md5(concat_ws('|', point, 7))) AS turn FROM pts, n),
    drawn AS (
      SELECT *, unnest(range(1, 1 + whole + CASE WHEN turn <= new_rows - sum_whole THEN 1 ELSE 0 END)) AS draw
      FROM (SELECT *, sum(whole) OVER () AS sum_whole FROM quota) q),
    picked AS (
      SELECT *, CAST(floor({_U.format("concat_ws('|', point, draw, 7)")} * 5) AS BIGINT) + 1 - (copies - 1) AS rank,
        {_U.format("concat_ws('|', draw, point, 8)")} AS step FROM drawn)
    SELECT app_key, outcome, {_SMOTE_LIST}, FALSE AS _is_synthetic_row FROM dev
    UNION ALL
    SELECT NULL, 'bad', {", ".join(f"coalesce(p.{c} + step * (b.{c} - p.{c}), p.{c})" for c in _SMOTE_FEATURES)}, TRUE
    FROM picked p LEFT JOIN near ON near.point = p.point AND near.rank = p.rank LEFT JOIN pts b ON b.point = near.neighbour""",
)
def smote(spark, sf_dir):
    dev = development(spark, sf_dir, ["app_key", "outcome", *_SMOTE_FEATURES]).fillna({"quantity": 25.0})
    return resample.smote(dev, TARGET, _SMOTE_FEATURES, k=5, seed=7)

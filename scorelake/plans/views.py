"""The application and scored views every query starts from.

``apps`` joins line items, orders and customers into one row per application
with planted nulls, an undeclared target value and a real signal.  ``scored``
adds a role, log-odds, probability and score from fixed coefficients.  The same
text, without the ``D`` suffixes, is the oracle's starting point.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.state import stage
from scorelake.functions.target import TargetSpec

TARGET = TargetSpec("outcome", good=("good",), bad=("bad",), indeterminate=("unknown",))

NUMERIC = ["quantity", "price", "discount", "tax", "balance"]
CATEGORICAL = ["flag", "priority", "segment"]

APPS_TEXT = """
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS app_key,
  CASE WHEN l_quantity = 13 THEN NULL ELSE l_quantity END AS quantity,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag,
  o_orderpriority AS priority, c_mktsegment AS segment, c_acctbal AS balance, l_shipdate AS shipdate,
  CASE WHEN (l_orderkey * 11 + l_partkey) % 5 = 0 THEN 1 ELSE 0 END AS rejected,
  CASE WHEN (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 97 = 0 THEN 'unknown'
       WHEN (l_orderkey * 7 + l_linenumber * 13) % 10 <
            1 + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END
              + CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END
              + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END THEN 'bad'
       ELSE 'good' END AS outcome
FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey LEFT JOIN {customer} ON o_custkey = c_custkey
"""

SCORED_TEXT = """
SELECT *, round(1.0D / (1.0D + exp(-z)), 6) AS predicted_bad_probability,
       round(487.122876D - 28.85390D * z, 2) AS score
FROM (SELECT *, -1.6D + <W>D * (discount - 0.05D) + 0.02D * (coalesce(quantity, 25.0D) - 25.0D)
                + CASE WHEN segment = 'BUILDING' THEN 0.5D ELSE 0.0D END AS z,
        CASE WHEN substr(md5(concat_ws('|', app_key, 42)), 1, 1) < '9' THEN 'train'
             WHEN substr(md5(concat_ws('|', app_key, 42)), 1, 1) < 'd' THEN 'test' ELSE 'oot' END AS role
      FROM {apps}) q
"""


def _duck(text: str) -> str:
    return re.sub(r"(\d\.\d+|\d+\.\d+)D", r"\1::DOUBLE", text)


def _duck_scored(weight: str, source: str = "apps") -> str:
    return _duck(SCORED_TEXT.replace("<W>", weight)).format(apps=source)


APPS_SQL = APPS_TEXT.format(lineitem="lineitem", orders="orders", customer="customer")

# CTE text an oracle starts with: apps and scored, plus the challenger's view.
APPS_CTE = f"WITH apps AS ({APPS_SQL})"
SCORED_CTE = f"{APPS_CTE}, scored AS ({_duck_scored('6.0')})"
CHALLENGER_CTE = f"{SCORED_CTE}, challenger AS ({_duck_scored('3.0')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same rows with the small tables joined first, so that line items are exchanged once.
APPS_NESTED = APPS_TEXT.replace(
    "{orders} ON l_orderkey = o_orderkey LEFT JOIN {customer} ON o_custkey = c_custkey",
    "({orders} LEFT JOIN {customer} ON o_custkey = c_custkey) ON l_orderkey = o_orderkey",
)


def apps(spark: SparkSession, sf_dir: str, text: str = APPS_TEXT) -> DataFrame:
    return spark.sql(
        text,
        lineitem=table(spark, sf_dir, "lineitem"),
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
    )


def scored(spark: SparkSession, sf_dir: str, discount_weight: str = "6.0", text: str = APPS_TEXT) -> DataFrame:
    return spark.sql(SCORED_TEXT.replace("<W>", discount_weight), apps=apps(spark, sf_dir, text))


def known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("outcome").isin("good", "bad"))


def development(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """Training rows with a declared outcome, staged because fits read them several times.

    They are dealt out evenly once, so every later pass uses all cores however few files the tables came in.
    Only the ``columns`` named are joined and staged; their rows come in another order, dealt by hash, which sorts nothing.
    """
    tasks = spark.sparkContext.defaultParallelism
    if columns:
        rows = known(scored(spark, sf_dir, text=APPS_NESTED)).filter("role = 'train'").select(*columns)
        return stage(rows.repartition(tasks, *columns))
    return stage(known(scored(spark, sf_dir)).filter("role = 'train'").repartition(tasks))

"""A scorecard as one SQL statement, to run here or to hand to another database."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame

from scorelake.functions.columns import quote
from scorelake.operators.binning import SPARK, Dialect, bin_condition, bins_by_variable
from scorelake.operators.scaling import Scaling, model_of
from scorelake.operators.woe import woe_lookup

PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _number(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


# Names are quoted only where they must be, so plain ones read the same everywhere.
ANSI = Dialect(
    name=lambda n: n if PLAIN_NAME.fullmatch(n) else '"' + n.replace('"', '""') + '"',
    number=_number,
    text=lambda t: "'" + str(t).replace("'", "''") + "'",
    string=None,
)
SPARK_SQL = replace(SPARK, name=lambda n: n if PLAIN_NAME.fullmatch(n) else quote(n), number=_number, string=None)
DIALECTS = {"ansi": ANSI, "spark": SPARK_SQL}


def scoring_sql(
    bins: DataFrame,
    woe: DataFrame,
    coefficients: DataFrame,
    table: str,
    keep: list[str],
    scaling: Scaling = Scaling(),
    on_unmatched: str = "error",
    dialect: str = "ansi",
) -> str:
    """CASE per variable, then log-odds, probability and score.

    ``on_unmatched``: "error" leaves NULL where no bin matches, so the score is
    NULL too; "zero" uses a WOE of 0.  ``dialect`` ("ansi" or "spark") tells how
    names and texts are quoted.  A model variable without bins and a bin without
    WOE are errors.
    """
    if on_unmatched not in ("error", "zero"):
        raise ValueError("on_unmatched must be error or zero")
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {sorted(DIALECTS)}")
    written = DIALECTS[dialect]
    lookup, spec = woe_lookup(woe), bins_by_variable(bins)
    intercept, slopes = model_of(coefficients)
    fallback = "NULL" if on_unmatched == "error" else "0.0"
    columns, terms = [], [_number(intercept)]
    for feature, slope in slopes.items():
        variable = feature.removesuffix("_woe")
        if variable not in spec:
            raise ValueError(f"no bins for model variable {variable!r}")
        unknown = [e.bin_id for e in spec[variable] if lookup.get((variable, e.bin_id)) is None]
        if unknown:
            raise ValueError(f"bins {unknown} of {variable!r} have no WOE")
        whens = "\n      ".join(
            f"WHEN {bin_condition(e, spec[variable], written)} THEN {_number(lookup[(variable, e.bin_id)])}" for e in spec[variable]
        )
        columns.append(f"    CASE\n      {whens}\n      ELSE {fallback} END AS {written.name(feature)}")
        terms.append(f"{_number(slope)} * {written.name(feature)}")
    kept = ", ".join(written.name(k) for k in keep)
    woe_columns = ",\n".join(columns)
    return (
        f"WITH woe_values AS (\n  SELECT {kept},\n{woe_columns}\n  FROM {table}\n),\n"
        f"linear AS (\n  SELECT *, {' + '.join(terms)} AS raw_model_output FROM woe_values\n)\n"
        f"SELECT {kept}, raw_model_output,\n"
        "  1.0 / (1.0 + exp(-raw_model_output)) AS predicted_bad_probability,\n"
        f"  {_number(scaling.offset)} + {_number(scaling.direction * scaling.factor)} * raw_model_output AS score\n"
        "FROM linear"
    )

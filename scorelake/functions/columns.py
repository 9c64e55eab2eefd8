"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def ratio(num: Column, den: Column, otherwise: float | None = 0.0) -> Column:
    """num / den as double, with a fixed value where den is not positive (ANSI-safe)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(otherwise).cast("double"))


def count_if(condition: Column) -> Column:
    """Rows where the condition is true (null counts as false), never null."""
    return F.count(F.when(condition, F.lit(1)))


def missing_as_null(x: Column) -> Column:
    """A double with NaN as null."""
    return F.when(~F.isnan(x), x)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs; null without variance (``corr`` would fail)."""
    x, y = missing_as_null(x.cast("double")), missing_as_null(y.cast("double"))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def unpivot_values(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str | Column],
    cast: str = "double",
) -> DataFrame:
    """Long form ``(keep..., variable, value)``: one projection, no shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), col(c).cast(cast).alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(pairs))


def constants(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A tiny literal table (parameters, fitted state) on the caller's session."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def one_row(df: DataFrame) -> Column:
    """A one-row result as a struct column (scalar subquery), to use beside rows."""
    return df.select(F.struct("*").alias("row")).scalar()


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match, keeping the left copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for i, k in enumerate(keys):
        same = col(k).eqNullSafe(col(f"_right_{k}"))
        condition = same if i == 0 else condition & same
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def sql_number(value: float) -> str:
    """A double literal of Spark SQL; long expressions are built as text and parsed once."""
    value = float(value)
    if value != value or value in (float("inf"), float("-inf")):
        return f"double('{value}')"
    return f"{value!r}D"


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_position(value: str, breaks: Sequence[float], left_closed: bool = False) -> str:
    """CASE giving the 0-based interval of ``value`` among ascending breaks."""
    if not breaks:
        return "0"
    op = "<" if left_closed else "<="
    whens = " ".join(f"WHEN {value} {op} {sql_number(b)} THEN {i}" for i, b in enumerate(breaks))
    return f"CASE {whens} ELSE {len(breaks)} END"


def sql_search(value: str, breaks: Sequence[float], results: Sequence[str], left_closed: bool = False) -> str:
    """The result (one more than there are ascending breaks) of the interval that holds a value that is not null.

    The value is searched by halving, inside a function over a one-element array: with a test per break, a
    projection of many variables becomes a generated method too long to be compiled at run time.
    """
    op = "<" if left_closed else "<="

    def halved(low: int, high: int) -> str:
        if low == high:
            return results[low]
        half = (low + high) // 2
        return f"if(v {op} {sql_number(breaks[half])}, {halved(low, half)}, {halved(half + 1, high)})"

    return f"get(transform(array({value}), v -> {halved(0, len(breaks))}), 0)"

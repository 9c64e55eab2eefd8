"""Correlation of many columns in one or two passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, missing_as_null
from scorelake.functions.ordered import running_totals
from scorelake.functions.state import stage

# Values that are broadcast with their ranks: at most so many, and so many numbers in all.
FREQUENT_VALUES = 20_000
FREQUENT_NUMBERS = 2_000_000
# Ranks a task holds as one array.
MATRIX_CELLS = 4_000_000


def _pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, corr, n)`` over the rows where both columns are present.

    Partitions send masked, centred cross products, one row per pair, whatever the number of columns.
    """
    k = len(columns)
    means = df.agg(*[F.coalesce(F.avg(col(c).cast("double")), F.lit(0.0)).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    centres = np.array([means[i] for i in range(k)])
    first, second = np.triu_indices(k, 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, k, k))
        for batch in batches:
            values = batch.to_numpy(dtype="float64") - centres
            present = ~np.isnan(values)
            x, m = np.where(present, values, 0.0), present.astype("float64")
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        table = {"i": first, "j": second}
        for name, s in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), sums):
            table[name] = s[first, second]
        yield pd.DataFrame(table)

    partial = df.select(*[col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(columns)]).mapInPandas(
        products, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    totals = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    corr = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))
    return totals.select("i", "j", corr.alias("corr"), n.cast("long").alias("n"))


def _null_classes(long: DataFrame, k: int) -> tuple[list[int], int]:
    """Class of each column, columns missing in the same rows sharing one, and the number of present values.

    Two 64-bit sums of the hashes of the rows where a column is missing tell the classes apart.
    """
    gap = F.col("value").isNull()
    marks = long.groupBy("i").agg(
        F.bit_xor(F.when(gap, F.xxhash64("rid"))).alias("first"),
        F.bit_xor(F.when(gap, F.xxhash64(F.lit("second"), "rid"))).alias("second"),
        F.count("value").alias("filled"),
    )
    seen = {r.i: (r.first, r.second, r.filled) for r in marks.collect()}
    numbers: dict[tuple, int] = {}
    classes = [numbers.setdefault(seen.get(i, (None, None, 0)), len(numbers)) for i in range(k)]
    return classes, sum(filled for _, _, filled in seen.values())


def _rank_products(classes: list[int]):
    """Partial sums over rows of ``(i, centred ranks by class)``, one row per pair of columns."""
    k, m = len(classes), max(classes) + 1
    members = [np.flatnonzero(np.array(classes) == c) for c in range(m)]
    first, second = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, MATRIX_CELLS // (k * m))):
                ranked = batch.column(0).slice(start, max(1, MATRIX_CELLS // (k * m)))
                row = np.repeat(np.arange(len(ranked)), pc.list_value_length(ranked).to_numpy())
                i, ranks = ranked.flatten().flatten()
                column = i.to_numpy()
                cube, present = np.zeros((len(ranked), k, m)), np.zeros((len(ranked), k), bool)
                cube[row, column] = ranks.flatten().to_numpy().reshape(-1, m)
                present[row, column] = True
                for c, mine in enumerate(members):
                    for d, other in enumerate(members):
                        both = present[:, mine[0]] & present[:, other[0]]
                        x, y = cube[both][:, mine, d], cube[both][:, other, c]
                        at = np.ix_(mine, other)
                        sums[0][at] += both.sum()
                        sums[1][at] += (x * x).sum(axis=0)[:, None]
                        sums[2][at] += (y * y).sum(axis=0)[None, :]
                        sums[3][at] += x.T @ y
        columns = [first.astype(np.int32), second.astype(np.int32), *[s[first, second] for s in sums]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "sxx", "syy", "sxy"])

    return run


def _spearman(used: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, corr, n)`` of ranks taken over the rows where both columns are present.

    A rank depends on the other column only through the rows where that one is missing, so every
    value has one rank per class of columns that are missing together.  All columns are counted,
    ranked and brought back to their rows in long form: the number of exchanges depends neither on the
    columns nor on the patterns of nulls.  Frequent values, of a bounded number, meet their ranks
    by broadcast, so none of them is a join key.  A row carries one number per present column and class.
    """
    k = len(columns)
    names = [f"x_{i}" for i in range(k)]
    numbered = used.select(F.monotonically_increasing_id().alias("rid"), *[col(c).alias(n) for c, n in zip(columns, names)])
    rows = stage(numbered)
    long = rows.select("rid", F.posexplode(F.array(*names)).alias("i", "value"))
    classes, filled = _null_classes(long, k)
    m = max(classes) + 1
    there = F.array(*[F.col(names[classes.index(c)]).isNotNull().cast("long") for c in range(m)])
    beside = rows.select("rid", there.alias("there"), F.posexplode(F.array(*names)).alias("i", "value")).filter("value IS NOT NULL")
    sums = [f"n_{c}" for c in range(m)]
    counts = beside.groupBy("i", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("there", F.lit(c))).alias(s) for c, s in enumerate(sums)]
    )
    # The mean rank of the rows two columns share is known, so ranks are centred exactly.
    centred = F.array(*[F.col(f"before_{s}") + (F.col(s) - F.col(f"total_{s}")) / F.lit(2.0) for s in sums])
    ranks = stage(running_totals(counts, "value", sums, ["i"]).select("i", "value", "n", centred.alias("ranks")))
    frequent = F.col("n") > F.lit(filled // max(1, min(FREQUENT_VALUES, FREQUENT_NUMBERS // m)))
    present = long.filter("value IS NOT NULL")
    marked = present.join(F.broadcast(ranks.filter(frequent).drop("n")), ["i", "value"], "left")
    rest = marked.filter("ranks IS NULL").drop("ranks").join(ranks.filter(~frequent).drop("n"), ["i", "value"])
    found = marked.filter("ranks IS NOT NULL").select("rid", "i", "ranks").unionByName(rest.select("rid", "i", "ranks"))
    by_row = found.groupBy("rid").agg(F.collect_list(F.struct("i", "ranks")).alias("ranked")).select("ranked")
    partial = by_row.mapInArrow(_rank_products(classes), "i int, j int, n double, sxx double, syy double, sxy double")
    pairs = used.sparkSession.range(k * k).select(
        F.expr(f"cast(id div {k} AS int)").alias("i"), F.expr(f"cast(id % {k} AS int)").alias("j"),
        *[F.lit(0.0).alias(s) for s in ("n", "sxx", "syy", "sxy")],
    )
    totals = partial.unionByName(pairs.filter("i < j")).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in ("n", "sxx", "syy", "sxy")])
    corr = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt("sxx") / F.sqrt("syy"))
    return totals.select("i", "j", corr.alias("corr"), F.col("n").cast("long").alias("n"))


def correlation_matrix(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "pearson",
    missing: str = "pairwise",
    absolute: bool = False,
    min_pairs: int = 30,
) -> DataFrame:
    """``(variable_a, variable_b, corr, n, warning)`` for each pair of columns.

    An undefined correlation is 0; NaN counts as missing.  With ``missing="pairwise"`` ranks of a pair
    are taken over the rows where both are present.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")
    if missing not in ("pairwise", "complete_case"):
        raise ValueError("missing must be pairwise or complete_case")
    columns = list(columns)
    used = df.select(*[missing_as_null(col(c).cast("double")).alias(c) for c in columns])
    if missing == "complete_case":
        used = used.dropna()
    if method == "pearson":
        numbers = _pearson(used, columns)
    else:
        numbers = _spearman(used, columns)
    names = F.array(*[F.lit(c) for c in columns])
    value = F.when(F.col("corr").isNull() | F.isnan("corr"), F.lit(0.0)).otherwise(F.col("corr"))
    return numbers.select(
        F.get(names, F.col("i")).alias("variable_a"),
        F.get(names, F.col("j")).alias("variable_b"),
        (F.abs(value) if absolute else value).alias("corr"),
        "n",
        F.when(F.col("n") == 0, F.lit("NO_COMPLETE_CASE_ROWS" if missing == "complete_case" else "NO_PAIRWISE_OVERLAP"))
        .when(F.col("n") < min_pairs, F.lit("LOW_PAIR_COUNT"))
        .alias("warning"),
    )

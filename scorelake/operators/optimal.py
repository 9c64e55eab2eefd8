"""Optimal binning: the IV-best merge of pre-bins under size and trend constraints."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import (
    col,
    constants,
    numeric_columns,
    quote,
    sql_number,
    sql_position,
    sql_text,
    unpivot_values,
)
from scorelake.functions.ordered import exact_quantiles, quantile_arrays
from scorelake.functions.state import collect_state, materialise
from scorelake.functions.target import TargetSpec
from scorelake.operators.binning import BINS_SCHEMA, _bin_row, _tally
from scorelake.operators.prebins import cart_breaks

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class OptimalParams:
    prebinning: str = "cart"  # cart: Gini splits; quantile: equal frequencies
    max_prebins: int = 20
    min_prebin_size: float = 0.05  # of a variable's plain values, for cart
    max_bins: int = 6
    min_bins: int = 1
    min_bin_size: float = 0.03
    min_events: int = 20
    min_nonevents: int = 20
    monotonic: str = "auto"  # auto, ascending, descending, none
    cat_cutoff: float = 0.01

    def __post_init__(self) -> None:
        if self.monotonic not in ("auto", "ascending", "descending", "none"):
            raise ValueError("monotonic must be auto, ascending, descending or none")
        if self.prebinning not in ("cart", "quantile"):
            raise ValueError("prebinning must be cart or quantile")
        if not 0 < self.min_prebin_size < 1:
            raise ValueError("min_prebin_size must lie between 0 and 1")


def best_merge(good: np.ndarray, bad: np.ndarray, total: tuple[float, float], rows: float, p: OptimalParams) -> list[int] | None:
    """End positions of the contiguous merge with the largest IV, or None.

    Dynamic programme over (last bin's start, end, number of bins); the bad
    rates of neighbouring bins respect the trend.
    """
    m = len(good)
    cg, cb = np.concatenate([[0], np.cumsum(good)]), np.concatenate([[0], np.cumsum(bad)])
    start, end = np.meshgrid(np.arange(m + 1), np.arange(m + 1), indexing="ij")
    g, b = cg[end] - cg[start], cb[end] - cb[start]
    allowed = (end > start) & (g >= max(p.min_nonevents, 1)) & (b >= max(p.min_events, 1)) & (g + b >= p.min_bin_size * rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gd, bd = g / total[0], b / total[1]
        iv = np.where(allowed, (gd - bd) * np.log(gd / bd), -np.inf)
        rate = np.where(allowed, b / (g + b), np.nan)
    best: tuple[float, list[int]] | None = None
    trends = {"auto": ("ascending", "descending"), "none": ("none",)}.get(p.monotonic, (p.monotonic,))
    for trend in trends:
        # value[i, j]: best IV of bins covering [0, j) whose last bin is [i, j)
        value = np.where(start == 0, iv, -np.inf)
        history: list[np.ndarray] = []
        for size in range(1, p.max_bins + 1):
            if size > 1:
                following = np.full_like(value, -np.inf)
                origin = np.zeros(value.shape, dtype=int)
                for i in range(1, m):
                    before, before_rate = value[:i, i], rate[:i, i]
                    if not np.isfinite(before).any():
                        continue
                    for j in range(i + 1, m + 1):
                        if not allowed[i, j]:
                            continue
                        fits = np.isfinite(before)
                        if trend == "ascending":
                            fits &= before_rate <= rate[i, j]
                        elif trend == "descending":
                            fits &= before_rate >= rate[i, j]
                        if fits.any():
                            h = int(np.argmax(np.where(fits, before, -np.inf)))
                            following[i, j] = before[h] + iv[i, j]
                            origin[i, j] = h
                history.append(origin)
                value = following
            if size >= p.min_bins and np.isfinite(value[:, m]).any():
                i = int(np.argmax(value[:, m]))
                if best is None or value[i, m] > best[0] + 1e-12:
                    ends, a, z = [m], i, m
                    for back in reversed(history[: size - 1]):
                        ends.append(a)
                        a, z = int(back[a, z]), a
                    best = (float(value[i, m]), sorted(ends))
    return best[1] if best else None


_MERGED = "variable string, position int, bin int, status string"


def _merge_table(params: OptimalParams):
    def merge(table: pd.DataFrame) -> pd.DataFrame:
        t = table.sort_values("position")
        good, bad = t["good_count"].to_numpy(float), t["bad_count"].to_numpy(float)
        total, rows = (float(t["total_good"].iloc[0]), float(t["total_bad"].iloc[0])), float(t["total_rows"].iloc[0])
        ends = best_merge(good, bad, total, rows, params)
        status = "OPTIMAL" if ends else "INFEASIBLE"
        bins = np.searchsorted(np.array(ends or [len(t)]), np.arange(len(t)), side="right")
        return pd.DataFrame({"variable": t["variable"], "position": t["position"], "bin": bins, "status": status})

    return merge


def fit_optimal_bins(
    df: DataFrame,
    target: TargetSpec,
    columns: Sequence[str],
    params: OptimalParams = OptimalParams(),
    special_codes: Mapping[str, Sequence[float]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(bins, status)``; numeric bins are ``[lo, hi)``.

    Rows are only counted per pre-bin; merging happens on those count tables,
    one variable per group.  A variable that cannot meet the constraints, or a
    numeric one left with a single unbounded bin, is rejected in ``status``.
    """
    special = {k: [float(x) for x in v] for k, v in (special_codes or {}).items()}
    numeric = [c for c in numeric_columns(df) if c in columns]
    texts = [c for c in columns if c not in numeric]
    flagged = df.filter(target.is_known).withColumns({"_good": target.is_good, "_bad": target.is_bad})
    counts = []
    breaks: dict[str, list[float]] = {}
    if numeric:
        prebins = _cart_prebins if params.prebinning == "cart" else _numeric_prebins
        counts.append(prebins(flagged, numeric, target, params, special, breaks))
    if texts:
        counts.append(_text_prebins(flagged, texts, target, params))
    table = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    # kind: pre (ordered pre-bins), missing, special, other
    sums = Window.partitionBy("variable")
    table = materialise(
        table.withColumns(
            {
                "total_rows": F.sum("row_count").over(sums),
                "total_good": F.sum("good_count").over(sums),
                "total_bad": F.sum("bad_count").over(sums),
            }
        )
    )
    merged = (
        table.filter("kind = 'pre'")
        .select("variable", "position", "good_count", "bad_count", "total_rows", "total_good", "total_bad")
        .groupBy("variable")
        .applyInPandas(_merge_table(params), _MERGED)
    )
    cells = table.join(merged, ["variable", "position"], "left")
    return _assemble(df, collect_state(cells, what="pre-bins"), columns, numeric, breaks, special)


def _numeric_prebins(flagged, numeric, target, params, special, breaks) -> DataFrame:
    plain = flagged
    for c, codes in special.items():
        if c in numeric:
            plain = plain.withColumn(c, F.when(col(c).isin(*codes), F.lit(None)).otherwise(col(c)))
    probs = [k / params.max_prebins for k in range(1, params.max_prebins)]
    for r in collect_state(quantile_arrays(exact_quantiles(plain, numeric, probs)), what="pre-bin breaks"):
        breaks[r.variable] = list(r.breaks)
    entries = []
    for c in numeric:
        x = f"cast({quote(c)} AS double)"
        codes = ", ".join(sql_number(v) for v in special.get(c, []))
        marked = f"WHEN {x} IN ({codes}) THEN -2 " if codes else ""
        place = sql_position(x, breaks.get(c, []), left_closed=True)
        entries.append(
            f"struct({sql_text(c)} AS variable, CASE WHEN {x} IS NULL THEN -1 {marked}ELSE {place} END AS position)"
        )
    kind = F.when(F.col("position") == -1, "missing").when(F.col("position") == -2, "special").otherwise("pre")
    return (
        flagged.select("_good", "_bad", F.expr(f"inline(array({', '.join(entries)}))"))
        .groupBy("variable", "position")
        .agg(*_tally())
        .withColumns({"kind": kind, "level": F.lit(None).cast("string")})
    )


def _cart_prebins(flagged, numeric, target, params, special, breaks) -> DataFrame:
    """Distinct values are counted once; trees, pre-bins and the missing and special cells come from those counts."""
    long = unpivot_values(flagged, numeric, ["_good", "_bad"])
    marked = [(F.col("variable") == c) & F.col("value").isin(*codes) for c, codes in special.items() if c in numeric and codes]
    kind = F.when(F.col("value").isNull() | F.isnan("value"), "missing")
    for mark in marked:
        kind = kind.when(mark, "special")
    counts = materialise(long.groupBy("variable", "value").agg(*_tally()).withColumn("kind", kind.otherwise("pre")))
    plain = counts.filter("kind = 'pre'").drop("kind")
    cells, found = cart_breaks(plain, leaves=params.max_prebins, min_size=params.min_prebin_size)
    breaks.update(found)
    rest = counts.filter("kind <> 'pre'").groupBy("variable", "kind").agg(*[F.sum(c).alias(c) for c in ("row_count", "good_count", "bad_count")])
    rest = rest.withColumn("position", F.when(F.col("kind") == "missing", -1).otherwise(-2))
    both = cells.withColumn("kind", F.lit("pre")).unionByName(rest)
    return both.select("variable", "position", "row_count", "good_count", "bad_count", "kind", F.lit(None).cast("string").alias("level"))


def _text_prebins(flagged, texts, target, params) -> DataFrame:
    """Levels in bad-rate order; levels under the cut-off are pooled before anything is collected."""
    long = unpivot_values(flagged, texts, ["_good", "_bad"], cast="string")
    counts = materialise(long.groupBy("variable", "value").agg(*_tally()))
    totals = counts.groupBy("variable").agg(F.sum("row_count").alias("n"))
    rare = F.col("row_count") < F.lit(params.cat_cutoff) * F.col("n")
    pooled = (
        counts.join(totals, "variable")
        .withColumn(
            "kind",
            F.when(F.col("value").isNull(), "missing").when(rare, "other").otherwise("pre"),
        )
        .withColumn("level", F.when(F.col("kind") == "pre", F.col("value")))
        .groupBy("variable", "kind", "level")
        .agg(*[F.sum(c).alias(c) for c in ("row_count", "good_count", "bad_count")])
    )
    order = Window.partitionBy("variable", "kind").orderBy(F.col("bad_count") / F.col("row_count"), "level")
    return pooled.withColumn(
        "position",
        F.when(F.col("kind") == "pre", F.row_number().over(order) - 1).when(F.col("kind") == "missing", -1).otherwise(-3),
    ).select("variable", "position", "row_count", "good_count", "bad_count", "kind", "level")


def _assemble(df, cells, columns, numeric, breaks, special) -> tuple[DataFrame, DataFrame]:
    fields = [f.strip().split(" ")[0] for f in BINS_SCHEMA.split(",")]
    add = lambda rows: {k: sum(r[k] for r in rows) for k in ("row_count", "good_count", "bad_count")}
    bins, states = [], []
    for c in columns:
        mine = [r for r in cells if r.variable == c]
        kind = "numeric" if c in numeric else "categorical"
        pre = sorted((r for r in mine if r.kind == "pre"), key=lambda r: r.position)
        status = pre[0].status if pre else "NO_VALUES"
        groups: dict[int, list] = {}
        for r in pre:
            groups.setdefault(r.bin, []).append(r)
        reason = "" if status == "OPTIMAL" else "no merge meets the constraints"
        if status == "OPTIMAL" and kind == "numeric" and len(groups) == 1:
            status, reason = "REJECTED", "single unbounded bin"
        states.append((c, kind, status, len(groups) if status == "OPTIMAL" else 0, reason))
        if status != "OPTIMAL":
            continue
        order = 0
        for special_kind, flag in (("missing", "is_missing"), ("special", "is_special")):
            found = [r for r in mine if r.kind == special_kind]
            if found:
                order += 1
                extra = {"categories": [str(x) for x in special[c]]} if special_kind == "special" else {}
                bins.append(_bin_row(c, kind, order, special_kind.title(), add(found), **{flag: True}, **extra))
        ordered = [groups[k] for k in sorted(groups)]
        for i, rows in enumerate(ordered):
            order += 1
            if kind == "numeric":
                lower = breaks[c][rows[0].position - 1] if i > 0 else None
                upper = breaks[c][rows[-1].position] if i < len(ordered) - 1 else None
                left = "(-inf" if lower is None else f"[{lower:g}"
                label = f"{left}, " + ("+inf)" if upper is None else f"{upper:g})")
                extra = {"lower": lower, "upper": upper, "lower_inclusive": lower is not None}
            else:
                levels = sorted(r.level for r in rows)
                label, extra = ", ".join(levels), {"categories": levels}
            bins.append(_bin_row(c, kind, order, label, add(rows), **extra))
        other = [r for r in mine if r.kind == "other"]
        if other:
            bins.append(_bin_row(c, kind, order + 1, "Other", add(other), is_other=True))
    return (
        constants(df, [tuple(r[f] for f in fields) for r in bins], BINS_SCHEMA),
        constants(df, states, "variable string, kind string, status string, n_bins int, reason string"),
    )

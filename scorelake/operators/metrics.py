"""Discrimination, calibration and stability of scored samples, per role."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import col, constants, count_if, null_safe_join, ratio
from scorelake.functions.ordered import exact_quantiles, quantile_arrays, running_totals
from scorelake.functions.placing import place
from scorelake.functions.special import chi_square_tail
from scorelake.functions.state import collect_state, materialise, small_side
from scorelake.functions.target import TargetSpec

PROBABILITY = "predicted_bad_probability"
SCORE = "score"
# Cells a pass divides every interval of a group end into.
END_CELLS = 4096


def labelled(df: DataFrame, target: TargetSpec, *columns: str) -> DataFrame:
    """Known rows as ``(role, y, columns...)``; undeclared outcomes are left out."""
    return df.filter(target.is_known).select(
        "role", F.when(target.is_bad, F.lit(1)).otherwise(F.lit(0)).alias("y"), *[col(c) for c in columns]
    )


def value_counts(known: DataFrame, value: str) -> DataFrame:
    """``(role, value, n, bad, good)``: one row per role and distinct value."""
    return known.groupBy("role", col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("y").cast("long")).alias("bad"),
        F.sum((F.lit(1) - F.col("y")).cast("long")).alias("good"),
    )


def score_ranking(df: DataFrame, target: TargetSpec, value: str) -> DataFrame:
    """Value counts with the good and bad rows below each value."""
    return running_totals(value_counts(labelled(df, target, value), value), "value", ["good", "bad"], ["role"])


def auc_gini(ranking: DataFrame) -> DataFrame:
    """Exact rank AUC with ties counted half; null for a single-class role."""
    wins = F.sum(F.col("bad").cast("double") * (F.col("before_good") + F.col("good") * F.lit(0.5)))
    pairs = F.max("total_bad").cast("double") * F.max("total_good")
    return ranking.groupBy("role").agg(
        F.max("total_bad").alias("bad_count"),
        F.max("total_good").alias("good_count"),
        F.round(F.when(pairs > 0, wins / pairs), 6).alias("auc"),
    ).withColumn("gini", F.round(F.lit(2.0) * F.col("auc") - F.lit(1.0), 6))


def ks(ranking: DataFrame) -> DataFrame:
    """Largest gap of the cumulative shares, evaluated after each distinct score."""
    gap = F.abs(
        (F.col("before_good") + F.col("good")) / F.col("total_good")
        - (F.col("before_bad") + F.col("bad")) / F.col("total_bad")
    )
    usable = ranking.filter("total_good > 0 AND total_bad > 0")
    best = usable.groupBy("role").agg(F.max(F.struct(gap.alias("gap"), (-F.col("value")).alias("minus"))).alias("b"))
    return best.select(
        "role", F.round("b.gap", 6).alias("ks"), F.round(-F.col("b.minus"), 2).alias("ks_at_score")
    )


def confusion_at(df: DataFrame, target: TargetSpec, cutoffs: Sequence[float]) -> DataFrame:
    """Confusion counts and rates per role and probability cut-off, one pass."""
    known = labelled(df, target, PROBABILITY)
    p, bad = F.col(PROBABILITY), F.col("y") == 1
    counts = known.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(bad).alias("n_bad"),
        *[count_if(bad & (p >= F.lit(float(c)))).alias(f"tp_{i}") for i, c in enumerate(cutoffs)],
        *[count_if(~bad & (p >= F.lit(float(c)))).alias(f"fp_{i}") for i, c in enumerate(cutoffs)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("cutoff"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp")
            )
            for i, c in enumerate(cutoffs)
        ]
    )
    table = counts.select("role", "n", "n_bad", F.inline(rows)).select(
        "role", "cutoff", "tp", "fp",
        (F.col("n_bad") - F.col("tp")).alias("fn"),
        (F.col("n") - F.col("n_bad") - F.col("fp")).alias("tn"),
    )
    return with_rates(table)


def with_rates(table: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = table.withColumns(
        {
            "accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), 6),
            "precision": F.round(ratio(tp, tp + fp), 6),
            "recall": F.round(ratio(tp, tp + fn), 6),
            "specificity": F.round(ratio(tn, tn + fp), 6),
            "f1": F.round(ratio(tp * 2, tp * 2 + fp + fn), 6),
        }
    )
    return rated.withColumn("g_mean", F.round(F.sqrt(F.col("recall") * F.col("specificity")), 6))


def _quantile_bins(known: DataFrame, value: str, bins: int) -> DataFrame:
    probs = [k / bins for k in range(1, bins)]
    breaks = quantile_arrays(exact_quantiles(known, [value], probs, ["role"]), ["role"])
    return place(known, value, breaks, ["role"])


def calibration_deciles(df: DataFrame, target: TargetSpec, bins: int = 10) -> DataFrame:
    """Rows, mean probability and actual bad rate per quantile bin, numbered in score order."""
    placed = _quantile_bins(labelled(df, target, PROBABILITY), PROBABILITY, bins)
    counts = placed.groupBy("role", "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(PROBABILITY), 6).alias("avg_predicted_probability"),
        F.round(F.avg("y"), 6).alias("actual_bad_rate"),
    )
    order = Window.partitionBy("role").orderBy("bin")
    return counts.withColumn("bin", F.row_number().over(order) - F.lit(1))


def calibration_curve(df: DataFrame, target: TargetSpec, bins: int = 10) -> DataFrame:
    """Points of the quantile calibration curve."""
    deciles = calibration_deciles(df, target, bins)
    return deciles.select(
        "role",
        "bin",
        F.col("actual_bad_rate").alias("prob_true"),
        F.col("avg_predicted_probability").alias("prob_pred"),
    )


def _group_ends(ranked: DataFrame, sizes: dict[str, tuple[int, int]]) -> dict[str, list[int]]:
    """Where groups end: each at the first running total ``upto`` that fills ``size`` rows beyond the end before it.

    ``sizes`` gives ``(rows, size)`` per role.  A pass finds the first and last total in each of
    ``END_CELLS`` equal cells and so an interval for every end at once; the next pass looks into those
    intervals only.  Passes grow with the logarithm of the rows: two for a million, three for a billion.
    """
    regions = [(role, 0, 1, n) for role, (n, _) in sizes.items()]
    limits: dict[tuple[str, int], tuple[int, int]] = {}
    cells: dict[tuple[str, int], list[tuple[int, int]]] = {}
    while regions:
        table = constants(ranked, regions, "role string, grp int, lo long, hi long").withColumnRenamed("role", "_role")
        inside = F.col("role").eqNullSafe(F.col("_role")) & F.col("upto").between(F.col("lo"), F.col("hi"))
        cell = F.expr(f"((upto - lo) * {END_CELLS}) div (hi - lo + 1)")
        found = ranked.join(F.broadcast(table), inside).groupBy("role", "grp", cell.alias("cell"))
        cells = {}
        for r in found.agg(F.min("upto").alias("first"), F.max("upto").alias("last")).collect():
            cells.setdefault((r.role, r.grp), []).append((r.first, r.last))
        for blocks in cells.values():
            blocks.sort()
        regions = []
        for role, (n, size) in sizes.items():
            low = high = grp = 0
            while low < n:
                grp += 1
                blocks = cells.get((role, grp)) or (cells.get((role, 0)) if (role, grp) not in limits else None)
                if blocks:
                    limits[role, grp] = (_reached(blocks, min(low + size, n))[0], _reached(blocks, min(high + size, n))[1])
                low, high = limits[role, grp]
                if low < high:
                    regions.append((role, grp, low, high))
            limits = {key: v for key, v in limits.items() if key[0] != role or key[1] <= grp}
    return {role: [0] + [limits[key][0] for key in sorted(limits) if key[0] == role] for role in sizes}


def _reached(blocks: list[tuple[int, int]], goal: int) -> tuple[int, int]:
    """Bounds of the first total of at least ``goal``, given the first and last total of every cell in order."""
    first, last = blocks[bisect_left(blocks, goal, key=lambda b: b[1])]
    return (first, first) if first >= goal else (goal, last)


def hosmer_lemeshow(df: DataFrame, target: TargetSpec) -> DataFrame:
    """Hosmer-Lemeshow statistic on up to ten groups that never split a tied probability.

    Each group ends at the first tie block that fills it.
    """
    counts = value_counts(labelled(df, target, PROBABILITY), PROBABILITY).withColumn(
        "expected", F.col("n") * F.col("value")
    )
    ranked = materialise(
        running_totals(counts, "value", ["n"], ["role"]).withColumn("upto", F.col("before_n") + F.col("n"))
    )
    sizes = {}
    for r in collect_state(ranked.groupBy("role").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))):
        if r.n >= 2 and 0 < r.bad < r.n:
            groups = max(2, min(10, r.n // 5))
            sizes[r.role] = (r.n, max(1, -(-r.n // groups)))
    ends = _group_ends(ranked, sizes)
    breaks = constants(
        df, [(role, [float(e) for e in es[1:-1]]) for role, es in ends.items()], "role string, breaks array<double>"
    )
    grouped = place(
        ranked.join(F.broadcast(breaks.select("role")), "role", "left_semi"), "upto", breaks, ["role"], "grp"
    ).groupBy("role", "grp").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("observed"), F.sum("expected").alias("expected")
    )
    events = F.pow(F.col("observed") - F.col("expected"), 2)
    quiet = F.col("n") - F.col("expected")

    def part(expected: Column, observed: Column) -> Column:
        return F.when(expected > 1e-12, events / expected).otherwise(
            F.when(observed == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
        )

    deviation = F.round(F.abs(F.col("observed") / F.col("n") - F.col("expected") / F.col("n")), 6)
    totals = grouped.groupBy("role").agg(
        F.sum("n").alias("known_count"),
        F.count(F.lit(1)).alias("n_bins"),
        F.sum(part(F.col("expected"), F.col("observed")) + part(quiet, F.col("n") - F.col("observed"))).alias("stat"),
        F.avg(deviation).alias("calibration_error"),
    )
    return totals.withColumn("degrees_of_freedom", F.greatest(F.lit(1), F.col("n_bins").cast("int") - 2)).select(
        "role", "known_count", "n_bins", F.round("stat", 4).alias("statistic"), "degrees_of_freedom",
        F.round(chi_square_tail("stat", "degrees_of_freedom"), 6).alias("p_value"),
        F.round("calibration_error", 6).alias("calibration_error"),
    )


def score_distribution(df: DataFrame, target: TargetSpec) -> DataFrame:
    """Mean, spread and percentiles of the score per role (known rows)."""
    known = labelled(df, target, SCORE)
    moments = known.groupBy("role").agg(
        F.round(F.avg(SCORE), 2).alias("mean"),
        F.round(F.min(SCORE), 2).alias("min"),
        F.round(F.max(SCORE), 2).alias("max"),
        F.round(F.stddev_pop(SCORE), 2).alias("std"),
    )
    shown = {0.05: "p5", 0.25: "p25", 0.5: "median", 0.75: "p75", 0.95: "p95"}
    points = exact_quantiles(known, [SCORE], list(shown), ["role"])
    wide = points.groupBy("role").agg(
        *[F.round(F.max(F.when(F.col("p") == F.lit(p), F.col("q"))), 2).alias(name) for p, name in shown.items()]
    )
    return null_safe_join(moments, wide, ["role"])


def psi(df: DataFrame, target: TargetSpec, value: str = SCORE, baseline: str = "train", bins: int = 10) -> DataFrame:
    """Population stability of every other role against the baseline's deciles.

    Bins are ``[lo, hi)``.  A baseline with at most one distinct break has PSI 0.
    An empty bin counts as half a row and is reported.  Without baseline rows the
    other roles have no PSI (null).
    """
    known = labelled(df, target, value)
    base = known.filter(F.col("role") == baseline)
    probs = [k / bins for k in range(1, bins)]
    breaks = quantile_arrays(exact_quantiles(base, [value], probs)).select("breaks")
    first = breaks.first()
    if first is None:
        others = known.filter(F.col("role") != baseline).select("role").distinct()
        unknown = F.lit(None).cast("double").alias("psi")
        return others.select(F.lit(baseline).alias("baseline"), "role", unknown, F.lit(0).cast("long").alias("empty_bins"))
    edges = first.breaks
    counts = small_side(
        place(known, value, breaks, left_closed=True).groupBy("role", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("role").agg(F.sum("n").alias("total"))
    slots = F.sequence(F.lit(0), F.lit(len(edges)))
    every = totals.select("role", "total", F.explode(slots).alias("bin"))
    full = null_safe_join(every, counts, ["role", "bin"], "left").fillna(0, ["n"])
    expected = full.filter(F.col("role") == baseline).select(
        "bin", F.col("n").alias("en"), F.col("total").alias("etotal")
    )
    pairs = full.filter(F.col("role") != baseline).join(expected, "bin")
    ep = F.when(F.col("en") == 0, F.lit(0.5) / F.col("etotal")).otherwise(F.col("en") / F.col("etotal"))
    ap = F.when(F.col("n") == 0, F.lit(0.5) / F.col("total")).otherwise(F.col("n") / F.col("total"))
    term = (ap - ep) * F.log(ap / ep)
    flat = F.lit(len(edges) <= 1)
    return pairs.groupBy("role").agg(
        F.round(F.when(flat, F.lit(0.0)).otherwise(F.sum(term)), 6).alias("psi"),
        count_if((F.col("n") == 0) | (F.col("en") == 0)).alias("empty_bins"),
    ).select(F.lit(baseline).alias("baseline"), "role", "psi", "empty_bins")


def target_availability(df: DataFrame, target: TargetSpec) -> DataFrame:
    """Per role: known and unknown rows and whether metrics can be computed."""
    if target.column not in df.columns:
        return df.groupBy("role").agg(F.count(F.lit(1)).alias("row_count")).select(
            "role", "row_count", F.lit(0).cast("long").alias("known_count"),
            F.lit(None).cast("long").alias("unknown_count"), F.lit(0).cast("long").alias("bad_count"),
            F.lit(0).cast("long").alias("good_count"), F.lit("MISSING_TARGET_COLUMN").alias("status"),
        )
    counts = df.groupBy("role").agg(
        F.count(F.lit(1)).alias("row_count"),
        count_if(target.is_known).alias("known_count"),
        count_if(~target.is_known).alias("unknown_count"),
        count_if(target.is_bad).alias("bad_count"),
        count_if(target.is_good).alias("good_count"),
    )
    return counts.withColumn(
        "status",
        F.when(F.col("known_count") == 0, F.lit("NO_KNOWN_TARGET_VALUES"))
        .when(F.col("bad_count") == 0, F.lit("SINGLE_CLASS_ONLY_GOOD"))
        .when(F.col("good_count") == 0, F.lit("SINGLE_CLASS_ONLY_BAD"))
        .when(F.col("unknown_count") > 0, F.lit("UNKNOWN_TARGET_VALUES"))
        .otherwise(F.lit("ok")),
    )


def validation_gates(
    auc: DataFrame,
    stability: DataFrame,
    availability: DataFrame,
    min_auc: float | None = None,
    max_psi: float | None = None,
    require_test: bool = True,
    require_oot: bool = False,
) -> DataFrame:
    """``(gate, role, status)`` from the metric tables."""
    present = availability.agg(*[count_if(F.col("role") == r).alias(r) for r in ("train", "test", "oot")])
    absent = {"train": "fail", "test": "fail" if require_test else "pass", "oot": "fail" if require_oot else "warning"}
    samples = present.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{r.upper()}_SAMPLE_PRESENT").alias("gate"),
                        F.lit(r).alias("role"),
                        F.when(F.col(r) > 0, F.lit("pass")).otherwise(F.lit(absent[r])).alias("status"),
                    )
                    for r in absent
                ]
            )
        )
    )
    usable = availability.select(
        F.lit("TARGET_AVAILABLE").alias("gate"),
        "role",
        F.when(F.col("known_count") > 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
    )
    gates = samples.unionByName(usable)
    if min_auc is not None:
        passed = F.col("auc").isNull() | (F.col("auc") >= F.lit(float(min_auc)))
        gates = gates.unionByName(
            auc.select(
                F.lit("MINIMUM_AUC").alias("gate"), "role",
                F.when(passed, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
            )
        )
    if max_psi is not None:
        passed = F.col("psi").isNull() | (F.col("psi") <= F.lit(float(max_psi)))
        gates = gates.unionByName(
            stability.select(
                F.lit("MAXIMUM_PSI").alias("gate"), "role",
                F.when(passed, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
            )
        )
    return gates

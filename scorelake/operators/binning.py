"""Fine classing, bin assignment, bin summaries and manual bin edits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import (
    constants,
    count_if,
    null_safe_join,
    numeric_columns,
    quote,
    ratio,
    sql_number,
    sql_search,
    sql_text,
)
from scorelake.functions.ordered import exact_quantiles
from scorelake.functions.state import collect_state, materialise
from scorelake.functions.target import TargetSpec
from scorelake.operators.counting import MISSING, chunks, interval_counts, place_counts

SKETCHED = 64  # columns whose quantiles are sketched together

BINS_SCHEMA = (
    "variable string, kind string, bin_id string, bin_order int, label string, "
    "lower double, upper double, lower_inclusive boolean, upper_inclusive boolean, "
    "categories array<string>, is_missing boolean, is_special boolean, is_other boolean, "
    "row_count long, good_count long, bad_count long"
)


@dataclass(frozen=True)
class BinningParams:
    max_bins: int = 20
    min_bin_fraction: float = 0.05
    missing_policy: str = "separate_bin"
    max_categorical_levels: int = 50

    def __post_init__(self) -> None:
        if self.max_bins < 2:
            raise ValueError("max_bins must be at least 2")
        if not 0 < self.min_bin_fraction < 1:
            raise ValueError("min_bin_fraction must lie between 0 and 1")
        if self.missing_policy not in ("separate_bin", "ignore"):
            raise ValueError("missing_policy must be separate_bin or ignore")
        if self.max_categorical_levels < 1:
            raise ValueError("max_categorical_levels must be at least 1")


def _tally() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("row_count"),
        count_if(F.col("_good")).alias("good_count"),
        count_if(F.col("_bad")).alias("bad_count"),
    ]


def fit_bins(
    df: DataFrame,
    target: TargetSpec,
    params: BinningParams = BinningParams(),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Bins of every variable: equal-frequency for numbers, levels for the rest.

    Numeric bins are ``(lower, upper]`` with open ends; empty ones are dropped.
    Breaks take two passes over a chunk of columns; one more counts its intervals or levels.
    """
    names = [c for c in (columns or df.columns) if c != target.column]
    numeric = [c for c in numeric_columns(df) if c in names]
    categorical = [c for c in names if c not in numeric]
    breaks = numeric_breaks(df, numeric, params, df.count()) if numeric else {}
    cells = interval_counts(df, numeric, breaks, target) if numeric else {}
    sums: dict[tuple[str, bool], Row | dict] = {}
    found: dict[str, list[Row]] = {}
    limit = max(params.max_categorical_levels, params.max_bins)
    for part in chunks(categorical):
        pairs = ", ".join(f"struct({sql_text(c)} AS variable, cast({quote(c)} AS string) AS value)" for c in part)
        counts = materialise(
            df.select(target.is_good.alias("_good"), target.is_bad.alias("_bad"), F.expr(f"inline(array({pairs}))"))
            .groupBy("variable", "value")
            .agg(*_tally())
        )
        # Top levels: the row_number limit is applied before the shuffle as well.
        by_size = Window.partitionBy("variable").orderBy(F.desc("row_count"), F.asc("value"))
        levels = (
            counts.filter("value IS NOT NULL")
            .withColumn("rank", F.row_number().over(by_size))
            .filter(F.col("rank") <= limit)
        )
        whole = counts.groupBy("variable", F.expr("value IS NULL AS missing")).agg(
            *[F.sum(c).alias(c) for c in ("row_count", "good_count", "bad_count")]
        )
        sums |= {(r.variable, r.missing): r for r in collect_state(whole)}
        for r in collect_state(levels, what="bins"):
            found.setdefault(r.variable, []).append(r)
    for c, intervals in cells.items():
        if MISSING in intervals:
            sums[c, True] = intervals.pop(MISSING)
        if intervals:
            sums[c, False] = {n: sum(i[n] for i in intervals.values()) for n in ("row_count", "good_count", "bad_count")}
    first = [r for (v, _), r in sums.items() if v == names[0]] if names else []
    if not sum(r["good_count"] for r in first) or not sum(r["bad_count"] for r in first):
        raise ValueError("binning needs at least one good and one bad row")
    rows: list[dict] = []
    for c in names:
        missing = sums.get((c, True)) if params.missing_policy == "separate_bin" else None
        if missing is not None:
            kind = "numeric" if c in numeric else "categorical"
            rows.append(_bin_row(c, kind, 1, "Missing", missing, is_missing=True))
        start = 1 if missing is not None else 0
        if c in numeric:
            rows += _interval_bins(c, start, breaks.get(c), cells[c])
        elif (c, False) in sums:
            rows += _level_bins(c, start, sums[(c, False)], found[c], params)
    fields = [f.strip().split(" ")[0] for f in BINS_SCHEMA.split(",")]
    return constants(df, [tuple(r[f] for f in fields) for r in rows], BINS_SCHEMA)


def _bin_row(variable: str, kind: str, order: int, label: str, counts: Row | dict, **extra) -> dict:
    base = {
        "variable": variable,
        "kind": kind,
        "bin_id": f"{variable}_bin_{order:03d}",
        "bin_order": order,
        "label": label,
        "lower": None,
        "upper": None,
        "lower_inclusive": False,
        "upper_inclusive": False,
        "categories": None,
        "is_missing": False,
        "is_special": False,
        "is_other": False,
        "row_count": counts["row_count"],
        "good_count": counts["good_count"],
        "bad_count": counts["bad_count"],
    }
    base.update(extra)
    return base


def numeric_breaks(
    df: DataFrame, columns: Sequence[str], params: BinningParams, total_rows: int
) -> dict[str, list[float]]:
    """Distinct equal-frequency breaks of each column (at most max_bins - 1)."""
    separate = params.missing_policy == "separate_bin"
    sizes = {params.max_bins} | ({params.max_bins - 1} if separate else set())
    probs = {k / size for size in sizes for k in range(1, size)}
    found: dict[str, dict[float, float]] = {}
    filled: dict[str, int] = {}
    for part in chunks(columns, SKETCHED):
        for r in collect_state(exact_quantiles(df, part, sorted(probs)), what="breaks"):
            found.setdefault(r.variable, {})[r.p] = r.q
            filled[r.variable] = r.n
    breaks: dict[str, list[float]] = {}
    for c in columns:
        n = filled.get(c, 0)
        bins = params.max_bins - (1 if separate and n < total_rows else 0)
        if n == 0 or bins <= 0:
            continue
        if n < bins:
            few = exact_quantiles(df, [c], [k / n for k in range(1, n)]) if n > 1 else None
            breaks[c] = sorted({r.q for r in few.collect()}) if few is not None else []
        else:
            breaks[c] = sorted({found[c][k / bins] for k in range(1, bins)})
    return breaks


def _interval_label(lower: float | None, upper: float | None) -> str:
    if lower is None and upper is None:
        return "All values"
    left = "(-inf" if lower is None else f"({lower:.4g}"
    right = "+inf)" if upper is None else f"{upper:.4g}]"
    return f"{left}, {right}"


def _interval_bins(c: str, start: int, breaks: list[float] | None, tallies: Mapping[int, dict]) -> list[dict]:
    """Bins of one numeric variable; a break between two empty intervals is dropped."""
    if breaks is None:
        return []
    filled = sorted(tallies)
    rows = []
    for position, i in enumerate(filled):
        lower = breaks[filled[position - 1]] if position > 0 else None
        upper = breaks[i] if position < len(filled) - 1 else None
        rows.append(
            _bin_row(
                c,
                "numeric",
                start + position + 1,
                _interval_label(lower, upper),
                tallies[i],
                lower=lower,
                upper=upper,
                upper_inclusive=upper is not None,
            )
        )
    return rows


def _level_bins(c: str, start: int, whole: Row, found: Sequence[Row], params: BinningParams) -> list[dict]:
    """The largest levels of one variable, then "Other" for the rest."""
    rest = {k: whole[k] for k in ("row_count", "good_count", "bad_count")}
    rows = []
    for level in sorted(found, key=lambda r: r.rank)[: params.max_categorical_levels]:
        order = start + len(rows) + 1
        rows.append(_bin_row(c, "categorical", order, level.value, level, categories=[level.value]))
        rest = {k: rest[k] - level[k] for k in rest}
    if rest["row_count"] > 0:
        rows.append(_bin_row(c, "categorical", start + len(rows) + 1, "Other", rest, is_other=True))
    return rows


def bin_warnings(bins: DataFrame, params: BinningParams = BinningParams()) -> DataFrame:
    """Numeric bins holding less than ``min_bin_fraction`` of the non-missing rows."""
    filled = Window.partitionBy("variable")
    share = F.col("row_count") / F.sum("row_count").over(filled)
    return (
        bins.filter("kind = 'numeric' AND NOT is_missing AND NOT is_special")
        .select("variable", "bin_id", share.alias("fraction"))
        .filter(F.col("fraction") < params.min_bin_fraction)
    )


# --- assignment -------------------------------------------------------------


def bins_by_variable(bins: DataFrame) -> dict[str, list[Row]]:
    """Bins as driver-side state, in bin order."""
    grouped: dict[str, list[Row]] = {}
    for r in sorted(collect_state(bins, what="bins"), key=lambda r: (r.variable, r.bin_order)):
        grouped.setdefault(r.variable, []).append(r)
    return grouped


@dataclass(frozen=True)
class Dialect:
    """How names, numbers and texts are written."""

    name: Callable[[str], str]
    number: Callable[[float], str]
    text: Callable[[str], str]
    string: str | None = "string"  # type that categories are cast to; None: the column is text


SPARK = Dialect(quote, sql_number, sql_text)


def bin_condition(entry: Row, siblings: Sequence[Row], dialect: Dialect = SPARK) -> str:
    """SQL test that a row's value belongs to the bin."""
    value = dialect.name(entry.variable)
    if entry.is_missing:
        return f"{value} IS NULL"
    if entry.kind == "categorical":
        text = f"cast({value} AS {dialect.string})" if dialect.string else value
        if entry.is_other:
            named = ", ".join(dialect.text(c) for s in siblings for c in (s.categories or []))
            return f"{value} IS NOT NULL" + (f" AND {text} NOT IN ({named})" if named else "")
        if not entry.categories:
            return "1 = 0"
        return f"{text} IN ({', '.join(dialect.text(c) for c in entry.categories)})"
    number = f"cast({value} AS double)"
    if entry.categories:  # special codes of a numeric variable
        return f"{number} IN ({', '.join(dialect.number(c) for c in entry.categories)})"
    tests = [f"{value} IS NOT NULL"]
    if entry.lower is not None:
        tests.append(f"{number} {'>=' if entry.lower_inclusive else '>'} {dialect.number(entry.lower)}")
    if entry.upper is not None:
        tests.append(f"{number} {'<=' if entry.upper_inclusive else '<'} {dialect.number(entry.upper)}")
    special = [dialect.number(c) for s in siblings if s.is_special for c in (s.categories or [])]
    if special:
        tests.append(f"{number} NOT IN ({', '.join(special)})")
    return " AND ".join(tests)


SEARCHED = 4  # neighbouring intervals from which on a value is searched among their ends


def _interval_chain(entries: Sequence[Row], siblings: Sequence[Row]) -> list[Row]:
    """The intervals of a numeric variable, if without gaps they hold every number; else none."""
    chain = [e for e in entries if e.kind != "categorical" and not e.is_missing and not e.categories]
    if len(chain) < SEARCHED or any(s.is_special for s in siblings) or chain[0].lower is not None or chain[-1].upper is not None:
        return []
    for a, b in zip(chain, chain[1:]):
        joined = a.upper is not None and a.upper == b.lower and a.upper_inclusive != b.lower_inclusive
        if not joined or a.upper_inclusive != chain[0].upper_inclusive or (b.upper is not None and not b.upper > a.upper):
            return []
    return chain


def case_by_bin(entries: Sequence[Row], results: Sequence[str], siblings: Sequence[Row] | None = None) -> str:
    """Spark SQL giving the first matching bin's result, null where no bin matches.

    Intervals that follow each other are searched by halving (:func:`sql_search`).
    """
    if not entries:
        raise ValueError("variable has no bins")
    chain = _interval_chain(entries, siblings or entries)
    whens = [f"WHEN {bin_condition(e, siblings or entries)} THEN {r}" for e, r in zip(entries, results) if not any(e is c for c in chain)]
    if chain:
        value, own = SPARK.name(chain[0].variable), [r for e, r in zip(entries, results) if any(e is c for c in chain)]
        ends, closed = [c.upper for c in chain[:-1]], not chain[0].upper_inclusive
        whens.append(f"WHEN {value} IS NOT NULL THEN {sql_search(f'cast({value} AS double)', ends, own, closed)}")
    return f"CASE {' '.join(whens)} END"


ALL_ROWS = "(all rows)"


def bin_counts(df: DataFrame, bins: DataFrame, target: TargetSpec) -> DataFrame:
    """Recount rows, goods and bads per bin on ``df``: one pass for all variables.

    A row with ``variable = ALL_ROWS`` carries the sample totals.
    """
    spec = {v: e for v, e in bins_by_variable(bins).items() if v in df.columns}
    names = {v: [b.bin_id for b in e] for v, e in spec.items()} | {ALL_ROWS: [ALL_ROWS]}
    places = [F.expr(case_by_bin(e, [str(i) for i in range(len(e))])) for e in spec.values()] + [F.lit(0)]
    told = [F.struct(F.lit(v).alias("variable"), F.array(*[F.lit(b) for b in ids]).alias("ids")) for v, ids in names.items()]
    return (
        place_counts(df, places, max(map(len, names.values())), target)
        .withColumn("told", F.get(F.array(*told), F.col("place")))
        .select("told.variable", F.get("told.ids", F.col("interval")).alias("bin_id"), "row_count", "good_count", "bad_count")
    )


# --- summaries and edits ----------------------------------------------------


def bin_summary(woe: DataFrame, bins: DataFrame) -> DataFrame:
    """Per variable: iv, bins, missing rate, smallest bin, largest share, monotonic WOE."""
    in_order = Window.partitionBy("variable").orderBy("bin_order")
    joined = null_safe_join(
        woe, bins.select("variable", "bin_id", "bin_order", "is_missing", "is_special"), ["variable", "bin_id"]
    )
    ordinary = ~F.col("is_missing") & ~F.col("is_special")
    stepped = joined.withColumn(
        "step",
        F.when(
            ordinary,
            F.col("woe")
            - F.last(F.when(ordinary, F.col("woe")), ignorenulls=True).over(
                in_order.rowsBetween(Window.unboundedPreceding, -1)
            ),
        ),
    )
    total = F.sum("row_count")
    return stepped.groupBy("variable").agg(
        F.round(F.sum("iv_component"), 6).alias("iv"),
        F.count(F.lit(1)).alias("n_bins"),
        F.round(ratio(F.sum(F.when(F.col("is_missing"), F.col("row_count")).otherwise(0)), total), 6).alias(
            "missing_rate"
        ),
        F.min(F.when(~F.col("is_missing"), F.col("row_count"))).alias("min_bin_count"),
        F.round(ratio(F.max(F.when(~F.col("is_missing"), F.col("row_count"))), total), 6).alias("max_bin_pct"),
        (
            F.coalesce(F.min("step") >= 0, F.lit(True)) | F.coalesce(F.max("step") <= 0, F.lit(True))
        ).alias("monotonic"),
    )


def bin_diagnostics(woe: DataFrame, bins: DataFrame, min_rows: int = 30, min_bins: int = 2) -> DataFrame:
    """One row per variable: few, sparse and pure bins and whether WOE is monotonic."""
    in_order = Window.partitionBy("variable").orderBy("bin_order")
    joined = null_safe_join(woe, bins.select("variable", "bin_id", "bin_order"), ["variable", "bin_id"])
    stepped = joined.withColumn("step", F.col("woe") - F.lag("woe").over(in_order))
    pure_good = (F.col("good_count") > 0) & (F.col("bad_count") == 0)
    pure_bad = (F.col("bad_count") > 0) & (F.col("good_count") == 0)
    return stepped.groupBy("variable").agg(
        F.count(F.lit(1)).alias("bin_count"),
        (F.count(F.lit(1)) < min_bins).alias("too_few_bins"),
        count_if(F.col("row_count") < min_rows).alias("sparse_bins"),
        count_if(pure_good).alias("pure_good_bins"),
        count_if(pure_bad).alias("pure_bad_bins"),
        F.when(F.count(F.lit(1)) < 3, F.lit("insufficient_bins"))
        .when((F.min("step") >= 0) | (F.max("step") <= 0), F.lit("monotonic"))
        .otherwise(F.lit("non_monotonic"))
        .alias("monotonic_status"),
    )


def bin_preview(bins: DataFrame, empty_woe: float = 10.0) -> DataFrame:
    """WOE as ln(bad share / good share), the analyst's preview sign.

    Without goods the preview shows -10, without bads +10 (fixed values).
    """
    per_variable = Window.partitionBy("variable")
    good_share = ratio(F.col("good_count"), F.sum("good_count").over(per_variable))
    bad_share = ratio(F.col("bad_count"), F.sum("bad_count").over(per_variable))
    return bins.select(
        "variable", "bin_id", "bin_order", "row_count", "good_count", "bad_count",
        good_share.alias("good_share"), bad_share.alias("bad_share"),
    ).select(
        "variable",
        "bin_id",
        "bin_order",
        "row_count",
        F.round(ratio(F.col("bad_count"), F.col("row_count")), 6).alias("event_rate"),
        F.round(
            F.when(F.col("good_share") <= 0, F.lit(-empty_woe))
            .when(F.col("bad_share") <= 0, F.lit(empty_woe))
            .otherwise(F.log(F.col("bad_share") / F.col("good_share"))),
            6,
        ).alias("woe"),
    )


@dataclass(frozen=True)
class BinOverride:
    """One analyst edit.  ``action``: merge_bins, group_categories, reject_variable,
    reorder_missing_bin or reorder_special_bin (the last two use ``position``)."""

    variable: str
    action: str
    reason: str
    source_bin_ids: tuple[str, ...] = ()
    new_bin_id: str = ""
    new_label: str = ""
    position: str = "last"


@dataclass
class _Edited:
    """A bin between edits: the original bins it holds, and the label an edit gave it."""

    bin_id: str
    kind: str
    order: int
    members: list[str]
    label: str | None = None


def _merged(o: BinOverride, entries: list[_Edited]) -> list[_Edited]:
    """The variable's bins after one edit; earlier edits have used up their sources."""
    if not o.reason.strip():
        raise ValueError(f"override of {o.variable!r} needs a reason")
    if not entries:
        raise ValueError(f"override names unknown variable {o.variable!r}")
    if o.action in ("reject_variable", "reorder_missing_bin", "reorder_special_bin"):
        return entries
    if o.action not in ("merge_bins", "group_categories"):
        raise ValueError(f"unknown override action {o.action!r}")
    known = {e.bin_id: e for e in entries}
    if len(set(o.source_bin_ids)) < 2:
        raise ValueError(f"override of {o.variable!r} needs at least two source bins")
    unknown = [b for b in o.source_bin_ids if b not in known]
    if unknown:
        raise ValueError(f"override of {o.variable!r} names unknown bins {unknown}")
    sources = [known[b] for b in o.source_bin_ids]
    kinds = {e.kind for e in sources}
    if o.action == "group_categories" and kinds != {"categorical"}:
        raise ValueError("group_categories applies to categorical variables only")
    if kinds == {"numeric"}:
        places = [entries.index(e) for e in sources]
        if places != list(range(places[0], places[0] + len(places))):
            raise ValueError("numeric bins must be adjacent and listed in order")
    name = o.new_bin_id or o.source_bin_ids[0]
    rest = [e for e in entries if e.bin_id not in o.source_bin_ids]
    if any(e.bin_id == name for e in rest):
        raise ValueError(f"override of {o.variable!r} reuses the bin id {name!r}")
    members = [m for e in sources for m in e.members]
    joined = _Edited(name, sources[0].kind, min(e.order for e in sources), members, o.new_label or None)
    return sorted([*rest, joined], key=lambda e: e.order)


def apply_overrides(bins: DataFrame, overrides: Sequence[BinOverride]) -> DataFrame:
    """Edits one after another: sources of a merge become one bin with summed counts, which later edits may name."""
    edited = {
        v: [_Edited(e.bin_id, e.kind, e.bin_order, [e.bin_id]) for e in entries] for v, entries in bins_by_variable(bins).items()
    }
    for o in overrides:
        edited[o.variable] = _merged(o, edited.get(o.variable, []))
    rejected = [o.variable for o in overrides if o.action == "reject_variable"]
    kept = bins.filter(~F.col("variable").isin(*rejected)) if rejected else bins
    merges = [(v, m, e.bin_id, e.label) for v, entries in edited.items() for e in entries if len(e.members) > 1 for m in e.members]
    if merges:
        mapping = constants(
            bins, merges, "variable string, bin_id string, new_bin_id string, new_label string"
        )
        mapped = null_safe_join(kept, F.broadcast(mapping), ["variable", "bin_id"], "left").withColumn(
            "bin_id", F.coalesce("new_bin_id", "bin_id")
        )
        first, last = (lambda c: F.min_by(c, "bin_order")), (lambda c: F.max_by(c, "bin_order"))
        merged_label = F.concat_ws(" + ", F.transform(
            F.array_sort(F.collect_list(F.struct("bin_order", "label"))), lambda s: s.label
        ))
        kept = mapped.groupBy("variable", "bin_id").agg(
            F.first("kind").alias("kind"),
            F.min("bin_order").alias("bin_order"),
            F.coalesce(F.max("new_label"), merged_label).alias("label"),
            first("lower").alias("lower"),
            last("upper").alias("upper"),
            first("lower_inclusive").alias("lower_inclusive"),
            last("upper_inclusive").alias("upper_inclusive"),
            F.array_sort(F.flatten(F.collect_list("categories"))).alias("categories"),
            F.max("is_missing").alias("is_missing"),
            F.max("is_special").alias("is_special"),
            F.max("is_other").alias("is_other"),
            *[F.sum(c).alias(c) for c in ("row_count", "good_count", "bad_count")],
        ).withColumn("categories", F.when(F.size("categories") > 0, F.col("categories")))
    rank = F.col("bin_order")
    for o in overrides:
        if o.action in ("reorder_missing_bin", "reorder_special_bin"):
            flag = F.col("is_missing") if o.action == "reorder_missing_bin" else F.col("is_special")
            moved = F.lit(-1) if o.position == "first" else F.lit(1_000_000)
            rank = F.when((F.col("variable") == o.variable) & flag, moved).otherwise(rank)
    numbered = Window.partitionBy("variable").orderBy(rank, F.col("bin_order"))
    columns = [c.strip().split(" ")[0] for c in BINS_SCHEMA.split(",")]
    return kept.withColumn("bin_order", F.row_number().over(numbered)).select(*columns)

"""Many penalised logistic regressions in shared passes.

Each pass reads the rows once in Arrow batches and adds up, for every fit that is
not finished (folds left out x penalties), the loss, gradient and Gram matrix at its own
coefficients.  A task returns one row per matrix entry; Spark sums them, so the driver
receives (d + 1)^2 numbers a fit.  Steps are Newton's with halving; an absolute
penalty is met by coordinate descent on the same quadratic model.  A search over folds
and penalties thus costs the passes of its slowest fit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.packing import pack, unpack
from scorelake.functions.state import shuffles_released

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 1e-8  # a Newton step this small, against the coefficients, ends a fit
ROUGH = 1e-7  # so does one against the rounding of large sums, when the loss no longer falls


@dataclass(frozen=True)
class Fit:
    """Penalties on the summed loss, and the fold whose rows are left out."""

    l2: float = 0.0
    l1: float = 0.0
    without: int | None = None


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    y, weight = batch["y"].to_numpy(zero_copy_only=False), batch["weight"].to_numpy(zero_copy_only=False)
    return np.hstack([np.ones((n, 1)), x]), y, weight, batch["fold"].to_numpy(zero_copy_only=False)


def _sums(fits: list[tuple[int, Fit, np.ndarray]]):
    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, weight, fold = _rows(batch)
            for number, fit, beta in fits:
                w = weight if fit.without is None else np.where(fold == fit.without, 0.0, weight)
                z = x @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                made = np.empty((x.shape[1], x.shape[1] + 2))
                made[:, :-2] = (x * (w * p * (1.0 - p))[:, None]).T @ x
                made[:, -2] = x.T @ (w * (p - y))
                made[:, -1] = np.sum(w * (np.logaddexp(0.0, z) - y * z)) / x.shape[1]
                totals[number] = totals.get(number, 0.0) + made
        for number, made in totals.items():
            place = np.arange(made.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(made.size, number, np.int32)), pa.array(place.astype(np.int64)), pa.array(made.ravel())], names=["fit", "place", "value"])

    return accumulate


def _step(gradient: np.ndarray, gram: np.ndarray, beta: np.ndarray, fit: Fit) -> np.ndarray:
    """The least point of the quadratic model with the penalties, as a step; the intercept is free."""
    bare = np.r_[0.0, np.ones(len(beta) - 1)]
    hessian, slope = gram + np.diag(fit.l2 * bare), gradient + fit.l2 * bare * beta
    if not fit.l1:
        try:
            return -np.linalg.solve(hessian, slope)
        except np.linalg.LinAlgError:
            return -np.linalg.lstsq(hessian, slope, rcond=None)[0]
    step = np.zeros_like(beta)
    for _ in range(10_000):
        largest = 0.0
        for j in range(len(beta)):
            if hessian[j, j] <= 0:
                continue
            rest = slope[j] + hessian[j] @ step - hessian[j, j] * step[j]
            target = beta[j] - rest / hessian[j, j]
            if j:
                target = np.sign(target) * max(abs(target) - fit.l1 / hessian[j, j], 0.0)
            change = target - beta[j] - step[j]
            step[j] += change
            largest = max(largest, abs(change))
        if largest <= 1e-12 * (1.0 + np.abs(beta).max()):
            break
    return step


def fit_many(rows: DataFrame, fits: Sequence[Fit], max_passes: int = 100) -> tuple[list[np.ndarray], list[bool]]:
    """Coefficients (intercept first) of every fit, and whether it converged.

    ``rows`` has ``x`` (array of doubles without nulls), ``y`` (0 or 1), ``weight`` and ``fold``, and is read once a pass, so it is best staged.
    """
    head = rows.select(F.size("x").alias("d")).head()
    if head is None:
        raise ValueError("a logistic fit needs rows")
    d = head.d + 1
    trial = [np.zeros(d) for _ in fits]
    accepted: list[tuple[np.ndarray, float] | None] = [None] * len(fits)
    moves = [np.zeros(d) for _ in fits]
    done, converged = [False] * len(fits), [False] * len(fits)
    for _ in range(max_passes):
        open_fits = [(k, f, trial[k]) for k, f in enumerate(fits) if not done[k]]
        if not open_fits:
            break
        sums = rows.select("x", "y", "weight", "fold").mapInArrow(_sums(open_fits), "fit int, place long, value double")
        made = {k: np.zeros(d * (d + 2)) for k, *_ in open_fits}
        for r in sums.groupBy("fit", "place").agg(F.sum("value").alias("value")).toArrow().to_pylist():
            made[r["fit"]][r["place"]] = r["value"]
        for k, fit, beta in open_fits:
            table = made[k].reshape(d, d + 2)
            loss = table[:, -1].sum()
            cost = loss + 0.5 * fit.l2 * np.sum(beta[1:] ** 2) + fit.l1 * np.abs(beta[1:]).sum()
            before = accepted[k]
            if before is not None and not cost <= before[1] + 1e-12 * abs(before[1]):
                if np.abs(moves[k]).max() <= ROUGH * (1.0 + np.abs(before[0]).max()):
                    trial[k], done[k], converged[k] = before[0], True, True
                else:
                    moves[k] = moves[k] / 2.0
                    trial[k] = before[0] + moves[k]
                continue
            accepted[k] = (beta, cost)
            if not fit.l1 and not fit.l2 and loss < 1e-6:  # the classes part completely: no finite answer
                done[k] = True
                continue
            moves[k] = _step(table[:, -2], table[:, :-2], beta, fit)
            trial[k] = beta + moves[k]
            if np.abs(moves[k]).max() <= STEP * (1.0 + np.abs(beta).max()):
                done[k] = converged[k] = True
    return trial, converged


SLICE_ROWS = 1_000_000  # scored rows of a fit that meet in one task, about
FLUSH_ROWS = 1_000_000  # scored rows that a task holds before it sends them
SAMPLE_ROWS = 100_000  # rows, about, whose scores part the slices


def _probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Term by term, so that equal rows have equal probabilities whatever rows are beside them."""
    z = np.full(len(x), beta[0])
    for j in range(1, len(beta)):
        z += x[:, j] * beta[j]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _slice_cuts(rows: DataFrame, coefficients: Sequence[np.ndarray], held: int, slice_rows: int) -> list[np.ndarray]:
    """Probabilities that part every fit's ``held``-th part of the rows into slices, from a bounded sample: it decides how even slices are, not what they hold."""
    n = rows.count()
    slices = -(-n // (slice_rows * held))
    if slices <= 1:
        return [np.empty(0) for _ in coefficients]
    drawn = rows.select("x", "y", "weight", "fold").sample(min(1.0, SAMPLE_ROWS / n), 42).toArrow().combine_chunks().to_batches()
    if not drawn:
        return [np.empty(0) for _ in coefficients]
    x, shares = _rows(drawn[0])[0], np.arange(1, slices) / slices
    return [np.unique(np.quantile(_probability(x, beta), shares)) for beta in coefficients]


def _send_values(fits: Sequence[Fit], coefficients: Sequence[np.ndarray], roles: Sequence[str], cuts: Sequence[np.ndarray], flush_rows: int):
    parts = [(k, role) for k in range(len(fits)) for role in roles]

    def sent(held: list[list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        made: list[tuple[int, str, int, int, bytes]] = []
        for (k, role), own in zip(parts, held):
            if not own:
                continue
            values, place = np.unique(np.concatenate([p for p, _ in own]), return_inverse=True)
            bad = np.bincount(place, np.concatenate([y for _, y in own]), len(values)).astype(np.uint32)
            good = (np.bincount(place, minlength=len(values)) - bad).astype(np.uint32)
            ends = [0, *np.searchsorted(values, cuts[k], side="right"), len(values)]
            made += [(k, role, i, b - a, pack([values[a:b], good[a:b], bad[a:b]])) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        fit, role, piece, n, data = zip(*made)
        return pa.RecordBatch.from_arrays(
            [pa.array(fit, pa.int32()), pa.array(role), pa.array(piece, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())],
            names=["fit", "role", "slice", "n", "data"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in parts], 0
        for batch in batches:
            x, y, _, fold = _rows(batch)
            for i, (k, role) in enumerate(parts):
                own = fold == fits[k].without if role == "test" else fold != fits[k].without
                if own.any():
                    held[i].append((_probability(x[own], coefficients[k]), y[own]))
                    n += len(held[i][-1][0])
            if n >= flush_rows:
                yield sent(held)
                held, n = [[] for _ in parts], 0
        if n:
            yield sent(held)

    return send


_COUNTS = pa.schema([("fit", pa.int32()), ("role", pa.string()), ("slice", pa.int32()), ("value", pa.float64()), ("below", pa.int64()), ("good", pa.int64()), ("bad", pa.int64())])


def _slice_counts(table: pa.Table) -> pa.Table:
    parts = [unpack(data, n, [np.float64, np.uint32, np.uint32]) for data, n in zip(table["data"].to_pylist(), table["n"].to_pylist())]
    values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    good, bad = (np.bincount(place, np.concatenate([p[i] for p in parts]), len(values)).astype(np.int64) for i in (1, 2))
    same = [pa.array([table[c][0].as_py()] * len(values), _COUNTS.field(c).type) for c in ("fit", "role", "slice")]
    return pa.Table.from_arrays([*same, pa.array(values), pa.array(np.cumsum(good) - good), pa.array(good), pa.array(bad)], schema=_COUNTS)


def scored_counts(
    rows: DataFrame, fits: Sequence[Fit], coefficients: Sequence[np.ndarray], roles: Sequence[str] = ("test", "train"), slices: int | None = None,
    slice_rows: int = SLICE_ROWS, flush_rows: int = FLUSH_ROWS,
) -> DataFrame:
    """``(fit, role, slice, value, below, good, bad)``: counts of every fit's probabilities; rows of the fold left out are ``test``.

    ``roles`` names the parts to count, ``slices`` the tasks that add the counts up.  Probabilities are exchanged once, packed with
    others of their range, the ``slice``; ``below`` are the goods of smaller values in it.
    """
    held = 1 if "train" in roles else max(1, len({f.without for f in fits}))
    cuts = _slice_cuts(rows, coefficients, held, slice_rows)
    sent = rows.select("x", "y", "weight", "fold").mapInArrow(
        _send_values(fits, coefficients, roles, cuts, flush_rows), "fit int, role string, slice int, n int, data binary"
    )
    if slices:
        sent = sent.repartition(slices, "fit", "role", "slice")
    return sent.groupBy("fit", "role", "slice").applyInArrow(_slice_counts, "fit int, role string, slice int, value double, below long, good long, bad long")


def slices_won(counts: DataFrame) -> dict[tuple[int, str], tuple[int, int, int]]:
    """Per fit and role: twice the pairs that bad rows win, ties counted half, and the numbers of good and bad rows.

    A slice of ``counts`` returns three numbers, which the driver adds up in order, so nothing is staged or exchanged again.
    """
    wins = F.sum(F.col("bad") * (F.lit(2) * F.col("below") + F.col("good")))
    told = counts.groupBy("fit", "role", "slice").agg(wins.alias("wins"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    totals: dict[tuple[int, str], tuple[int, int, int]] = {}
    with shuffles_released(counts.sparkSession):
        found = told.toArrow().to_pylist()  # a row per million scores
    for r in sorted(found, key=lambda r: r["slice"]):
        won, good, bad = totals.get((r["fit"], r["role"]), (0, 0, 0))
        totals[r["fit"], r["role"]] = (won + r["wins"] + 2 * r["bad"] * good, good + r["good"], bad + r["bad"])
    return totals

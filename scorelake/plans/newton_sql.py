"""Newton's method for penalised logistic regressions as one recursive query, for oracles."""

from __future__ import annotations


def eliminated(system: str, d: int) -> str:
    """Rows of ``system`` (d list rows, wider than d) after Gauss-Jordan elimination of their first d columns."""
    eliminate = (
        "list_transform(a.m, lambda r, i: CASE WHEN i = e.k THEN list_transform(r, lambda v: v / r[e.k]) "
        "ELSE list_transform(r, lambda v, j: v - r[e.k] / a.m[e.k][e.k] * a.m[e.k][j]) END)"
    )
    return (
        f"list_reduce(list_transform(range(1, {d + 1}), lambda k: {{'m': CAST(NULL AS DOUBLE[][]), 'k': k}}), "
        f"lambda a, e: {{'m': {eliminate}, 'k': e.k}}, {{'m': {system}, 'k': 0::BIGINT}}).m"
    )


def newton_cte(rows: str, fits: str, d: int, steps: int = 9, state: str = "newton_state", fitted: str = "fitted") -> str:
    """Tables ``newton_state`` and ``fitted (fit, beta)``, or of other names.

    ``rows`` has ``x`` (a list whose first entry is 1), ``y`` and ``fold``; ``fits`` has ``fit``, ``l2`` (the first coefficient is free)
    and ``without`` (a fold or null).  The linear system of a step is solved by Gauss-Jordan elimination over list rows.
    """
    cells = f"(SELECT i, j FROM range(1, {d + 1}) a(i), range(1, {d + 2}) b(j))"
    solved = eliminated("system", d)
    return f"""{state} AS (
  SELECT fit, 0 AS step, list_transform(range({d}), lambda i: 0.0::DOUBLE) AS beta FROM {fits}
  UNION ALL
  SELECT fit, step + 1, list_transform(beta, lambda b, i: b - done[i][{d + 1}]) FROM (
    SELECT fit, step, beta, {solved} AS done FROM (
      SELECT fit, step, any_value(beta) AS beta, list(line ORDER BY i) AS system FROM (
        SELECT fit, step, i, any_value(beta) AS beta, list(v ORDER BY j) AS line FROM (
          SELECT fit, step, i, j, any_value(beta) AS beta, CASE WHEN j <= {d}
              THEN sum(p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN any_value(l2) ELSE 0 END
              ELSE sum((p - y) * x[i]) + CASE WHEN i > 1 THEN any_value(l2 * beta[i]) ELSE 0 END END AS v
          FROM (SELECT n.fit, n.step, n.beta, f.l2, r.x, r.y, 1 / (1 + exp(-list_dot_product(n.beta, r.x))) AS p
                FROM {state} n JOIN {fits} f ON f.fit = n.fit JOIN {rows} r ON f.without IS NULL OR r.fold <> f.without
                WHERE step < {steps}) scored_rows, {cells} cells
          GROUP BY fit, step, i, j) entries
        GROUP BY fit, step, i) lines
      GROUP BY fit, step) systems) moved),
{fitted} AS (SELECT fit, beta FROM {state} WHERE step = {steps})"""

"""Variable clusters from a correlation table (one row per variable or pair, never per row)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import constants, null_safe_join
from scorelake.functions.state import collect_state, materialise

RULES = ("highest_iv", "lowest_missing", "manual")


def candidates(iv: DataFrame, columns: Sequence[str], limit: int | None = None) -> list[str]:
    """Columns with an IV, best first; all of them unless the caller sets a limit."""
    ranked = collect_state(iv.filter(F.col("variable").isin(*columns)).select("variable", "iv"), what="candidates")
    ranked.sort(key=lambda r: (-r.iv if r.iv is not None else float("inf"), r.variable))
    return [r.variable for r in ranked[:limit]]


def _describe(labels: DataFrame, corr: DataFrame, stats: DataFrame, rule: str) -> DataFrame:
    """Members with their cluster, representative and largest correlation inside it.

    ``labels`` is ``(variable, position, root)``, ``stats`` is ``(variable, iv,
    missing_rate)``.  Variables alone in their cluster have no cluster id.
    """
    if rule not in RULES:
        raise ValueError(f"representative rule must be one of {RULES}")
    group = Window.partitionBy("root")
    numbered = labels.withColumns(
        {"size": F.count(F.lit(1)).over(group), "number": F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("root"))}
    )
    members = null_safe_join(numbered, stats, ["variable"], "left")
    best = {
        "highest_iv": [F.desc(F.coalesce("iv", F.lit(0.0))), F.asc("position")],
        "lowest_missing": [F.asc(F.coalesce("missing_rate", F.lit(float("inf")))), F.asc("position")],
        "manual": [F.asc("position")],
    }[rule]
    ranked = members.withColumn("choice", F.row_number().over(group.orderBy(*best)))
    a = labels.select(F.col("variable").alias("variable_a"), F.col("root").alias("root_a"))
    b = labels.select(F.col("variable").alias("variable_b"), F.col("root").alias("root_b"))
    inside = (
        corr.join(a, "variable_a").join(b, "variable_b").filter("root_a = root_b")
        .groupBy(F.col("root_a").alias("root")).agg(F.max("corr").alias("max_corr"))
    )
    clustered = F.col("size") > 1
    return null_safe_join(ranked, inside, ["root"], "left").select(
        F.when(clustered, F.format_string("cluster_%03d", "number")).alias("cluster_id"),
        "variable",
        "iv",
        "missing_rate",
        (clustered & (F.col("choice") == 1) & F.lit(rule != "manual")).alias("is_representative"),
        F.when(clustered, F.round(F.greatest("max_corr", F.lit(0.0)), 4)).alias("max_pairwise_corr"),
    )


def threshold_clusters(
    corr: DataFrame, columns: Sequence[str], stats: DataFrame, threshold: float = 0.7, rule: str = "highest_iv"
) -> DataFrame:
    """Connected components of pairs at or above the threshold.

    Every variable takes the smallest label among itself and its neighbours
    until nothing changes; the tables have one row per variable or edge.
    """
    corr = materialise(corr)
    labels = constants(corr, [(c, i, i) for i, c in enumerate(columns)], "variable string, position int, root int")
    close = corr.filter(F.col("corr") >= F.lit(float(threshold)))
    edges = close.select(F.col("variable_a").alias("variable"), F.col("variable_b").alias("other")).union(
        close.select("variable_b", "variable_a")
    )
    while True:
        reached = (
            edges.join(labels.select(F.col("variable").alias("other"), F.col("root").alias("near")), "other")
            .groupBy("variable").agg(F.min("near").alias("near"))
        )
        moved = materialise(
            null_safe_join(labels, reached, ["variable"], "left").select(
                "variable", "position", F.least("root", "near").alias("root"),
                (F.col("near") < F.col("root")).alias("changed"),
            )
        )
        labels = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            break
    return _describe(labels, corr, stats, rule)


def chain_merges(distance: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """All merges ``(height, a, b)`` of average or complete linkage by a chain of nearest neighbours.

    The chain walks from a cluster to its nearest until two are each other's nearest; those merge and the
    rest of the chain stays valid, as neither linkage brings a merged cluster nearer.  Distances to
    a merged cluster follow from those of its parts, so the work is quadratic.  The merged cluster
    takes the place of ``a``; equal distances go to the chain's own predecessor, then to the first place.
    """
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(len(d)), np.ones(len(d), bool)
    merges, chain = [], []
    for _ in range(len(d) - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            here = chain[-1]
            near = int(np.argmin(d[here]))
            if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        a, b = min(here, near), max(here, near)
        merges.append((float(d[a, b]), a, b))
        joined = np.maximum(d[a], d[b]) if linkage == "complete" else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a], alive[b] = size[a] + size[b], False
    return merges


def hierarchical_clusters(
    corr: DataFrame,
    columns: Sequence[str],
    stats: DataFrame,
    cut: float = 0.3,
    linkage: str = "average",
    rule: str = "highest_iv",
) -> DataFrame:
    """Merge the closest clusters (distance 1 - corr) until none is within ``cut``.

    The correlations come from Spark; only the k by k table of the k variables is
    merged, inside one grouped task, in time and memory of k squared: some thousands of variables.
    """
    if linkage not in ("average", "complete"):
        raise ValueError("linkage must be average or complete")
    names = list(columns)
    corr = materialise(corr)

    def merge(table: pd.DataFrame) -> pd.DataFrame:
        k = len(names)
        position = {c: i for i, c in enumerate(names)}
        distance = np.ones((k, k))
        a, b = table["variable_a"].map(position), table["variable_b"].map(position)
        distance[a, b] = distance[b, a] = 1.0 - table["corr"]
        root = np.arange(k)
        for height, i, j in chain_merges(distance, linkage):
            if height <= cut:
                root[root == root[j]] = root[i]
        least = {r: int(np.flatnonzero(root == r).min()) for r in set(root.tolist())}
        return pd.DataFrame([(names[i], i, least[int(root[i])]) for i in range(k)], columns=["variable", "position", "root"])

    labels = materialise(
        corr.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(merge, "variable string, position int, root int")
    )
    return _describe(labels, corr, stats, rule)

"""Reject inference by augmentation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, constants, count_if
from scorelake.functions.hashing import dense_index, hash_order, uniform
from scorelake.functions.ordered import exact_quantiles
from scorelake.functions.placing import place
from scorelake.functions.state import collect_state, stage
from scorelake.functions.target import TargetSpec
from scorelake.operators.model import LogisticParams, assembled, feature_columns
from scorelake.operators.prep import FINANCED


@dataclass(frozen=True)
class AugmentationParams:
    """``model``: "outcome" scores bad risk as learnt on financed rows;
    "propensity" scores the chance of being financed."""

    bands: int = 10
    min_samples_per_band: int = 30
    min_p_financed: float = 0.05
    seed: int = 42
    model: str = "outcome"


def score_bands(
    classified: DataFrame, target: TargetSpec, features: Sequence[str] | None, params: AugmentationParams
) -> DataFrame:
    """Add ``_band`` (0-based, right-closed quantile bands of the model score)."""
    names = feature_columns(classified, target.column, features or (), exclude=[FINANCED])
    if params.model == "propensity":
        learner = TargetSpec(FINANCED, good=("false",), bad=("true",))
        training = assembled(classified, names, learner)
    else:
        training = assembled(classified.filter(col(FINANCED)), names, target)
    n = training.count()
    model = LogisticParams().estimator(n).fit(training)
    scored = stage(
        model.transform(assembled(classified, names, keep=classified.columns)).select(
            *[col(c) for c in classified.columns], vector_to_array("probability")[1].alias("_score")
        )
    )
    total = scored.count()
    bands = max(1, min(params.bands, total // params.min_samples_per_band))
    if bands == 1:
        return scored.withColumn("_band", F.lit(0))
    edges = exact_quantiles(scored, ["_score"], [i / bands for i in range(1, bands)])
    breaks = constants(scored, [(sorted({r.q for r in edges.collect()}),)], "breaks array<double>")
    return place(scored, "_score", breaks, output="_band")


def band_weights(banded: DataFrame, target: TargetSpec, params: AugmentationParams) -> DataFrame:
    """Per band: rows, financed rows, financed share and the weight of a financed row."""
    share = F.col("n_financed") / F.greatest(F.col("n_total"), F.lit(1))
    return (
        banded.groupBy(F.col("_band").alias("band"))
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            count_if(col(FINANCED)).alias("n_financed"),
            count_if(col(FINANCED) & target.is_known).alias("n_eligible"),
        )
        .withColumns({"p_financed": share, "weight": F.lit(1.0) / F.greatest(share, F.lit(params.min_p_financed))})
    )


def augment(
    classified: DataFrame,
    target: TargetSpec,
    keys: Sequence[str],
    features: Sequence[str] | None = None,
    params: AugmentationParams = AugmentationParams(),
) -> DataFrame:
    """Draw as many rows as were financed, with replacement, by band weight.

    Weights are equal inside a band, so the inverse of the cumulative weight is
    a band from a handful of offsets and then a row number inside it: draws
    join rows on (band, row number) and nothing is ranked globally.
    Without rejects the sample passes through.
    """
    counts = classified.agg(count_if(col(FINANCED)).alias("f"), count_if(~col(FINANCED)).alias("r")).first()
    if counts.r == 0:
        return classified.drop(FINANCED)
    banded = score_bands(classified, target, features, params)
    table = sorted(collect_state(band_weights(banded, target, params)), key=lambda r: r.band)
    table = [r for r in table if r.n_eligible > 0]
    if not table:
        raise ValueError("no financed rows with a known outcome to draw from")
    whole = sum(r.n_eligible * r.weight for r in table)
    u = uniform([F.col("id")], params.seed) * F.lit(whole)
    band: Column | None = None
    index: Column | None = None
    start = 0.0
    for r in table:
        end = start + r.n_eligible * r.weight
        last = r is table[-1]
        test = F.lit(True) if last else u < F.lit(end)
        place_in_band = F.least(F.floor((u - F.lit(start)) / F.lit(r.weight)), F.lit(r.n_eligible - 1))
        band = F.when(test, F.lit(r.band)) if band is None else band.when(test, F.lit(r.band))
        index = F.when(test, place_in_band) if index is None else index.when(test, place_in_band)
        start = end
    picks = (
        classified.sparkSession.range(counts.f)
        .select(band.alias("_band"), index.alias("_index"))
        .groupBy("_band", "_index")
        .agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    )
    eligible = banded.filter(col(FINANCED) & target.is_known).withColumn("_h", hash_order(keys, params.seed))
    return (
        dense_index(eligible, ["_band"])
        .join(picks, ["_band", "_index"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*[col(c) for c in classified.columns if c != FINANCED])
    )

"""The chi-square tail as a Spark column."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - scale * total
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return scale * h


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    """P(X > statistic); used on one number per role only."""
    values = [
        _upper_gamma(d / 2.0, s / 2.0) if np.isfinite(s) else 0.0 for s, d in zip(statistic, degrees)
    ]
    return pd.Series(values, dtype="float64")

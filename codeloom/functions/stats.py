"""Statistics as column expressions; results are null, not 0, where they are undefined."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b)


def agreement_columns(n: Column, both: Column, neither: Column, only_a: Column, only_b: Column) -> dict[str, Column]:
    """po, kappa, pabak, ac1, prevalence and bias of a 2x2 table given as counts."""
    n, both, neither, only_a, only_b = (c.cast("double") for c in (n, both, neither, only_a, only_b))
    po = _ratio(both + neither, n)
    pa, pb = _ratio(both + only_a, n), _ratio(both + only_b, n)
    pe = pa * pb + (1 - pa) * (1 - pb)
    q = (pa + pb) / 2
    pg = 2 * q * (1 - q)
    return {
        "po": po,
        "kappa": _ratio(po - pe, 1 - pe),
        "pabak": 2 * po - 1,
        "ac1": _ratio(po - pg, 1 - pg),
        "prevalence": _ratio(F.abs(both - neither), n),
        "bias": _ratio(F.abs(only_a - only_b), n),
    }


def kappa_band(kappa: Column) -> Column:
    """Words for a kappa: poor below 0, slight to .2, fair to .4, moderate to .6, substantial to .8, almost_perfect."""
    return (
        F.when(kappa.isNull(), None).when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair")
        .when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost_perfect")
    )


def is_paradox(kappa: Column, pabak: Column, prevalence: Column) -> Column:
    """High agreement with low kappa for want of variation."""
    return F.coalesce((prevalence > 0.6) & (pabak - kappa > 0.2), F.lit(False))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function (series below a + 1, continued fraction above)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def chi2_p(stat: Column, dof: Column) -> Column:
    """Survival function of the chi-square distribution; a vectorised function on few rows."""

    @F.pandas_udf("double")
    def p(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([gamma_q(k / 2, x / 2) if pd.notna(x) and pd.notna(k) and k > 0 else None for x, k in zip(s, d)], dtype="float64")

    return p(stat, dof)

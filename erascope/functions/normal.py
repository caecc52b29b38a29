"""Inverse of the normal distribution function as a column expression (algorithm AS 241, Wichura 1988)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The coefficients of the published rational approximations, lowest power first.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _text(literal, p: str, s: str) -> str:
    """The quantile of a column p, given a column or expression s for the root of -log(min(p, 1 - p)), as an SQL text."""

    def poly(coefficients, x):
        return reduce(lambda acc, c: f"({acc}*{x}+{literal(c)})", reversed(coefficients[:-1]), literal(coefficients[-1]))

    q = f"({p}-{literal(0.5)})"
    r = f"({literal(0.180625)}-{q}*{q})"
    m, t = f"({s}-{literal(1.6)})", f"({s}-{literal(5.0)})"
    central = f"{q}*{poly(CENTRAL[0], r)}/{poly(CENTRAL[1], r)}"
    outer = f"sign({q})*CASE WHEN {s}<=5 THEN {poly(MIDDLE[0], m)}/{poly(MIDDLE[1], m)} ELSE {poly(TAIL[0], t)}/{poly(TAIL[1], t)} END"
    return f"CASE WHEN {p}>0 AND {p}<1 THEN CASE WHEN abs({q})<={literal(0.425)} THEN {central} ELSE {outer} END END"


PROBIT = _text(lambda c: f"{c!r}D", "p__", "s__")


def with_probit(df: DataFrame, name: str, p: Column) -> DataFrame:
    """df with the quantile of p; null outside 0 < p < 1 and for null. p and the root in the tails are columns first, since the
    polynomials name them many times; the polynomials are one text, which is parsed faster than built."""
    at = df.withColumn("p__", p).withColumn("s__", F.expr("sqrt(-ln(least(p__, 1D - p__)))"))
    return at.withColumn(name, F.expr(PROBIT)).drop("p__", "s__")


def probit_sql(p: str) -> str:
    """The same in the oracles' SQL, for a column named p."""
    return _text(lambda c: f"{c!r}::DOUBLE", p, f"sqrt(-ln(least({p},1e0-{p})))")


def probit_values(p: np.ndarray) -> np.ndarray:
    """The same for numbers in a task: NaN outside 0 < p < 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q, s = p - 0.5, np.sqrt(-np.log(np.minimum(p, 1 - p)))
        ratio = lambda pair, x: np.polyval(pair[0][::-1], x) / np.polyval(pair[1][::-1], x)
        outer = np.sign(q) * np.where(s <= 5, ratio(MIDDLE, s - 1.6), ratio(TAIL, s - 5.0))
        return np.where((p > 0) & (p < 1), np.where(np.abs(q) <= 0.425, q * ratio(CENTRAL, 0.180625 - q * q), outer), np.nan)

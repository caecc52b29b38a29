"""Residuals of targets and signals: linear, projected, blended, and neutral to features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import clean, with_rank_gaussian, zscore
from .grams import fitted, grams, least_squares, linear
from .ranks import ranked_over_all, scaled_over_all


def subtract_scaled(df: DataFrame, name: str, y: str, x: str, by: list[str], share: float = 0.07) -> DataFrame:
    """y less share times the z-score of x."""
    if by:
        return df.withColumn(name, F.col(y) - F.lit(share) * zscore(x, *by))
    return scaled_over_all(df, "z_", x).withColumn(name, F.col(y) - F.lit(share) * F.col("z_")).drop("z_")


def linear_residual(df: DataFrame, name: str, y: str, x: str, by: list[str], intercept: bool = True) -> DataFrame:
    """y less its least-squares line on x in each group (whole table where by is empty). Where x has no variance the slope is
    0; pairs that are not finite get null and are not fitted."""
    both = clean(x).isNotNull() & clean(y).isNotNull()
    a, b = F.when(both, clean(x)), F.when(both, clean(y))
    sums = [F.count(a).alias("n_"), F.avg(a).alias("mx_"), F.avg(b).alias("my_"), F.covar_pop(a, b).alias("cxy_"), F.var_pop(a).alias("vx_"), F.sum(a * b).alias("sxy_"), F.sum(a * a).alias("sxx_")]
    if by:
        fits = df.groupBy(*by).agg(*sums)
        joined = df.join(fits, by)
    else:
        joined = df.crossJoin(F.broadcast(df.agg(*sums)))  # one row
    if intercept:
        slope = F.when(F.col("vx_") > 0, F.col("cxy_") / F.col("vx_")).otherwise(0.0)
        fitted = F.col("my_") + slope * (a - F.col("mx_"))
    else:
        fitted = F.when(F.col("sxx_") > 0, F.col("sxy_") / F.col("sxx_")).otherwise(0.0) * a
    return joined.withColumn(name, b - fitted).drop("n_", "mx_", "my_", "cxy_", "vx_", "sxy_", "sxx_")


def projection_residual(df: DataFrame, name: str, target: str, reference: str, by: list[str]) -> DataFrame:
    """The centred target less its projection on the rank-Gaussian reference, which is not centred."""
    w = W.partitionBy(*by)
    with_g = with_rank_gaussian(df, "g_", reference, *by).withColumn("c_", F.col(target) - F.avg(target).over(w))
    beta = F.sum(F.col("c_") * F.col("g_")).over(w) / F.sum(F.col("g_") * F.col("g_")).over(w)
    return with_g.withColumn(name, F.col("c_") - F.coalesce(beta, F.lit(0.0)) * F.col("g_")).drop("g_", "c_")


def tempered(identity: Column, gaussian: Column, temper: float, raw: Column | None = None, proportion: float = 1.0) -> Column:
    """(1 - temper) identity + temper gaussian, then blended with the raw target in the given proportion."""
    if not 0 <= temper <= 1 or not 0 <= proportion <= 1:
        raise ValueError("temper and proportion lie in 0 to 1")
    mixed = (1 - temper) * identity + temper * gaussian
    return mixed if raw is None else proportion * mixed + (1 - proportion) * raw


@dataclass(frozen=True)
class TargetSpec:
    """What target_transform does. kind: identity (none, raw), residual (linear_residual, residualize), projection, or
    subtract (scaled_subtract)."""

    kind: str = "identity"
    target: str = "target"
    reference: str = "benchmark"
    per_era: bool = True
    share: float = 0.07
    intercept: bool = True
    temper: float = 0.0
    proportion: float = 1.0


_KINDS = {"identity": "identity", "none": "identity", "raw": "identity", "residual": "residual", "linear_residual": "residual", "residualize": "residual", "projection": "projection", "subtract": "subtract", "scaled_subtract": "subtract"}


def target_transform(df: DataFrame, spec: TargetSpec, name: str = "target_transformed", era: str = "era") -> DataFrame:
    kind = _KINDS.get(spec.kind.lower())
    if kind is None:
        raise ValueError(f"no such transform: {spec.kind!r}")
    by = [era] if spec.per_era else []
    if kind == "identity":
        return df.withColumn(name, F.col(spec.target))
    if kind == "subtract":
        return subtract_scaled(df, name, spec.target, spec.reference, by, spec.share)
    if kind == "projection":
        if not by:
            raise ValueError("a projection is made within eras")
        return projection_residual(df, name, spec.target, spec.reference, by)
    out = linear_residual(df, "identity_", spec.target, spec.reference, by, spec.intercept)
    if spec.temper:
        out = with_rank_gaussian(out, "x_", spec.reference, *by) if by else ranked_over_all(out, "x_", spec.reference)
        out = linear_residual(out, "gaussian_", spec.target, "x_", by, spec.intercept).drop("x_")
        out = out.withColumn(name, tempered(F.col("identity_"), F.col("gaussian_"), spec.temper, F.col(spec.target), spec.proportion)).drop("gaussian_")
    else:
        out = out.withColumn(name, tempered(F.col("identity_"), F.col("identity_"), 0.0, F.col(spec.target), spec.proportion))
    return out.drop("identity_")


def neutralized(df: DataFrame, name: str, signal: str, features: list[str], by: list[str], proportion: float = 1.0, rcond: float = 1e-12, native: bool | None = None) -> DataFrame:
    """The signal less proportion times its projection on the features and a constant, in each group; null where the signal has
    no variance. Products are summed by group, a pseudo-inverse of one small matrix is taken for each group, and the
    coefficients are joined back, so rows of a group are never gathered. Features that are not finite count as 0. native: see
    grams.grams()."""
    betas = fitted(grams(df, signal, features, by, native), by, len(features), least_squares(rcond=rcond))
    joined = df.join(betas, by, "left") if by else df.join(F.broadcast(betas), F.lit(True), "left")  # without groups one row
    return joined.withColumn(name, clean(signal) - F.lit(proportion) * linear("beta_", features)).drop("beta_")

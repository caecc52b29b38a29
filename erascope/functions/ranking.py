"""Rank and moment expressions over groups (windows). Nulls get null and do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .normal import with_probit


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN and infinities as null, so that SQL's null rules hold for them."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def average_rank(x: Column | str, *by: str) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    x = col(x)
    w = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    first = F.rank().over(w)
    ties = F.count(x).over(w.rangeBetween(W.currentRow, W.currentRow))  # the peers of a row, in the rank's own sort
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


def count_in(x: Column | str, *by: str) -> Column:
    return F.count(col(x)).over(W.partitionBy(*by))


def percent_rank(x: Column | str, *by: str) -> Column:
    """Average rank over count: in (0, 1]."""
    return average_rank(x, *by) / count_in(x, *by)


def tie_kept_rank(x: Column | str, *by: str) -> Column:
    """(average rank - 1/2) over count: in (0, 1)."""
    return (average_rank(x, *by) - 0.5) / count_in(x, *by)


def with_rank_gaussian(df: DataFrame, name: str, x: Column | str, *by: str) -> DataFrame:
    """df with the normal quantile of the tie-kept rank."""
    return with_probit(df, name, tie_kept_rank(x, *by))


def first_rank(x: Column | str, key: str, *by: str) -> Column:
    """Row number over count, ties in order of key."""
    x = col(x)
    return F.when(x.isNotNull(), F.row_number().over(W.partitionBy(*by).orderBy(x.asc_nulls_last(), F.col(key))) / count_in(x, *by))


def mean_in(x: Column | str, *by: str) -> Column:
    return F.avg(col(x)).over(W.partitionBy(*by))


def zscore(x: Column | str, *by: str) -> Column:
    """(x - mean) over population deviation; 0 where that is 0."""
    x, w = col(x), W.partitionBy(*by)
    deviation = F.stddev_pop(x).over(w)
    return F.when(x.isNotNull(), F.when(deviation == 0, 0.0).otherwise((x - F.avg(x).over(w)) / deviation))


def signed_power(x: Column | str, power: float = 1.5) -> Column:
    x = col(x)
    return F.signum(x) * F.pow(F.abs(x), F.lit(power))

"""Rank and scale transforms of signals, within eras or over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import with_probit
from ..functions.ranking import average_rank, first_rank, percent_rank, tie_kept_rank, with_rank_gaussian, zscore

_EXPRESSIONS = {"percent": percent_rank, "tie_kept": tie_kept_rank, "zscore": zscore, "average": average_rank}


def transform_in_groups(df: DataFrame, signals: dict[str, tuple[str, str]], by: list[str]) -> DataFrame:
    """df with new columns {name: (kind, signal)}, computed in the groups of by; kinds: percent, tie_kept, gaussian, zscore,
    average. All share one exchange on by."""
    for name, (kind, x) in signals.items():
        df = with_rank_gaussian(df, name, x, *by) if kind == "gaussian" else df.withColumn(name, _EXPRESSIONS[kind](x, *by))
    return df


def first_ranked(df: DataFrame, name: str, x: str, key: str, by: list[str]) -> DataFrame:
    return df.withColumn(name, first_rank(x, key, *by))


def ranked_over_all(df: DataFrame, name: str, x: str, kind: str = "gaussian", parts: int = 64, by: list[str] | None = None) -> DataFrame:
    """A rank over the whole table without a window over the whole table: values are counted, dealt to ranges between
    quantiles, summed by range (at most parts rows), and ranked inside their range. kinds: gaussian, average, percent, tie_kept.

    With by, over each group of these columns: for few groups of very many rows, each of which a window would hold in one
    task; the quantiles are then one row a group. Null values get null; a null group is a group.
    """
    by = by or []
    of = [f"{c}_of_" for c in by]
    values = df.filter(F.col(x).isNotNull()).groupBy(*[F.col(c).alias(g) for c, g in zip(by, of, strict=True)], F.col(x).alias("v_")).agg(F.count("*").alias("n_"))
    if by:
        quantiles = F.percentile_approx(x, [i / parts for i in range(1, parts)], 100 * parts)
        cuts = df.groupBy(*[F.col(c).alias(f"{g}q_") for c, g in zip(by, of, strict=True)]).agg(F.array_distinct(quantiles).alias("cuts_"))
        values = values.join(F.broadcast(cuts), [F.col(g).eqNullSafe(F.col(f"{g}q_")) for g in of]).drop(*[f"{g}q_" for g in of])  # one row a group
        bounds = F.col("cuts_")
    else:
        splits = sorted(set(df.approxQuantile(x, [i / parts for i in range(1, parts)], 0.5 / parts)))
        bounds = F.array(*[F.lit(float(s)) for s in splits]) if splits else F.array().cast("array<double>")
    values = values.withColumn("p_", F.size(F.filter(bounds, lambda s: s < F.col("v_"))))
    totals = values.groupBy(*of, "p_").agg(F.sum("n_").alias("t_"))
    before = totals.select(*[F.col(g).alias(f"{g}b_") for g in of], F.col("p_").alias("pb_"), (F.sum("t_").over(W.partitionBy(*of).orderBy("p_").rowsBetween(W.unboundedPreceding, 0)) - F.col("t_")).alias("before_"), F.sum("t_").over(W.partitionBy(*of)).alias("all_"))
    inside = F.sum("n_").over(W.partitionBy(*of, "p_").orderBy("v_").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_")
    same = [F.col(g).eqNullSafe(F.col(f"{g}b_")) for g in of] + [F.col("p_") == F.col("pb_")]
    placed = values.withColumn("inside_", inside).join(F.broadcast(before), same)  # one row for each range, of a group
    rank = F.col("before_") + F.col("inside_") + (F.col("n_") + 1) / 2
    kept = (rank - 0.5) / F.col("all_")
    if kind == "gaussian":
        placed = with_probit(placed, "r_", kept)
    else:
        placed = placed.withColumn("r_", {"average": rank, "percent": rank / F.col("all_"), "tie_kept": kept}[kind])
    own = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, of, strict=True)] + [F.col(x) == F.col("v_")]
    return df.join(placed.select(*of, "v_", F.col("r_").alias(name)), own, "left").drop("v_", *of)


def scaled_over_all(df: DataFrame, name: str, x: str) -> DataFrame:
    """z-score over the whole table, from one aggregate row."""
    one = df.agg(F.avg(x).alias("m_"), F.stddev_pop(x).alias("s_"))
    return df.crossJoin(F.broadcast(one)).withColumn(name, F.when(F.col(x).isNotNull(), F.when(F.col("s_") == 0, 0.0).otherwise((F.col(x) - F.col("m_")) / F.col("s_")))).drop("m_", "s_")

"""Scores of signals within eras. Long form in: one row for each (era, id, signal); one row for each (era, signal) out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import with_probit
from ..functions.ranking import average_rank, clean, signed_power, with_rank_gaussian
from .contracts import ContractError
from .grams import masked_products, pairwise_correlations
from .large import Groups


def long_signals(df: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep..., signal, value), one for each signal column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), clean(s).alias("value")) for s in signals]))
    return df.select(*keep, pairs.alias("p_")).select(*keep, "p_.signal", "p_.value")


def powered_correlation(long: DataFrame, target: str, era: str = "era", extra: list[str] | None = None) -> DataFrame:
    """CORR: correlation of the rank-Gaussian value and the centred target, both to the signed power 1.5."""
    by = [era, "signal", *(extra or [])]
    usable = long.filter(F.col("value").isNotNull() & clean(target).isNotNull()).withColumn("y_", clean(target))
    rows = _gaussian_and_centred(usable, by, {"g_": "value"}, {"t_": "y_"})
    rows = rows.withColumn("g_", signed_power("g_")).withColumn("t_", signed_power("t_"))
    return rows.groupBy(*by).agg(F.try_divide(F.covar_pop("g_", "t_"), F.stddev_pop("g_") * F.stddev_pop("t_")).alias("corr"))


def _gaussian_and_centred(rows: DataFrame, by: list[str], ranked: dict[str, str], centred: dict[str, str]) -> DataFrame:
    """rows with the normal quantiles of the tie-kept ranks of some columns, and others less their mean, by group: in windows,
    or by ranges where groups are large. No column is null."""
    rows = rows.select(*by, *dict.fromkeys([*ranked.values(), *centred.values(), *[c for c in ("y_", "z_") if c in rows.columns]]))
    groups = Groups(rows, list(ranked.values()), by, list(centred.values()))
    if groups.ranges is None:
        for name, x in ranked.items():
            rows = with_rank_gaussian(rows, name, x, *by)
        return rows.withColumns({n: F.col(x) - F.avg(x).over(W.partitionBy(*by)) for n, x in centred.items()})
    for name, x in ranked.items():
        rows = with_probit(groups.ranked(rows, "rank_", "count_", x), name, (F.col("rank_") - 0.5) / F.col("count_")).drop("rank_", "count_")
    if centred:
        rows = groups.with_means(rows, [f"{n}mean_" for n in centred])
    return rows.withColumns({n: F.col(x) - F.col(f"{n}mean_") for n, x in centred.items()})


def contribution(long: DataFrame, target: str, reference: str, era: str = "era", target_scale: float = 4.0, name: str = "contribution") -> DataFrame:
    """What a signal adds to a reference: rank-Gaussian both, the signal less its projection on the reference, times the
    centred target, over the rows. target_scale is 4 for targets in 0 to 1."""
    by = [era, "signal"]
    usable = long.filter(F.col("value").isNotNull() & clean(target).isNotNull() & clean(reference).isNotNull())
    rows = _gaussian_and_centred(usable.withColumns({"y_": clean(target), "z_": clean(reference)}), by, {"m_": "z_", "p_": "value"}, {}).withColumn("t_", F.col("y_"))
    p, m, t = F.col("p_"), F.col("m_"), F.col("t_")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(m).alias("sm"), F.avg(t).alias("mt"), F.sum(t * p).alias("tp"), F.sum(t * m).alias("tm"), F.sum(m * p).alias("mp"), F.sum(m * m).alias("mm"))
    tp, tm = F.col("tp") - F.col("mt") * F.col("sp"), F.col("tm") - F.col("mt") * F.col("sm")
    return sums.select(*by, (F.lit(target_scale) * (tp - F.coalesce(F.try_divide(F.col("mp"), F.col("mm")), F.lit(0.0)) * tm) / F.col("n")).alias(name))


def era_scores(long: DataFrame, target: str, reference: str, era: str = "era", target_scale: float = 4.0) -> DataFrame:
    """corr, contribution and ref_corr (CORR with the reference as the target) in one pass over the rows that have the value,
    the target and the reference: the ranks are shared, and one aggregation follows them."""
    by = [era, "signal"]
    rows = long.filter(F.col("value").isNotNull() & clean(target).isNotNull() & clean(reference).isNotNull())
    rows = rows.withColumns({"y_": clean(target), "z_": clean(reference)})
    rows = _gaussian_and_centred(rows, by, {"m_": "z_", "p_": "value"}, {"t_": "y_", "u_": "z_"})
    rows = rows.withColumns({"pp_": signed_power("p_"), "tt_": signed_power("t_"), "uu_": signed_power("u_")})
    p, m, t = F.col("p_"), F.col("m_"), F.col("t_")
    projected = F.sum(t * p) - F.coalesce(F.try_divide(F.sum(m * p), F.sum(m * m)), F.lit(0.0)) * F.sum(t * m)
    over = lambda x: F.try_divide(F.covar_pop("pp_", x), F.stddev_pop("pp_") * F.stddev_pop(x))
    return rows.groupBy(*by).agg(over("tt_").alias("corr"), (F.lit(target_scale) * projected / F.count("*")).alias("contribution"), over("uu_").alias("ref_corr"))


def rank_similarity(df: DataFrame, a: str, b: str, era: str = "era") -> DataFrame:
    """Rows (era, similarity, status): Spearman correlation with average ties. Where a signal is constant in an era there is
    none: the similarity is null and the status says which signal is constant, else it is ok. See strict_similarity()."""
    both = df.filter(clean(a).isNotNull() & clean(b).isNotNull())
    ranked = both.withColumn("ra_", average_rank(a, era)).withColumn("rb_", average_rank(b, era))
    flat = lambda c: F.min(c) == F.max(c)
    status = F.when(flat("ra_") & flat("rb_"), "both are constant").when(flat("ra_"), f"{a} is constant").when(flat("rb_"), f"{b} is constant").otherwise("ok")
    return ranked.groupBy(era).agg(F.try_divide(F.covar_pop("ra_", "rb_"), F.stddev_pop("ra_") * F.stddev_pop("rb_")).alias("similarity"), status.alias("status"))


def strict_similarity(df: DataFrame, a: str, b: str, era: str = "era") -> DataFrame:
    """rank_similarity() that refuses constant signals, an era of one row among them."""
    out = rank_similarity(df, a, b, era)
    bad = out.filter("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"), F.min(era).alias("first")).collect()  # three rows at most
    if bad:
        raise ContractError("similarity: " + "; ".join(sorted(f"{r['status']} in {r['n']} eras, as in {r['first']}" for r in bad)))
    return out


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson over the pairs that are both there; null where either is constant."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def weighted_score(scores: DataFrame, multipliers: dict[str, float], name: str = "weighted") -> DataFrame:
    """Sum of score columns times their multipliers, which are required."""
    if not multipliers:
        raise ValueError("multipliers are required")
    return scores.withColumn(name, sum((F.col(c) * F.lit(float(m)) for c, m in multipliers.items()), F.lit(0.0)))


def exposures(df: DataFrame, signal: str, features: list[str], era: str = "era") -> DataFrame:
    """Rows (era, feature, exposure): Pearson of the signal with each feature."""
    wide = df.groupBy(era).agg(*[correlation(clean(signal), clean(f)).alias(f) for f in features])
    return wide.unpivot([era], features, "feature", "exposure")


def max_exposure(exposed: DataFrame, era: str = "era") -> DataFrame:
    """Per era: largest and largest absolute exposure, and the feature of the latter (ties: the last by name)."""
    return exposed.groupBy(era).agg(F.max("exposure").alias("max_exposure"), F.max(F.abs("exposure")).alias("max_abs_exposure"), F.max_by("feature", F.struct(F.abs("exposure"), "feature")).alias("feature"))


def aligned_feature_scores(df: DataFrame, features: list[str], target: str, era: str = "era") -> DataFrame:
    """CORR of every feature by era, times the sign of the feature's mean over the eras."""
    per_era = powered_correlation(long_signals(df, features, [era, target]), target, era)
    sign = F.signum(F.avg("corr").over(W.partitionBy("signal")))
    return per_era.select(era, "signal", (F.col("corr") * sign).alias("corr"))


def target_correlations(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows (a, b, corr) for each pair of targets, over the rows where both are there; null where either is constant there. One
    pass over the rows, which passes on one matrix a task whatever the number of targets."""
    corr = pairwise_correlations(masked_products(df, targets))
    pairs = [(a, b, None if np.isnan(c := corr[i, j]) else float(c)) for i, a in enumerate(targets) for j, b in list(enumerate(targets))[i:]]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, corr double")  # a row for each two targets


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are there in a row."""
    values = [clean(c) for c in columns]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.try_divide(total, sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0)))


def block_loss(df: DataFrame, error: Column, block: str, temperature: float, recency: Column | None = None) -> DataFrame:
    """Per block: mean squared error (weighted by recency where given) and its weight, the softmax of T * (loss / mean loss - 1),
    times the block's share of the recency weights where given; dro_loss is the weighted loss over all blocks."""
    w = F.lit(1.0) if recency is None else recency
    per = df.groupBy(block).agg((F.sum(w * error * error) / F.sum(w)).alias("loss"), F.sum(w).alias("mass_"))
    everything = W.partitionBy()
    raw = F.exp(F.lit(temperature) * (F.col("loss") / F.greatest(F.avg("loss").over(everything), F.lit(2.220446049250313e-16)) - 1))
    per = per.withColumn("raw_", raw if recency is None else raw * F.col("mass_"))
    per = per.withColumn("weight", F.col("raw_") / F.sum("raw_").over(everything))
    return per.withColumn("dro_loss", F.sum(F.col("weight") * F.col("loss")).over(everything)).drop("raw_", "mass_")


def era_balanced_error(df: DataFrame, error: Column, era: str = "era") -> DataFrame:
    """Mean of the eras' mean squared errors."""
    return df.groupBy(era).agg(F.avg(error * error).alias("mse")).agg(F.avg("mse").alias("era_balanced_mse"), F.count("*").alias("eras"))

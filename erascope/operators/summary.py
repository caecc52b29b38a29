"""Summaries of era scores along the era axis. Scores are few rows a signal; every window is inside a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import clean

SAFE_SHARPE = "case when std = 0 or isnan(std) then null else mean / std end"


def era_number(era: str = "era"):
    """Eras in time order: by number where they are digits, else as they are."""
    return F.struct(F.expr(f"try_cast(`{era}` as bigint)").alias("n"), F.col(era).alias("s"))


def drawdowns(scores: DataFrame, value: str, by: list[str], era: str = "era", zero_baseline: bool = False) -> DataFrame:
    """scores with the running sum and how far it is below its highest point so far (at least 0 with zero_baseline)."""
    w = W.partitionBy(*by).orderBy(era_number(era)).rowsBetween(W.unboundedPreceding, 0)
    out = scores.withColumn("cumulative", F.sum(value).over(w))
    peak = F.max("cumulative").over(w)
    return out.withColumn("drawdown", (F.greatest(peak, F.lit(0.0)) if zero_baseline else peak) - F.col("cumulative"))


def summarize(scores: DataFrame, value: str, by: list[str], era: str = "era", zero_baseline: bool = False, sample_std: bool = False) -> DataFrame:
    """mean, std (population, or sample), sharpe (null at std 0), max_drawdown and eras, one row for each of by."""
    std = F.stddev_samp(value) if sample_std else F.stddev_pop(value)
    out = drawdowns(scores, value, by, era, zero_baseline).groupBy(*by).agg(F.avg(value).alias("mean"), std.alias("std"), F.max("drawdown").alias("max_drawdown"), F.count(value).alias("eras"))
    return out.select(*by, "mean", "std", F.expr(SAFE_SHARPE).alias("sharpe"), "max_drawdown", "eras")


def half_delta(scores: DataFrame, value: str, by: list[str], era: str = "era") -> DataFrame:
    """summarize with sample deviation, the drawdown as a negative number, and the gap of the halves' means."""
    w = W.partitionBy(*by)
    first = F.row_number().over(w.orderBy(era_number(era))) <= F.floor(F.count("*").over(w) / 2)
    rows = drawdowns(scores.withColumn("first_", first), value, by, era)  # in one pass, since scores may be dear
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (-F.max("drawdown")).alias("max_drawdown"), F.count(value).alias("eras"), F.abs(F.avg(F.when(F.col("first_"), F.col(value))) - F.avg(F.when(~F.col("first_"), F.col(value)))).alias("delta"))
    return out.select(*by, "mean", "std", F.expr(SAFE_SHARPE).alias("sharpe"), "max_drawdown", "eras", "delta")


def last_eras(scores: DataFrame, n: int, by: list[str], era: str = "era") -> DataFrame:
    """The rows of the last n distinct eras of each of by."""
    return scores.withColumn("rk_", F.dense_rank().over(W.partitionBy(*by).orderBy(era_number(era).desc()))).filter(F.col("rk_") <= n).drop("rk_")


def block_means(scores: DataFrame, value: str, size: int, by: list[str], era: str = "era") -> DataFrame:
    """Means of consecutive blocks of so many eras."""
    block = F.floor((F.row_number().over(W.partitionBy(*by).orderBy(era_number(era))) - 1) / size).cast("int")
    return scores.withColumn("block", block).groupBy(*by, "block").agg(F.avg(value).alias("mean"), F.count("*").alias("eras"))


def segment_means(scores: DataFrame, value: str, blocks: list[tuple[str, int, int]], by: list[str], era: str = "era") -> DataFrame:
    """Means of named ranges (name, first, last) of era numbers; an era in several counts in each."""
    named = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("block"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in blocks]), lambda s: F.col("e_").between(s["a"], s["b"])))
    return scores.withColumn("e_", F.expr(f"try_cast(`{era}` as bigint)")).select("*", named.alias("s_")).groupBy(*by, F.col("s_.block").alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("eras"))


def by_segment(scores: DataFrame, segments: dict[str, tuple[int, int]], era: str = "era") -> DataFrame:
    """scores once for each segment {name: (first, last era number)} that has the era, with a column segment."""
    named = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in segments.items()]), lambda s: F.expr(f"try_cast(`{era}` as bigint)").between(s["a"], s["b"])))
    return scores.select("*", named.alias("s_")).select(*scores.columns, F.col("s_.segment").alias("segment"))


def cumulative_delta(scores: DataFrame, value: str, base: str, by: str = "signal", era: str = "era") -> DataFrame:
    """Running sums of each signal and of its difference from the base signal, 0 where the base lacks the era."""
    own = scores.filter(F.col(by) != base)
    other = scores.filter(F.col(by) == base).select(era, F.col(value).alias("base_"))
    w = W.partitionBy(by).orderBy(era_number(era)).rowsBetween(W.unboundedPreceding, 0)
    joined = own.join(other, era, "left").withColumn("d_", F.col(value) - F.coalesce("base_", F.lit(0.0)))
    return joined.select(era, by, F.sum(value).over(w).alias("cumulative"), F.sum("d_").over(w).alias("cumulative_delta"))


def leaderboard(rows: DataFrame, metric: str, n: int, key: str) -> DataFrame:
    """The n best by metric, nulls last, ties by key."""
    return rows.orderBy(F.col(metric).desc_nulls_last(), F.col(key)).limit(n)


def board_and_missing(rows: DataFrame, metric: str, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(the n best of the rows that have the metric, ties by key; the keys of those that lack it)."""
    has = clean(metric).isNotNull()
    return leaderboard(rows.filter(has), metric, n, key), rows.filter(~has).select(key)


def medians(scores: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact medians of scores, one row for each of by."""
    return scores.groupBy(*by).agg(F.median(value).alias("median"))


def seed_aggregates(scores: DataFrame, value: str, procedure: str = "procedure", seed: str = "seed", era: str = "era") -> DataFrame:
    """Per procedure over its seeds' means: mean, worst, gap, deviation of the means, and sharpe of the seeds' mean series."""
    means = scores.groupBy(procedure, seed).agg(F.avg(value).alias("m_"))
    over_seeds = means.groupBy(procedure).agg(F.avg("m_").alias("mean"), F.min("m_").alias("worst"), (F.max("m_") - F.min("m_")).alias("gap"), F.stddev_pop("m_").alias("dispersion"), F.count("*").alias("seeds"))
    series = scores.groupBy(procedure, era).agg(F.avg(value).alias("v_")).groupBy(procedure).agg(F.try_divide(F.avg("v_"), F.stddev_pop("v_")).alias("sharpe"))
    return over_seeds.join(series, procedure)


def paired_difference(scores: DataFrame, value: str, a: str, b: str, by: str = "signal", era: str = "era") -> DataFrame:
    """One row: mean of a less b over common eras, its standard error, and the share of eras where it is positive."""
    x, y = (scores.filter(F.col(by) == s).select(era, F.col(value).alias(v)) for s, v in ((a, "x_"), (b, "y_")))
    d = x.join(y, era).select((F.col("x_") - F.col("y_")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("standard_error"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("share_positive"), F.count("d").alias("eras"))


def block_bootstrap(series: DataFrame, value: str, resamples: int = 1000, length: int = 8, low: float = 0.05, high: float = 0.95, seed: int = 1337, era: str = "era") -> DataFrame:
    """Confidence interval of the mean by moving blocks: each resample joins ceil(n / length) blocks whose starts come from
    md5 of (seed, resample, block), cut to n values. Block sums come from running sums, so a resample costs a row a block."""
    ordered = series.select(F.col(value).alias("v_"), F.row_number().over(W.orderBy(era_number(era))).alias("i_"))
    running = ordered.withColumn("c_", F.sum("v_").over(W.orderBy("i_").rowsBetween(W.unboundedPreceding, 0))).select("i_", "c_")
    # the series is one row an era: it is sent to every task as one array of running sums
    one = running.agg(F.sort_array(F.collect_list(F.struct("i_", "c_"))).alias("l_")).select(F.concat(F.array(F.lit(0.0)), F.col("l_.c_")).alias("c_"), F.size("l_").alias("n_"))
    spark = series.sparkSession
    blocks = F.ceil(F.col("n_") / length).cast("int")
    draws = spark.range(resamples).withColumnRenamed("id", "resample").crossJoin(F.broadcast(one)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col("block").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.greatest(F.col("n_") - length + 1, F.lit(1))).cast("int")
    size = F.least(F.lit(length), F.col("n_") - F.col("block") * length)
    sums = draws.withColumn("s_", start).withColumn("z_", size).select("resample", "n_", (F.element_at("c_", F.col("s_") + F.col("z_") + 1) - F.element_at("c_", F.col("s_") + 1)).alias("v_"))
    means = sums.groupBy("resample").agg((F.sum("v_") / F.first("n_")).alias("m_"))
    return means.agg(F.expr(f"percentile(m_, {low}D)").alias("low"), F.expr(f"percentile(m_, {high}D)").alias("high"), F.avg("m_").alias("mean"), F.count("*").alias("resamples"))


def cohort_profile(df: DataFrame, targets: list[str], era: str = "era") -> DataFrame:
    """Rows, and missing values of each target, by era."""
    return df.groupBy(era).agg(F.count("*").alias("rows"), *[F.count_if(F.col(t).isNull() | F.isnan(F.col(t).cast("double"))).alias(f"missing_{t}") for t in targets])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts by equal bins from 1; 0 and bins + 1 are below and above."""
    return df.filter(F.col(column).isNotNull()).groupBy(*(by or []), F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("rows"))


def distinct_counts(df: DataFrame, counted: dict[str, Column], by: list[str]) -> DataFrame:
    """Distinct values of some expressions, by name, one row for each of by; nulls do not count."""
    return df.groupBy(*by).agg(*[F.count_distinct(x).alias(n) for n, x in counted.items()])

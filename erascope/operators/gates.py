"""Decision tables: metrics in long form against check specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .summary import segment_means, summarize

TOLERANCE = 1e-12


def passes(value: Column, op: Column, threshold: Column, upper: Column, reference: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a value meets a check: > >= < <=, range (threshold to upper), ratio (at least threshold times the reference).
    Inclusive ones allow the tolerance; a missing value fails."""
    t = F.lit(tolerance)
    said = (
        F.when(op == ">", value > threshold)
        .when(op == ">=", value >= threshold - t)
        .when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold + t)
        .when(op == "range", (value >= threshold - t) & (value <= upper + t))
        .when(op == "ratio", value >= threshold * reference - t)
    )
    return F.coalesce(said, F.lit(False))


def checks(metrics: DataFrame, specs: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., check, metric, value, op, threshold, passed).

    metrics: by..., metric, value, reference (may be null). specs: check, metric, op, threshold, upper; a handful of rows.
    A check whose metric a candidate lacks fails.
    """
    candidates = metrics.select(*by).distinct()
    wanted = candidates.crossJoin(F.broadcast(specs))  # a decision table
    joined = wanted.join(metrics, [*by, "metric"], "left")
    return joined.select(*by, "check", "metric", "value", "op", "threshold", passes(F.col("value"), F.col("op"), F.col("threshold"), F.col("upper"), F.col("reference")).alias("passed"))


def eligible(checked: DataFrame, by: list[str]) -> DataFrame:
    """Per candidate: whether all checks passed, and how many failed."""
    return checked.groupBy(*by).agg(F.bool_and("passed").alias("eligible"), F.count_if(~F.col("passed")).alias("failed"))


def select_candidate(candidates: DataFrame, best: str, tie: float, order: list[Column], scope: list[str] | None = None) -> DataFrame:
    """Of the eligible candidates within tie of the best, the first by order; no row if none is eligible."""
    w = W.partitionBy(*(scope or []))
    near = candidates.filter("eligible").withColumn("top_", F.max(best).over(w)).filter(F.col(best) >= F.col("top_") - F.lit(tie))
    return near.withColumn("rn_", F.row_number().over(w.orderBy(*order))).filter("rn_ = 1").drop("rn_", "top_")


def replication_vote(checked: DataFrame, by: list[str], realisation: str, needed: int = 2, ensemble: DataFrame | None = None) -> DataFrame:
    """Per candidate: realisations that pass all their checks, and whether enough do. With the checks of an ensemble of the
    realisations (by..., passed), these must all pass as well; a candidate without any fails."""
    each = checked.groupBy(*by, realisation).agg(F.bool_and("passed").alias("p_"))
    votes = each.groupBy(*by).agg(F.count_if("p_").alias("passing"), F.count("*").alias("realisations")).withColumn("replicated", F.col("passing") >= needed)
    if ensemble is None:
        return votes
    whole = ensemble.groupBy(*by).agg(F.bool_and("passed").alias("ensemble_passed"))
    joined = votes.join(whole, by, "left").withColumn("ensemble_passed", F.coalesce("ensemble_passed", F.lit(False)))
    return joined.withColumn("replicated", F.col("replicated") & F.col("ensemble_passed"))


def matched_decision(candidate: DataFrame, control: DataFrame, min_uplift: float, min_positive_blocks: int, worst_seed_margin: float) -> DataFrame:
    """One row from block means (block, mean, worst_seed) of a candidate and its control: uplift of the mean, positive blocks,
    worst-seed guard, and the decision."""
    c = candidate.select("block", F.col("mean").alias("cm"), F.col("worst_seed").alias("cw"))
    k = control.select("block", F.col("mean").alias("km"), F.col("worst_seed").alias("kw"))
    one = c.join(k, "block").agg((F.avg("cm") - F.avg("km")).alias("uplift"), F.count_if(F.col("cm") > F.col("km")).alias("positive_blocks"), (F.min("cw") - F.min("kw")).alias("worst_gap"), F.count("*").alias("blocks"))
    return one.withColumn("accepted", (F.col("uplift") >= min_uplift) & (F.col("positive_blocks") >= min_positive_blocks) & (F.col("worst_gap") >= -worst_seed_margin))


@dataclass(frozen=True)
class MatchedLaw:
    """The thresholds of matched_law."""

    min_uplift: float = 0.0
    min_positive_blocks: int = 4
    worst_mean_deficit: float = 0.0
    worst_sharpe_deficit: float = 0.0
    worst_drawdown_ratio: float = 1.0


def matched_law(candidate: DataFrame, control: DataFrame, value: str, blocks: list[tuple[str, int, int]], law: MatchedLaw, seed: str = "seed", era: str = "era") -> DataFrame:
    """One row that decides on a candidate against its control, from their scores (era, seed, value): uplift of the means over
    seeds, named blocks (name, first, last era number) where the candidate's mean is higher, and the worst seed's mean,
    Sharpe and drawdown (zero baseline). Each side is one aggregation of a row a seed and era. A block that either side
    lacks leaves the decision null."""

    def side(scores: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        seeds = summarize(scores, value, [seed], era, zero_baseline=True)
        worst = seeds.agg(F.avg("mean").alias(f"{p}mean"), F.min("mean").alias(f"{p}worst_mean"), F.min("sharpe").alias(f"{p}worst_sharpe"), F.max("max_drawdown").alias(f"{p}worst_drawdown"))
        per_seed = segment_means(scores, value, blocks, [seed], era)
        return worst, per_seed.groupBy("block").agg(F.avg("mean").alias(f"{p}block"))

    (c, cb), (k, kb) = side(candidate, "c_"), side(control, "k_")
    matched = cb.join(kb, "block").agg(F.count_if(F.col("c_block") > F.col("k_block")).alias("positive_blocks"), F.count("*").alias("blocks"))
    one = c.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(matched))  # rows of one table of decisions each: one row
    t = F.lit(TOLERANCE)
    out = one.select(
        (F.col("c_mean") - F.col("k_mean")).alias("uplift"),
        "positive_blocks",
        "blocks",
        (F.col("c_worst_mean") - F.col("k_worst_mean")).alias("worst_mean_gap"),
        (F.col("c_worst_sharpe") - F.col("k_worst_sharpe")).alias("worst_sharpe_gap"),
        F.col("c_worst_drawdown").alias("worst_drawdown"),
        F.col("k_worst_drawdown").alias("control_drawdown"),
    )
    held = (
        (F.col("uplift") >= law.min_uplift - t)
        & (F.col("positive_blocks") >= law.min_positive_blocks)
        & (F.col("worst_mean_gap") >= -law.worst_mean_deficit - t)
        & (F.col("worst_sharpe_gap") >= -law.worst_sharpe_deficit - t)
        & (F.col("worst_drawdown") <= law.worst_drawdown_ratio * F.col("control_drawdown") + t)
    )
    return out.withColumn("promoted", F.when(F.col("blocks") == len(blocks), F.coalesce(held, F.lit(False))))


def parity(control: Column, benchmark: Column, fraction: float = 0.7) -> Column:
    """Whether a control's mean reaches a fraction of the benchmark's; a missing one fails."""
    return F.coalesce(control >= F.lit(fraction) * benchmark, F.lit(False))


def reconcile_metrics(reported: DataFrame, recomputed: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Rows (keys..., reported, recomputed, agrees), outer joined; a value on one side only does not agree."""
    a, b = reported.select(*keys, F.col("value").alias("reported")), recomputed.select(*keys, F.col("value").alias("recomputed"))
    near = F.abs(F.col("reported") - F.col("recomputed")) <= F.lit(atol) + F.lit(rtol) * F.abs("recomputed")
    return a.join(b, keys, "full_outer").withColumn("agrees", F.coalesce(near, F.lit(False)))

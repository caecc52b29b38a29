"""Jobs composed of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import clean, percent_rank, tie_kept_rank
from ..operators import align, contracts, ensemble, gates, scores, summary
from ..operators.grams import fitted, grams, least_squares, linear
from ..sources.store import kept


def gated_contribution(long: DataFrame, target: str, reference: str | None) -> DataFrame:
    """Contribution with status available; where no reference is declared, null with status unavailable and no joins or ranks."""
    if reference is None:
        return long.select("era", "signal").distinct().select("era", "signal", F.lit(None).cast("double").alias("contribution"), F.lit("unavailable").alias("status"))
    return scores.contribution(long, target, reference).withColumn("status", F.lit("available"))


def scoring_job(predictions: DataFrame, targets: DataFrame, references: DataFrame, reference: str, multipliers: dict[str, float], exclude_absent: bool = True, recent: int = 20) -> DataFrame:
    """One row a signal: contracts, strict joins, coverage policy, era scores, weighted score, and their summary.

    predictions: id, era and signal columns; targets: id, target; references: id, era, reference.
    """
    signals = [c for c in predictions.columns if c not in ("id", "era")]
    # all contracts and the coverage in one pass over the keys, then one pass over the values
    bad, covered = contracts.id_contracts(predictions, targets, references)
    contracts.refuse(bad, "predictions and targets")
    absent = [c["era"] for c in covered if not c["matched"]]
    partial = [c["era"] for c in covered if 0 < c["matched"] < c["rows"]]
    contracts.refuse({"partial_eras": len(partial), "absent_eras": 0 if exclude_absent else len(absent)}, "coverage")
    if absent:
        gone = F.broadcast(predictions.sparkSession.createDataFrame([(e,) for e in absent], predictions.select("era").schema))  # one row an era
        predictions = predictions.join(gone, "era", "left_anti")
    joined = align.attach(predictions.join(targets.select("id", "target"), "id"), references, [reference], required=reference)
    long = scores.long_signals(joined, signals, ["id", "era", "target", reference])
    weighted = scores.weighted_score(scores.era_scores(long, "target", reference), multipliers)
    return _summarized(weighted, "weighted", recent, {"corr_mean": F.avg("corr"), "contribution_mean": F.avg("contribution"), "recent_mean": F.avg(F.when(F.col("recent_"), F.col("weighted")))}, zero_baseline=True)


def _summarized(per: DataFrame, value: str, recent: int, more: dict, zero_baseline: bool) -> DataFrame:
    """summary.summarize and further aggregates by signal in one pass over era scores; recent_ marks the last eras."""
    late = F.dense_rank().over(W.partitionBy("signal").orderBy(summary.era_number().desc())) <= recent
    rows = summary.drawdowns(per.withColumn("recent_", late), value, ["signal"], zero_baseline=zero_baseline)
    out = rows.groupBy("signal").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max("drawdown").alias("max_drawdown"), F.count(value).alias("eras"), *[x.alias(n) for n, x in more.items()])
    return out.withColumn("sharpe", F.expr(summary.SAFE_SHARPE))


def alpha_by_date(signal: DataFrame, neutralizers: DataFrame, weights: DataFrame, targets: DataFrame, columns: list[str], era: str = "era", ticker: str = "ticker") -> DataFrame:
    """Rows (era, alpha): a definition of our own. The tie-kept rank of the signal is centred, multiplied by the sample weights,
    cleared of the weighted neutralizers, multiplied by the weights again, scaled to absolute sum 1 and multiplied with the
    centred target. Rows without any neutralizer value are left out."""
    some = neutralizers.filter(F.greatest(*[clean(c).isNotNull() for c in columns]) if len(columns) > 1 else clean(columns[0]).isNotNull())
    rows = align.common_keys([signal, some, weights, targets], [era, ticker])
    s = tie_kept_rank("signal", era)
    rows = rows.withColumn("s_", s).withColumn("y_", (F.col("s_") - F.avg("s_").over(W.partitionBy(era))) * F.col("weight"))
    scaled = [f"w_{c}" for c in columns]
    for c, w in zip(columns, scaled, strict=True):
        rows = rows.withColumn(w, F.coalesce(clean(c), F.lit(0.0)) * F.col("weight"))
    rows = _projected_out(rows, "y_", scaled, era).withColumn("v_", F.col("y_") * F.col("weight"))
    t = F.col("target") - F.avg("target").over(W.partitionBy(era))
    return rows.withColumn("t_", t).groupBy(era).agg(F.try_divide(F.sum(F.col("v_") * F.col("t_")), F.sum(F.abs("v_"))).alias("alpha"))


def _projected_out(df: DataFrame, y: str, xs: list[str], era: str) -> DataFrame:
    """y less its projection on xs (no constant), by era; the sums are the only thing gathered for an era."""
    betas = fitted(grams(df, y, xs, [era]), [era], len(xs), least_squares(constant=False, varying=False))
    return df.join(betas, era).withColumn(y, F.col(y) - linear("beta_", xs, constant=False)).drop("beta_")


def model_comparison(df: DataFrame, signals: list[str], target: str, reference: str, recent: int) -> DataFrame:
    """One row a signal, the reference itself among them: CORR, contribution, both over the last eras, and CORR with the
    reference."""
    long = scores.long_signals(df.withColumn("ref_", F.col(reference)), signals, ["id", "era", target, "ref_"])
    per = scores.era_scores(long, target, "ref_")
    recent_ = lambda c: F.avg(F.when(F.col("recent_"), F.col(c)))
    out = _summarized(per, "corr", recent, {"bmc_mean": F.avg("contribution"), "ref_corr_mean": F.avg("ref_corr"), "bmc_recent": recent_("contribution"), "ref_corr_recent": recent_("ref_corr")}, zero_baseline=False)
    return out.select("signal", F.col("mean").alias("corr_mean"), F.col("sharpe").alias("corr_sharpe"), "bmc_mean", "ref_corr_mean", "bmc_recent", "ref_corr_recent")


def evaluation_job(df: DataFrame, candidates: list[str], target: str, reference: str, segments: dict[str, tuple[int, int]], specs: DataFrame, calibration: str, holdout: str, best: str = "corr", tie: float = 1e-4, blends: tuple[str, str, list[float]] | None = None, manifest: DataFrame | None = None, fold: str = "cv_fold", by_risk: bool = True) -> DataFrame:
    """Selection on one segment, promotion on another: candidates are scored by era, summarized on the calibration segment and
    checked; the holdout is only read if one is selected. One row (selected, promoted), or none.

    With blends (a, b, weights of a) the candidates are also the blends w35 and so on. With a manifest (id, era, and target and
    fold where it has them) the cohort must hold its rows and no others, with the same targets and folds, and each era lies in
    one fold. Of candidates within tie of the best, the one of the least drawdown goes first, then the one of the least weight,
    then by name; without by_risk, by name alone. A segment's eras are picked before anything is ranked or dealt.
    """
    if manifest is not None:
        also = [c for c in (target, fold) if c in manifest.columns]
        bad = contracts.same_cohort({"manifest": manifest}, df, also=also)
        if fold in also:
            bad["eras_in_several_folds"] = align.folds_of_eras(df, fold).count()
        contracts.refuse(bad, "cohort")
    weights = dict.fromkeys(candidates, 0.0)
    if blends is not None:
        weights |= {f"w{round(100 * w)}": float(w) for w in blends[2]}
    columns = list(dict.fromkeys(["id", "era", target, reference, *candidates, *(blends[:2] if blends is not None else ())]))

    def means(name: str, wanted: list[str]) -> DataFrame:
        first, last = segments[name]
        part = df.filter(F.expr("try_cast(era as bigint)").between(first, last)).select(*columns)
        mixed = [w for w in (blends[2] if blends is not None else []) if f"w{round(100 * w)}" in wanted]
        if mixed:
            part = ensemble.two_signal_blends(part, *blends[:2], mixed)
            # scores read their rows several times
            part = kept(part.select("id", "era", target, reference, *[c for c in wanted if c not in ("id", "era", target, reference)]), "blended")
        long = scores.long_signals(part.withColumn("ref_", F.col(reference)), wanted, ["id", "era", target, "ref_"])
        per = summary.drawdowns(scores.era_scores(long, target, "ref_"), best, ["signal"], zero_baseline=True)
        wide = per.groupBy("signal").agg(F.avg("corr").alias("corr"), F.avg("contribution").alias("contribution"), F.max("drawdown").alias("drawdown"))
        return wide.unpivot(["signal"], ["corr", "contribution", "drawdown"], "metric", "value").withColumn("reference", F.lit(None).cast("double"))

    first = kept(means(calibration, list(weights)), "evaluation")  # three rows a candidate
    passed = gates.eligible(gates.checks(first, specs, ["signal"]), ["signal"])
    of = lambda metric, name: first.filter(F.col("metric") == metric).select("signal", F.col("value").alias(name))
    ranked = passed.join(of(best, "best"), "signal").join(of("drawdown", "risk"), "signal").withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("signal")))
    selected = gates.select_candidate(ranked, "best", tie, [*([F.round("risk", 9), F.col("weight")] if by_risk else []), F.col("signal")]).select("signal")
    row = selected.first()
    spark = df.sparkSession
    if row is None:
        return spark.createDataFrame([], "selected string, promoted boolean")
    second = gates.checks(means(holdout, [row[0]]), specs, ["signal"])
    return gates.eligible(second, ["signal"]).select(F.col("signal").alias("selected"), F.col("eligible").alias("promoted"))


def replication_job(runs: dict[str, DataFrame], base: DataFrame, control: str, target: str, reference: str, specs: DataFrame, needed: int = 2, recent: int = 40, blocks: list[tuple[str, int, int]] | None = None, also: list[str] | None = None) -> DataFrame:
    """Several runs (id, era, prediction) of one procedure on the cohort of base (id, era, target, reference, control): one row
    a run, and one for the ensemble, the mean of their ranks within eras.

    The runs must hold the cohort's ids and eras, once each, and the same values of the columns in also (target, fold and
    benchmark, say, which runs and base then have); else an error is raised. Columns: signal, corr, contribution, recent,
    drawdown, passed (all checks of specs, whose ratios refer to the control's metrics), block_<name> (mean corr of each block
    (name, first, last era number)), and on each row what the runs say together: passing (runs that pass), gap (between the
    runs' best and worst corr), seed_mean, seed_worst, seed_dispersion and seed_sharpe (of their means and mean series),
    replicated (needed of them and the ensemble pass) and state. The values that are scored are kept in a shared folder, a row
    an id and run, and era scores, a row an era and run.
    """
    contracts.refuse(contracts.same_cohort(runs, base, also=also), "runs")
    rows = None
    for name, df in runs.items():
        part = df.select("id", F.lit(name).alias("signal"), clean("prediction").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.join(base.select("id", "era", target, F.col(reference).alias("ref_")), "id")
    # an id has one era, target and reference by now: as keys they are hashed, as first values they would be sorted
    whole = rows.withColumn("k_", percent_rank("value", "era", "signal")).groupBy("id", "era", target, "ref_").agg(F.lit("ensemble").alias("signal"), F.round(F.avg("k_"), 12).alias("value"))
    own = base.select("id", "era", target, F.col(reference).alias("ref_"), F.lit("control").alias("signal"), clean(control).alias("value"))
    # scores read their rows several times, and a row of the ensemble is two shuffles
    scored = kept(rows.unionByName(whole).unionByName(own).select("era", "signal", "value", target, "ref_"), "replicas")
    per = kept(scores.era_scores(scored, target, "ref_"), "replication")
    late = F.dense_rank().over(W.partitionBy("signal").orderBy(summary.era_number().desc())) <= recent
    placed = summary.drawdowns(per.withColumn("recent_", late), "corr", ["signal"], zero_baseline=True)
    names = ["corr", "contribution", "recent", "drawdown"]
    wide = placed.groupBy("signal").agg(F.avg("corr").alias("corr"), F.avg("contribution").alias("contribution"), F.avg(F.when(F.col("recent_"), F.col("contribution"))).alias("recent"), F.max("drawdown").alias("drawdown"))
    long = wide.unpivot(["signal"], names, "metric", "value")
    control_ = long.filter("signal = 'control'").select("metric", F.col("value").alias("reference"))
    checked = gates.checks(long.filter("signal <> 'control'").join(control_, "metric"), specs, ["signal"]).withColumn("all_", F.lit(1))
    vote = gates.replication_vote(checked.filter("signal <> 'ensemble'"), ["all_"], "signal", needed, checked.filter("signal = 'ensemble'"))
    seeds = summary.seed_aggregates(per.filter(~F.col("signal").isin("control", "ensemble")).withColumn("all_", F.lit(1)), "corr", "all_", "signal")
    seeds = seeds.select("gap", F.col("mean").alias("seed_mean"), F.col("worst").alias("seed_worst"), F.col("dispersion").alias("seed_dispersion"), F.col("sharpe").alias("seed_sharpe"))
    out = wide.filter("signal <> 'control'").join(gates.eligible(checked, ["signal"]).select("signal", F.col("eligible").alias("passed")), "signal")
    if blocks:
        means = summary.segment_means(per, "corr", blocks, ["signal"]).groupBy("signal").agg(*[F.max(F.when(F.col("block") == n, F.col("mean"))).alias(f"block_{n}") for n, _, _ in blocks])
        out = out.join(means, "signal", "left")
    out = out.crossJoin(F.broadcast(vote.select("passing", "ensemble_passed", "replicated"))).crossJoin(F.broadcast(seeds))  # one row each
    return out.withColumn("state", F.when(F.col("replicated"), "replicated").when(F.col("passing") >= needed, "ensemble failed").otherwise("unstable"))

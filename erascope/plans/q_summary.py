"""Queries of summaries over eras, and of ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as EN
from ..operators import scores as S
from ..operators import summary as SU
from .cohorts import EVENTS, LINEITEM, ORDERS, corr_sql, events, lineitem, orders, pct_sql, query, r, rs
from .jobs import model_comparison
from .q_scores import CORR, LONG, SIGNALS, contribution_sql, long_lineitem

PER = """per AS (SELECT era, 'prediction' AS signal, corr(prediction, target) AS value FROM lineitem_c GROUP BY era
  UNION ALL SELECT era, 'benchmark', corr(benchmark, target) FROM lineitem_c GROUP BY era UNION ALL SELECT era, 'feature_a', corr(feature_a, target) FROM lineitem_c GROUP BY era)"""
WITH = f"WITH {LINEITEM}, {PER}"


def per_era(spark, sf_dir):
    """Plain correlation of three signals by era."""
    return long_lineitem(spark, sf_dir).groupBy("era", "signal").agg(S.correlation("value", "target").alias("value"))


def _summary_sql(rows: str, by: str, peak: str = "{p}", std: str = "stddev_pop", sign: str = "") -> str:
    p = "max(c) OVER (PARTITION BY " + by + " ORDER BY era ROWS UNBOUNDED PRECEDING)"
    return f"""cum AS (SELECT *, sum(value) OVER (PARTITION BY {by} ORDER BY era ROWS UNBOUNDED PRECEDING) AS c FROM {rows}), dd AS (SELECT *, {peak.format(p=p)} - c AS d FROM cum),
    su AS (SELECT {by}, avg(value) AS mean, {std}(value) AS std, {sign}max(d) AS max_drawdown, count(value) AS eras FROM dd GROUP BY {by})"""


_COLS = f"{rs('mean')} AS mean, {rs('std')} AS std, {rs('mean / nullif(std, 0)')} AS sharpe, {rs('max_drawdown')} AS max_drawdown, eras"


def _round(df, *keys):
    return df.select(*keys, *[r(c).alias(c) for c in ("mean", "std", "sharpe", "max_drawdown")], "eras")


@query("sum1_summary", f"{WITH}, {_summary_sql('per', 'signal')} SELECT signal, {_COLS} FROM su")
def summary(spark, sf_dir):
    return _round(SU.summarize(per_era(spark, sf_dir), "value", ["signal"]), "signal")


@query("sum2_summary_zero_baseline", f"{WITH}, {_summary_sql('per', 'signal', 'greatest({p}, 0)')} SELECT signal, {_COLS} FROM su")
def summary_zero(spark, sf_dir):
    return _round(SU.summarize(per_era(spark, sf_dir), "value", ["signal"], zero_baseline=True), "signal")


@query("sum2_block_means", f"{WITH}, b AS (SELECT *, (row_number() OVER (PARTITION BY signal ORDER BY era) - 1) // 12 AS block FROM per) SELECT signal, CAST(block AS INTEGER) AS block, {rs('avg(value)')} AS mean, count(*) AS eras FROM b GROUP BY signal, block")
def blocks(spark, sf_dir):
    return SU.block_means(per_era(spark, sf_dir), "value", 12, ["signal"]).select("signal", "block", r("mean").alias("mean"), "eras")


@query(
    "sum3_half_delta",
    f"""{WITH}, {_summary_sql('per', 'signal', std='stddev_samp', sign='-')}, h AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY era) <= count(*) OVER (PARTITION BY signal) // 2 AS first FROM per),
    de AS (SELECT signal, abs(avg(value) FILTER (first) - avg(value) FILTER (NOT first)) AS delta FROM h GROUP BY signal) SELECT su.signal, {_COLS}, {rs('delta')} AS delta FROM su JOIN de ON su.signal = de.signal""",
)
def halves(spark, sf_dir):
    return SU.half_delta(per_era(spark, sf_dir), "value", ["signal"]).select("signal", *[r(c).alias(c) for c in ("mean", "std", "sharpe", "max_drawdown", "delta")], "eras")


_LAST = "late AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY signal ORDER BY era DESC) AS k FROM per) WHERE k <= 20)"


@query("sum4_recent_summary", f"{WITH}, {_LAST}, {_summary_sql('late', 'signal')} SELECT signal, {_COLS} FROM su")
def recent(spark, sf_dir):
    return _round(SU.summarize(SU.last_eras(per_era(spark, sf_dir), 20, ["signal"]), "value", ["signal"]), "signal")


_RANGES = [("early", 1, 24), ("middle", 25, 60), ("late", 61, 200), ("all", 0, 9999)]
_RANGE_SQL = "rg(block, a, b) AS (VALUES ('early', 1, 24), ('middle', 25, 60), ('late', 61, 200), ('all', 0, 9999))"


@query("sum5_named_blocks", f"{WITH}, {_RANGE_SQL} SELECT signal, block, {rs('avg(value)')} AS mean, count(*) AS eras FROM per JOIN rg ON CAST(era AS BIGINT) BETWEEN a AND b GROUP BY signal, block")
def named_blocks(spark, sf_dir):
    return SU.segment_means(per_era(spark, sf_dir), "value", _RANGES, ["signal"]).select("signal", "block", r("mean").alias("mean"), "eras")


@query("sum6_fold_means", f"{WITH}, f AS (SELECT era, ntile(5) OVER (ORDER BY era) - 1 AS cv_fold FROM (SELECT DISTINCT era FROM lineitem_c)) SELECT signal, CAST(cv_fold AS INTEGER) AS cv_fold, {rs('avg(value)')} AS mean FROM per JOIN f ON per.era = f.era GROUP BY ALL")
def fold_means(spark, sf_dir):
    from ..operators.splits import chronological_blocks

    per = per_era(spark, sf_dir)
    folds = chronological_blocks(per, 5).withColumnRenamed("block", "cv_fold")
    return per.join(F.broadcast(folds), "era").groupBy("signal", "cv_fold").agg(r(F.avg("value")).alias("mean"))  # one row an era


SEGMENTS = {"calibration": (0, 50), "holdout": (51, 9999), "full": (0, 9999)}
_SEG = "sg(segment, a, b) AS (VALUES ('calibration', 0, 50), ('holdout', 51, 9999), ('full', 0, 9999)), seg AS (SELECT per.*, segment FROM per JOIN sg ON CAST(era AS BIGINT) BETWEEN a AND b)"


@query("sum7_segment_summary", f"{WITH}, {_SEG}, {_summary_sql('seg', 'segment, signal')} SELECT segment, signal, {_COLS} FROM su")
def segments(spark, sf_dir):
    return _round(SU.summarize(SU.by_segment(per_era(spark, sf_dir), SEGMENTS), "value", ["segment", "signal"]), "segment", "signal")


@query(
    "sum8_cumulative_delta",
    f"""{WITH}, base AS (SELECT era, value AS b FROM per WHERE signal = 'benchmark') SELECT per.era, signal, {rs('sum(value) OVER (PARTITION BY signal ORDER BY per.era ROWS UNBOUNDED PRECEDING)')} AS cumulative,
    {rs('sum(value - coalesce(b, 0)) OVER (PARTITION BY signal ORDER BY per.era ROWS UNBOUNDED PRECEDING)')} AS cumulative_delta FROM per LEFT JOIN base ON per.era = base.era WHERE signal <> 'benchmark'""",
)
def curves(spark, sf_dir):
    return SU.cumulative_delta(per_era(spark, sf_dir), "value", "benchmark").select("era", "signal", r("cumulative").alias("cumulative"), r("cumulative_delta").alias("cumulative_delta"))


@query("sum9_leaderboard", f"WITH {LINEITEM}, m AS (SELECT era, {rs('CASE WHEN CAST(era AS BIGINT) % 7 = 0 THEN NULL ELSE corr(prediction, target) END')} AS metric FROM lineitem_c GROUP BY era) SELECT era, metric FROM m ORDER BY metric DESC NULLS LAST, era LIMIT 80")
def leaderboard(spark, sf_dir):
    """Eras by a metric that some lack; those come last."""
    per = lineitem(spark, sf_dir).groupBy("era").agg(r(S.correlation("prediction", "target")).alias("m_"))
    return SU.leaderboard(per.select("era", F.when(F.col("era").cast("bigint") % 7 != 0, F.col("m_")).alias("metric")), "metric", 80, "era")


@query(
    "sum9_board_and_missing",
    f"WITH {LINEITEM}, m AS (SELECT era, {rs('CASE WHEN CAST(era AS BIGINT) % 7 = 0 THEN NULL ELSE corr(prediction, target) END')} AS metric FROM lineitem_c GROUP BY era) SELECT era, metric, true AS listed FROM (SELECT * FROM m WHERE metric IS NOT NULL ORDER BY metric DESC, era LIMIT 20) UNION ALL SELECT era, NULL, false FROM m WHERE metric IS NULL",
)
def board_and_missing(spark, sf_dir):
    """The twenty best eras, and those that lack the metric."""
    per = lineitem(spark, sf_dir).groupBy("era").agg(r(S.correlation("prediction", "target")).alias("m_"))
    board, missing = SU.board_and_missing(per.select("era", F.when(F.col("era").cast("bigint") % 7 != 0, F.col("m_")).alias("metric")), "metric", 20, "era")
    return board.withColumn("listed", F.lit(True)).unionByName(missing.select("era", F.lit(None).cast("double").alias("metric"), F.lit(False).alias("listed")))


@query(
    "sum10_seed_aggregates",
    f"""WITH {LINEITEM}, ps AS (SELECT era, CASE WHEN feature_b >= 3 THEN 'b' ELSE 'a' END AS procedure, CAST(feature_b AS INTEGER) AS seed, {corr_sql('prediction', 'benchmark')} AS value FROM lineitem_c GROUP BY ALL),
    m AS (SELECT procedure, seed, avg(value) AS m FROM ps GROUP BY ALL), o AS (SELECT procedure, avg(m) AS mean, min(m) AS worst, max(m) - min(m) AS gap, stddev_pop(m) AS dispersion, count(*) AS seeds FROM m GROUP BY procedure),
    se AS (SELECT procedure, avg(v) / nullif(stddev_pop(v), 0) AS sharpe FROM (SELECT procedure, era, avg(value) AS v FROM ps GROUP BY ALL) GROUP BY procedure)
    SELECT o.procedure, {rs('mean')} AS mean, {rs('worst')} AS worst, {rs('gap')} AS gap, {rs('dispersion')} AS dispersion, seeds, {rs('sharpe')} AS sharpe FROM o JOIN se ON o.procedure = se.procedure""",
)
def seeds(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("procedure", F.when(F.col("feature_b") >= 3, "b").otherwise("a")).withColumn("seed", F.col("feature_b").cast("int"))
    per = df.groupBy("era", "procedure", "seed").agg(S.correlation("prediction", "benchmark").alias("value"))
    return SU.seed_aggregates(per, "value").select("procedure", *[r(c).alias(c) for c in ("mean", "worst", "gap", "dispersion", "sharpe")], "seeds")


@query("sum11_medians", f"{WITH} SELECT signal, {rs('median(value)')} AS median FROM per GROUP BY signal")
def medians(spark, sf_dir):
    return SU.medians(per_era(spark, sf_dir), "value", ["signal"]).select("signal", r("median").alias("median"))


@query(
    "sum12_paired_difference",
    f"{WITH}, d AS (SELECT x.value - y.value AS d FROM per x JOIN per y ON x.era = y.era WHERE x.signal = 'prediction' AND y.signal = 'benchmark') SELECT {rs('avg(d)')} AS mean, {rs('stddev_samp(d) / sqrt(count(d))')} AS standard_error, {rs('avg(CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END)')} AS share_positive, count(d) AS eras FROM d",
)
def paired(spark, sf_dir):
    return SU.paired_difference(per_era(spark, sf_dir), "value", "prediction", "benchmark").select(r("mean").alias("mean"), r("standard_error").alias("standard_error"), r("share_positive").alias("share_positive"), "eras")


@query(
    "sum13_block_bootstrap",
    f"""{WITH}, s AS (SELECT row_number() OVER (ORDER BY era) AS i, value AS v FROM per WHERE signal = 'prediction'), n AS (SELECT count(*) AS n FROM s),
    bl AS (SELECT g.r AS resample, b.b AS block, n, CAST(('0x' || substr(md5('1337:' || g.r || ':' || b.b), 1, 8)) AS BIGINT) % greatest(n - 8 + 1, 1) AS start FROM n, generate_series(0, 999) AS g(r), generate_series(0, CAST(ceil(n / 8e0) AS BIGINT) - 1) AS b(b)),
    m AS (SELECT resample, sum(v) / max(n) AS m FROM bl JOIN s ON s.i > start AND s.i <= start + least(8, n - block * 8) GROUP BY resample)
    SELECT {rs('quantile_cont(m, 5e-2)')} AS low, {rs('quantile_cont(m, 95e-2)')} AS high, {rs('avg(m)')} AS mean, count(*) AS resamples FROM m""",
)
def bootstrap(spark, sf_dir):
    series = per_era(spark, sf_dir).filter("signal = 'prediction'")
    return SU.block_bootstrap(series, "value").select(r("low").alias("low"), r("high").alias("high"), r("mean").alias("mean"), "resamples")


@query("sum14_cohort_profile", f"WITH {ORDERS}, x AS (SELECT era, target, CASE WHEN feature_b = 0 THEN NULL ELSE target END AS aux FROM orders_c) SELECT era, count(*) AS rows, count(*) FILTER (target IS NULL) AS missing_target, count(*) FILTER (aux IS NULL) AS missing_aux FROM x GROUP BY era")
def profile(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("aux", F.when(F.col("feature_b") != 0, F.col("target")))
    return SU.cohort_profile(df, ["target", "aux"])


@query("sum15_histogram", f"WITH {LINEITEM}, x AS (SELECT feature_b, CASE WHEN benchmark < 0 THEN 0 WHEN benchmark >= 50 THEN 11 ELSE CAST(floor(benchmark * 10 / 50e0) AS INTEGER) + 1 END AS bin FROM lineitem_c) SELECT {rs('feature_b')} AS feature_b, CAST(bin AS BIGINT) AS bin, count(*) AS rows FROM x GROUP BY ALL")
def histogram(spark, sf_dir):
    return SU.histogram(lineitem(spark, sf_dir), "benchmark", 0, 50, 10, ["feature_b"]).select(r("feature_b").alias("feature_b"), "bin", "rows")


@query("sum16_distinct_per_date", f"WITH {EVENTS} SELECT era, count(DISTINCT ticker) AS tickers, count(DISTINCT CASE WHEN kind <> 'view' THEN ticker END) AS other_tickers FROM events_c GROUP BY era")
def distinct_per_date(spark, sf_dir):
    return SU.distinct_counts(events(spark, sf_dir), {"tickers": F.col("ticker"), "other_tickers": F.when(F.col("kind") != "view", F.col("ticker"))}, ["era"])


_REF = CORR.replace("ck AS", "rk AS").replace("cg AS", "rg AS").replace("cs AS", "rsx AS").replace("FROM ck", "FROM rk").replace("FROM cg", "FROM rg").replace("FROM cs", "FROM rsx").replace("corrs AS", "refs AS").replace("target - avg(target)", "ref - avg(ref)")


@query(
    "sum17_model_comparison",
    f"""WITH {LINEITEM}, {LONG}, {CORR}, {_REF}, {contribution_sql('long', 'ref', 'con')}, a AS (SELECT corrs.era, corrs.signal, corrs.corr, contribution, refs.corr AS ref_corr, dense_rank() OVER (PARTITION BY corrs.signal ORDER BY corrs.era DESC) AS k
    FROM corrs JOIN con ON corrs.era = con.era AND corrs.signal = con.signal JOIN refs ON corrs.era = refs.era AND corrs.signal = refs.signal)
    SELECT signal, {rs('avg(corr)')} AS corr_mean, {rs('avg(corr) / nullif(stddev_pop(corr), 0)')} AS corr_sharpe, {rs('avg(contribution)')} AS bmc_mean, {rs('avg(ref_corr)')} AS ref_corr_mean,
    {rs('avg(contribution) FILTER (k <= 20)')} AS bmc_recent, {rs('avg(ref_corr) FILTER (k <= 20)')} AS ref_corr_recent FROM a GROUP BY signal""",
)
def comparison(spark, sf_dir):
    out = model_comparison(lineitem(spark, sf_dir), SIGNALS, "target", "benchmark", 20)
    return out.select("signal", *[r(c).alias(c) for c in out.columns if c != "signal"])


_RANKED = f"q AS (SELECT id, era, {pct_sql('prediction')} AS a, {pct_sql('benchmark')} AS b, {pct_sql('feature_a')} AS c FROM lineitem_c)"


@query("ens1_two_signal_blends", f"WITH {LINEITEM}, {_RANKED}, w AS (SELECT id, era, 35e-2 * a + 65e-2 * b AS x, 75e-2 * a + 25e-2 * b AS y FROM q) SELECT id, era, {rs(pct_sql('round(x, 12)'))} AS w35, {rs(pct_sql('round(y, 12)'))} AS w75 FROM w")
def blends(spark, sf_dir):
    return EN.two_signal_blends(lineitem(spark, sf_dir).select("id", "era", *SIGNALS), "prediction", "benchmark", [0.35, 0.75]).select("id", "era", r("w35").alias("w35"), r("w75").alias("w75"))


@query(
    "ens2_seed_ensemble",
    f"WITH {LINEITEM}, {_RANKED}, m AS (SELECT id, era, b, round((a + c) / 2, 12) AS m FROM q), s AS (SELECT id, era, b, {pct_sql('m')} AS s FROM m), t AS (SELECT id, era, round(s * 5e-1 + b * 5e-1, 12) AS t FROM s) SELECT id, era, {rs(pct_sql('t'))} AS ensemble FROM t",
)
def seed_ensemble(spark, sf_dir):
    return EN.seed_ensemble(lineitem(spark, sf_dir).select("id", "era", *SIGNALS), ["prediction", "feature_a"], "benchmark").select("id", "era", r("ensemble").alias("ensemble"))


@query("ens3_weighted_blend", f"WITH {LINEITEM}, {_RANKED}, m AS (SELECT id, era, round(5e-1 * a + 3e-1 * b + 2e-1 * c, 12) AS m FROM q) SELECT id, era, {rs(pct_sql('m'))} AS blend FROM m")
def weighted_blend(spark, sf_dir):
    return EN.rank_blend(lineitem(spark, sf_dir).select("id", "era", *SIGNALS), {"prediction": 0.5, "benchmark": 0.3, "feature_a": 0.2}).select("id", "era", r("blend").alias("blend"))


@query("ens4_mean_of_ranks", f"WITH {LINEITEM}, {_RANKED} SELECT id, era, {rs('(a + b + c) / 3')} AS ensemble FROM q")
def mean_of_ranks(spark, sf_dir):
    return EN.mean_of_ranks(lineitem(spark, sf_dir).select("id", "era", *SIGNALS), SIGNALS).select("id", "era", r("ensemble").alias("ensemble"))


@query("ens5_target_ensemble", f"WITH {LINEITEM}, {_RANKED}, m AS (SELECT id, era, round((a + b + c) / 3, 12) AS m FROM q) SELECT id, era, {rs('row_number() OVER (PARTITION BY era ORDER BY m, id) / CAST(count(*) OVER (PARTITION BY era) AS DOUBLE)')} AS ensemble FROM m")
def target_ensemble(spark, sf_dir):
    return EN.target_ensemble(lineitem(spark, sf_dir).select("id", "era", *SIGNALS), SIGNALS).select("id", "era", r("ensemble").alias("ensemble"))

"""Queries of rank transforms and residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import probit_sql
from ..functions.ranking import percent_rank
from ..operators import ranks, residual
from ..operators.splits import predict_linear
from .cohorts import LINEITEM, ORDERS, kept_sql, lineitem, orders, pct_sql, query, r, rs

G = probit_sql("k")


def _one(name, kind, sql_value, pre=None):
    pre = pre or f"x AS (SELECT id, era, {sql_value} AS v FROM lineitem_c)"

    @query(name, f"WITH {LINEITEM}, {pre} SELECT id, era, {rs('v')} AS v FROM x")
    def run(spark, sf_dir):
        return ranks.transform_in_groups(lineitem(spark, sf_dir), {"v": (kind, "benchmark")}, ["era"]).select("id", "era", r("v").alias("v"))


_one("rnk1_percent_rank", "percent", pct_sql("benchmark"))
_one("rnk2_tie_kept_rank", "tie_kept", kept_sql("benchmark"))
_one("rnk3_rank_gaussian", "gaussian", None, f"k AS (SELECT id, era, {kept_sql('benchmark')} AS k FROM lineitem_c), x AS (SELECT id, era, {G} AS v FROM k)")
_one("rnk5_zscore", "zscore", "coalesce((benchmark - avg(benchmark) OVER (PARTITION BY era)) / nullif(stddev_pop(benchmark) OVER (PARTITION BY era), 0), 0)")


@query("rnk3_rank_gaussian_all", f"WITH {LINEITEM}, k AS (SELECT id, (rank() OVER (ORDER BY benchmark) + (count(*) OVER (PARTITION BY benchmark) - 1) / 2e0 - 5e-1) / count(*) OVER () AS k FROM lineitem_c) SELECT id, {rs(G)} AS v FROM k")
def rank_gaussian_all(spark, sf_dir):
    return ranks.ranked_over_all(lineitem(spark, sf_dir), "v", "benchmark").select("id", r("v").alias("v"))


@query("rnk2_tie_kept_rank_ranges", f"WITH {LINEITEM} SELECT id, era, {rs(kept_sql('benchmark'))} AS v FROM lineitem_c")
def tie_kept_by_ranges(spark, sf_dir):
    return ranks.ranked_over_all(lineitem(spark, sf_dir), "v", "benchmark", "tie_kept", by=["era"]).select("id", "era", r("v").alias("v"))


@query("rnk4_first_rank", f"WITH {LINEITEM} SELECT id, era, {rs('row_number() OVER (PARTITION BY era ORDER BY benchmark, id) / CAST(count(*) OVER (PARTITION BY era) AS DOUBLE)')} AS v FROM lineitem_c")
def first_rank(spark, sf_dir):
    return ranks.first_ranked(lineitem(spark, sf_dir), "v", "benchmark", "id", ["era"]).select("id", "era", r("v").alias("v"))


@query("rnk5_zscore_all", f"WITH {ORDERS} SELECT id, {rs('(benchmark - avg(benchmark) OVER ()) / stddev_pop(benchmark) OVER ()')} AS v FROM orders_c")
def zscore_all(spark, sf_dir):
    return ranks.scaled_over_all(orders(spark, sf_dir), "v", "benchmark").select("id", r("v").alias("v"))


@query("rnk6_subtract_scaled", f"WITH {LINEITEM} SELECT id, era, {rs('target - 7e-2 * coalesce((benchmark - avg(benchmark) OVER (PARTITION BY era)) / nullif(stddev_pop(benchmark) OVER (PARTITION BY era), 0), 0)')} AS v FROM lineitem_c")
def subtract(spark, sf_dir):
    return residual.subtract_scaled(lineitem(spark, sf_dir), "v", "target", "benchmark", ["era"]).select("id", "era", r("v").alias("v"))


_FIT = "f AS (SELECT era, avg(benchmark) mx, avg(target) my, covar_pop(target, benchmark) c, var_pop(benchmark) v FROM {c} GROUP BY era)"


@query("rnk7_linear_residual", f"WITH {ORDERS}, {_FIT.format(c='orders_c')} SELECT id, o.era, {rs('target - my - CASE WHEN v > 0 THEN c / v ELSE 0e0 END * (benchmark - mx)')} AS v FROM orders_c o JOIN f ON o.era = f.era")
def residual_by_era(spark, sf_dir):
    return residual.linear_residual(orders(spark, sf_dir), "v", "target", "benchmark", ["era"]).select("id", "era", r("v").alias("v"))


@query("rnk7_linear_residual_all", f"WITH {ORDERS}, f AS (SELECT sum(target * benchmark) / sum(benchmark * benchmark) b FROM orders_c) SELECT id, {rs('target - b * benchmark')} AS v FROM orders_c, f")
def residual_all(spark, sf_dir):
    return residual.linear_residual(orders(spark, sf_dir), "v", "target", "benchmark", [], intercept=False).select("id", r("v").alias("v"))


_PROJECT = f"k AS (SELECT *, {kept_sql('benchmark')} AS k FROM lineitem_c), g AS (SELECT *, {G} AS g, target - avg(target) OVER (PARTITION BY era) AS c FROM k)"


@query("rnk8_projection_residual", f"WITH {LINEITEM}, {_PROJECT} SELECT id, era, {rs('c - coalesce(sum(c * g) OVER (PARTITION BY era) / nullif(sum(g * g) OVER (PARTITION BY era), 0), 0) * g')} AS v FROM g")
def projection(spark, sf_dir):
    return residual.projection_residual(lineitem(spark, sf_dir), "v", "target", "benchmark", ["era"]).select("id", "era", r("v").alias("v"))


_TEMPER = f"""k AS (SELECT *, {kept_sql('benchmark')} AS k FROM lineitem_c), g AS (SELECT *, {G} AS g FROM k),
f AS (SELECT era, avg(target) my, avg(benchmark) mb, avg(g) mg, covar_pop(target, benchmark) cb, var_pop(benchmark) vb, covar_pop(target, g) cg, var_pop(g) vg FROM g GROUP BY era)"""


@query(
    "rnk9_tempered_residual",
    f"WITH {LINEITEM}, {_TEMPER} SELECT id, g.era, {rs('8e-1 * (75e-2 * (target - my - CASE WHEN vb > 0 THEN cb / vb ELSE 0e0 END * (benchmark - mb)) + 25e-2 * (target - my - CASE WHEN vg > 0 THEN cg / vg ELSE 0e0 END * (g - mg))) + 2e-1 * target')} AS v FROM g JOIN f ON g.era = f.era",
)
def tempered(spark, sf_dir):
    spec = residual.TargetSpec("residual", temper=0.25, proportion=0.8)
    return residual.target_transform(lineitem(spark, sf_dir), spec, "v").select("id", "era", r("v").alias("v"))


@query("rnk10_target_transform", f"WITH {LINEITEM} SELECT id, era, {rs('target')} AS raw, {rs('target - 7e-2 * coalesce((benchmark - avg(benchmark) OVER (PARTITION BY era)) / nullif(stddev_pop(benchmark) OVER (PARTITION BY era), 0), 0)')} AS v FROM lineitem_c")
def dispatcher(spark, sf_dir):
    df = residual.target_transform(lineitem(spark, sf_dir), residual.TargetSpec("none"), "raw")
    return residual.target_transform(df, residual.TargetSpec("scaled_subtract"), "v").select("id", "era", r("raw").alias("raw"), r("v").alias("v"))


@query(
    "rnk11_neutralized_one",
    f"WITH {LINEITEM}, f AS (SELECT era, avg(prediction) my, avg(feature_a) mx, covar_pop(prediction, feature_a) c, var_pop(feature_a) v FROM lineitem_c GROUP BY era) SELECT id, l.era, {rs('prediction - my - CASE WHEN v > 0 THEN c / v ELSE 0e0 END * (feature_a - mx)', 4)} AS v FROM lineitem_c l JOIN f ON l.era = f.era",
)
def neutral_one(spark, sf_dir):
    return residual.neutralized(lineitem(spark, sf_dir), "v", "prediction", ["feature_a"], ["era"]).select("id", "era", r("v", 4).alias("v"))


@query(
    "rnk11_neutralized_two",
    f"""WITH {LINEITEM}, f AS (SELECT era, avg(prediction) my, avg(feature_a) ma, avg(feature_b) mb, covar_pop(prediction, feature_a) ya, covar_pop(prediction, feature_b) yb,
    var_pop(feature_a) aa, var_pop(feature_b) bb, covar_pop(feature_a, feature_b) ab FROM lineitem_c GROUP BY era),
    s AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS bbeta FROM f)
    SELECT id, l.era, {rs('prediction - 5e-1 * (my + ba * (feature_a - ma) + bbeta * (feature_b - mb))', 4)} AS v FROM lineitem_c l JOIN s ON l.era = s.era""",
)
def neutral_two(spark, sf_dir):
    return residual.neutralized(lineitem(spark, sf_dir), "v", "prediction", ["feature_a", "feature_b"], ["era"], 0.5).select("id", "era", r("v", 4).alias("v"))


@query("rnk11_neutralized_embeddings")
def neutral_wide(spark, sf_dir):
    """A signal made neutral to sixteen coordinates of the vectors, within labels."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    features = [f"f{i}" for i in range(16)]
    df = v.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("era"), F.col("embedding")[20].cast("double").alias("prediction"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    return residual.neutralized(df, "v", "prediction", features, ["era"]).select("id", "era", r("v").alias("v"))


@query("rnk11_neutralized_sixty")
def neutral_sixty(spark, sf_dir):
    """A signal made neutral to sixty coordinates of the vectors, within halves of the labels."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    features = [f"f{i}" for i in range(60)]
    df = v.select(F.col("vec_id").cast("string").alias("id"), (F.col("label") % 2).cast("string").alias("era"), F.col("embedding")[62].cast("double").alias("prediction"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    return residual.neutralized(df, "v", "prediction", features, ["era"]).select("id", "era", r("v", 6).alias("v"))


@query(
    "rnk12_predict_neutralize_rank",
    f"""WITH {LINEITEM}, p AS (SELECT *, 1e-5 * prediction + 2e-2 * benchmark + 1e-1 AS raw FROM lineitem_c),
    f AS (SELECT era, avg(raw) my, avg(feature_a) mx, covar_pop(raw, feature_a) c, var_pop(feature_a) v FROM p GROUP BY era),
    n AS (SELECT id, p.era, round(raw - my - CASE WHEN v > 0 THEN c / v ELSE 0e0 END * (feature_a - mx), 9) AS v FROM p JOIN f ON p.era = f.era)
    SELECT id, era, {rs(pct_sql('v'))} AS v FROM n""",
)
def predict_neutralize_rank(spark, sf_dir):
    df = predict_linear(lineitem(spark, sf_dir), {"prediction": 1e-5, "benchmark": 2e-2}, 0.1, "p_", rank=False)
    df = residual.neutralized(df, "n_", "p_", ["feature_a"], ["era"]).withColumn("n_", F.round("n_", 9))
    return df.select("id", "era", r(percent_rank("n_", "era")).alias("v"))


@query("rnk13_group_rank_gaussian", f"WITH {LINEITEM}, k AS (SELECT id, era, feature_b, {kept_sql('prediction', 'era, feature_b')} AS k FROM lineitem_c) SELECT id, era, {rs(G)} AS v FROM k")
def group_rank(spark, sf_dir):
    return ranks.transform_in_groups(lineitem(spark, sf_dir), {"v": ("gaussian", "prediction")}, ["era", "feature_b"]).select("id", "era", r("v").alias("v"))

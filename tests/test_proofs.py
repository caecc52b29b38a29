"""Cohort proofs, statuses, pairwise correlations, predictors of two tables, and blends in one exchange."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from erascope.functions.ranking import percent_rank
from erascope.operators import ensemble as EN
from erascope.operators import models as M
from erascope.operators import scores as S
from erascope.operators.contracts import ContractError, same_cohort
from erascope.plans.jobs import evaluation_job, replication_job

PROOF = ["target", "cv_fold", "benchmark"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = [(f"{e}-{i}", f"{e:04d}", float(rng.normal()), float(rng.normal()), float(rng.normal()), float(rng.integers(0, 5)) / 4, e % 3) for e in range(1, 9) for i in range(30)]
    return spark.createDataFrame(rows, "id string, era string, a double, b double, benchmark double, target double, cv_fold int")


def specs(spark):
    return spark.createDataFrame([("any", "corr", ">", -1.0, None)], "check string, metric string, op string, threshold double, upper double")


def test_a_manifest_with_one_wrong_target_or_fold_refuses(spark, panel):
    go = lambda m: evaluation_job(panel, ["a", "b"], "target", "benchmark", {"c": (1, 4), "h": (5, 9)}, specs(spark), "c", "h", manifest=m)
    good = panel.select("id", "era", "target", "cv_fold")
    assert go(good).count() == 1
    with pytest.raises(ContractError, match="'differs_target': 1"):
        go(good.withColumn("target", F.when(F.col("id") == "3-7", 0.125).otherwise(F.col("target"))))
    with pytest.raises(ContractError, match="'differs_target': 1"):
        go(good.withColumn("target", F.when(F.col("id") != "3-7", F.col("target"))))
    with pytest.raises(ContractError, match="'differs_cv_fold': 30"):
        go(good.withColumn("cv_fold", F.when(F.col("era") == "0002", 9).otherwise(F.col("cv_fold"))))
    split = panel.withColumn("cv_fold", F.when(F.col("id") == "3-7", 9).otherwise(F.col("cv_fold")))
    with pytest.raises(ContractError, match="'eras_in_several_folds': 1"):
        evaluation_job(split, ["a"], "target", "benchmark", {"c": (1, 4), "h": (5, 9)}, specs(spark), "c", "h", manifest=split.select("id", "era", "cv_fold"))


def test_runs_prove_targets_folds_and_benchmarks(spark, panel):
    runs = {n: panel.select("id", "era", *PROOF, F.col(n).alias("prediction")) for n in ("a", "b")}
    base = panel.select("id", "era", *PROOF, F.lit(0.5).alias("control") + F.col("b"))
    base = panel.select("id", "era", *PROOF, F.col("b").alias("control"))
    go = lambda r: replication_job(r, base, "control", "target", "benchmark", specs(spark), blocks=[("first", 1, 4), ("last", 5, 8)], also=PROOF)
    got = {r.signal: r for r in go(runs).collect()}
    per = S.era_scores(S.long_signals(panel.withColumn("ref_", F.col("benchmark")), ["a", "b"], ["id", "era", "target", "ref_"]), "target", "ref_").toPandas()
    means = per.groupby("signal")["corr"].mean()
    one = got["a"]
    assert np.isclose(one.seed_mean, means.mean()) and np.isclose(one.seed_worst, means.min()) and np.isclose(one.seed_dispersion, means.std(ddof=0)) and np.isclose(one.gap, means.max() - means.min())
    series = per.groupby("era")["corr"].mean()
    assert np.isclose(one.seed_sharpe, series.mean() / series.std(ddof=0))
    first = per[(per.signal == "a") & (per.era <= "0004")]["corr"].mean()
    assert np.isclose(one.block_first, first) and np.isclose((one.block_first + one.block_last) / 2, one.corr)
    for column, wrong in (("cv_fold", F.lit(7)), ("target", F.lit(0.1)), ("benchmark", F.lit(None).cast("double"))):
        bad = runs | {"b": runs["b"].withColumn(column, F.when(F.col("id") == "8-1", wrong).otherwise(F.col(column)))}
        with pytest.raises(ContractError, match=f"'differs_{column}': 1"):
            go(bad)
    with pytest.raises(ContractError, match="missing"):
        go(runs | {"b": runs["b"].drop("cv_fold")})
    nulls = panel.withColumn("target", F.lit(None).cast("double"))
    assert not any(same_cohort({"x": nulls}, nulls, also=["target"]).values())


def test_constant_signals_are_named_and_refused(spark, panel):
    flat = panel.withColumn("b", F.when(F.col("era") == "0002", 1.0).otherwise(F.col("b"))).withColumn("a", F.when(F.col("era") == "0003", 2.0).otherwise(F.col("a")))
    flat = flat.unionByName(flat.limit(1).withColumn("era", F.lit("0099")))
    got = {r.era: (r.similarity, r.status) for r in S.rank_similarity(flat, "a", "b").collect()}
    assert got["0002"] == (None, "b is constant") and got["0003"] == (None, "a is constant") and got["0099"] == (None, "both are constant")
    assert got["0001"][1] == "ok" and got["0001"][0] is not None
    with pytest.raises(ContractError, match="a is constant in 1 eras, as in 0003"):
        S.strict_similarity(flat, "a", "b")
    assert S.strict_similarity(panel, "a", "b").count() == 8
    assert all(abs(r.similarity - 1) < 1e-12 for r in S.strict_similarity(panel, "a", "a").collect())


def test_pairwise_correlations_equal_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(50, 2, (400, 6)), columns=list("abcdef"))
    pdf["f"] = 3.0
    for i, c in enumerate("bcd"):
        pdf.loc[rng.random(400) < 0.2 * (i + 1), c] = np.nan
    pdf.loc[:, "e"] = np.where(np.arange(400) < 398, np.nan, pdf["e"])
    pdf.loc[5, "a"] = np.inf
    df = spark.createDataFrame(pdf).repartition(7)
    want = pdf.replace(np.inf, np.nan).corr()
    got = {(r.a, r.b): r["corr"] for r in S.target_correlations(df, list("abcdef")).collect()}
    assert len(got) == 21
    for (a, b), v in got.items():
        w = want.loc[a, b]
        assert (v is None) == (np.isnan(w) or "f" in (a, b)), (a, b, v, w)
        assert v is None or abs(v - w) < 1e-9
    assert {r["corr"] for r in S.target_correlations(df.limit(0), ["a", "b"]).collect()} == {None}


def test_predictor_of_two_tables(spark, panel):
    bench = panel.filter("era <> '0005' and id not like '%-3'").select("id", "era", "benchmark")
    bench = bench.unionByName(spark.createDataFrame([("q", "0077", 1.0)], bench.schema))
    live = panel.select("id", "era", "a")

    def model(x, y):
        assert x.index.is_monotonic_increasing and "era" not in x
        return x["a"] + y["benchmark"].reindex(x.index).fillna(-9).rank()

    got = {r.id: r.prediction for r in M.predict_pairs(live, bench, model).collect()}
    pdf, b = live.toPandas(), bench.toPandas().set_index("id")["benchmark"]
    for _, g in pdf.groupby("era"):
        want = g.set_index("id")["a"] + b.reindex(g["id"]).fillna(-9).rank()
        assert all(abs(got[i] - v) < 1e-12 for i, v in want.items())
    assert len(got) == len(pdf)
    with pytest.raises(ContractError, match="more than 10"):
        M.predict_pairs(live, bench, model, most=10)
    with pytest.raises(Exception, match="left out"):
        M.predict_pairs(live, bench, lambda x, y: y["benchmark"]).collect()
    with pytest.raises(Exception, match="repeated"):
        M.predict_pairs(live.unionByName(live.limit(1)), bench, model).collect()
    assert M.predict_pairs(live.limit(0), bench, model).count() == 0


def test_blends_take_one_exchange_and_two_sorts(spark, panel):
    holes = panel.withColumn("a", F.when(F.col("id") != "4-4", F.col("a")))
    out = EN.rank_blends(holes.select("id", "era", "a", "b"), {"x": {"a": 0.3, "b": 0.7}, "y": {"a": 1.0}, "z": {"b": 0.5, "a": 0.5}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("+- Sort [") + plan.count(" Sort [") - plan.count("+- Sort [") == 2, plan
    wide = holes.withColumn("ra", percent_rank("a", "era")).withColumn("rb", percent_rank("b", "era")).withColumn("x", F.round(0.3 * F.col("ra") + 0.7 * F.col("rb"), 12)).withColumn("z", F.round(0.5 * F.col("ra") + 0.5 * F.col("rb"), 12))
    want = {r.id: (r.x, r.y, r.z) for r in wide.withColumn("x", percent_rank("x", "era")).withColumn("y", F.col("ra")).withColumn("z", percent_rank("z", "era")).collect()}
    got = {r.id: (r.x, r.y, r.z) for r in out.collect()}
    assert got.keys() == want.keys() and got["4-4"] == (None, None, None)
    for k, v in got.items():
        assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-9) for g, w in zip(v, want[k], strict=True)), k
    twice = EN.rank_blend(panel.select("id", "era", "a").unionByName(panel.select("id", "era", "a").limit(5)), {"a": 1.0})
    assert twice.count() == panel.count() + 5


def test_native_sums_equal_packed_ones(spark, panel):
    from erascope.operators.residual import neutralized

    df = panel.withColumn("a", F.when(F.col("id") == "1-1", float("nan")).otherwise(F.col("a"))).withColumn("target", F.when(F.col("era") != "0003", F.col("target")).otherwise(0.5))
    for by in (["era"], []):
        got = [{r.id: r.v for r in neutralized(df, "v", "target", ["a", "b", "benchmark"], by, 0.7, native=n).collect()} for n in (True, False)]
        assert len(got[0]) == len(got[1]) == 240
        assert all((got[0][k] is None) == (v is None) and (v is None or abs(got[0][k] - v) < 1e-9) for k, v in got[1].items())
    plan = neutralized(df, "v", "target", ["a"], ["era"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the groups' sums alone
    assert neutralized(df.limit(0), "v", "target", ["a"], []).count() == 0

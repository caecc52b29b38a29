"""Identities, goldens, edge rows and fail-loud cases of the panel operators."""

import json
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from erascope.functions.normal import with_probit
from erascope.functions.ranking import average_rank, clean, percent_rank, zscore
from erascope.operators import align, contracts, ensemble, gates, ranks, residual, scores, splits, summary
from erascope.sources import panel
from erascope.streaming.live import score_drops

NAN, INF = float("nan"), float("inf")


def eras(spark, seed=1, n_eras=6):
    """Eras of 1 to 40 rows with ties, a constant era, an era of one row, NaN, inf and null."""
    rng, rows = random.Random(seed), []
    for e in range(n_eras):
        n = 1 if e == 1 else rng.randint(12, 40)
        for i in range(n):
            p = 5.0 if e == 2 else float(rng.randint(0, 8))
            rows.append((f"{e}-{i}", f"{e + 1:04d}", rng.choice([NAN, INF, None]) if e == 3 and i < 3 else p, float(rng.randint(0, 5)), rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]), rng.gauss(0, 1), rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "id string, era string, prediction double, benchmark double, target double, x double, y double")


def test_probit_against_the_standard_library(spark):
    ps = [1e-300, 1e-9, 0.075, 0.0749999, 0.5, 0.925, 1 - 1e-9, *np.linspace(0.001, 0.999, 333)]
    got = with_probit(spark.createDataFrame([(float(p),) for p in ps], "p double"), "q", F.col("p")).collect()
    assert all(math.isclose(r["q"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-13, abs_tol=1e-13) for r in got)
    edge = with_probit(spark.createDataFrame([(0.0,), (1.0,), (None,), (-1.0,)], "p double"), "q", F.col("p"))
    assert [r["q"] for r in edge.collect()] == [None] * 4


def test_average_rank_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "era string, v double")
    got = df.select("era", "v", average_rank("v", "era").alias("r"), percent_rank("v", "era").alias("p")).collect()
    assert sorted((r["v"], r["r"], r["p"]) for r in got if r["v"] is not None) == [(1.0, 1.0, 1 / 3), (3.0, 2.5, 2.5 / 3), (3.0, 2.5, 2.5 / 3)]
    assert all(r["r"] is None for r in got if r["v"] is None)


def test_rank_over_all_equals_one_window(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, float(rng.randint(0, 30))) for i in range(500)], "id int, v double").withColumn("all", F.lit(1))
    both = ranks.ranked_over_all(df, "a", "v", "average", parts=7).withColumn("b", average_rank("v", "all"))
    assert both.filter("a <> b").count() == 0


def test_rank_by_ranges_equals_windows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), -0.0, *map(float, range(40))])) for i in range(600)] + [(600, "c", None)]
    df = spark.createDataFrame(rows, "id int, era string, v double")
    for kind, plain in (("average", average_rank), ("percent", percent_rank)):
        both = ranks.ranked_over_all(df, "a", "v", kind, parts=7, by=["era"]).withColumn("b", plain("v", "era"))
        assert both.count() == 601 and both.columns == ["id", "era", "v", "a", "b"]
        assert both.filter("not (a <=> b) and not abs(a - b) < 1e-12").count() == 0 and both.filter("a is null and v is not null").count() == 0


def test_zscore_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0)], "era string, v double")
    assert {r[0] for r in df.select(zscore("v", "era")).collect()} == {0.0}


def test_residuals_are_orthogonal_and_contribution_matches_projection(spark):
    df = eras(spark, n_eras=5).filter("era not in ('0002', '0003')").withColumn("prediction", clean("prediction")).filter("prediction is not null")
    out = residual.linear_residual(df, "e", "y", "x", ["era"]).groupBy("era").agg(F.covar_pop("e", "x").alias("c"), F.avg("e").alias("m")).collect()
    assert all(abs(r["c"]) < 1e-12 and abs(r["m"]) < 1e-12 for r in out)
    # the target side of the projection gives the contribution of the signal side
    side = residual.projection_residual(df, "t", "target", "benchmark", ["era"])
    side = ranks.transform_in_groups(side, {"g": ("gaussian", "prediction")}, ["era"]).groupBy("era").agg((4 * F.sum(F.col("t") * F.col("g")) / F.count("*")).alias("s"))
    own = scores.contribution(scores.long_signals(df, ["prediction"], ["id", "era", "target", "benchmark"]), "target", "benchmark")
    for r in side.join(own, "era").collect():
        assert math.isclose(r["s"], r["contribution"], abs_tol=1e-12)


def test_neutralization_equals_pinv_with_a_duplicated_column(spark):
    df = eras(spark, 3).withColumn("x2", F.col("x") * 2).filter("era <> '0002'")
    got = residual.neutralized(df, "v", "y", ["x", "x2", "benchmark"], ["era"]).toPandas()
    for _, g in got.groupby("era"):
        n = np.column_stack([g["x"], g["x2"], g["benchmark"], np.ones(len(g))])
        want = g["y"] - n @ (np.linalg.pinv(n, rcond=1e-6) @ g["y"])
        assert np.allclose(g["v"], want, atol=1e-9)
    lone = residual.neutralized(eras(spark, 3).filter("era in ('0002', '0003')"), "v", "prediction", ["x"], ["era"])
    assert lone.filter("v is not null").count() == 0  # one row, or a constant signal


def test_scores_of_degenerate_eras(spark):
    long = scores.long_signals(eras(spark), ["prediction"], ["id", "era", "target", "benchmark"])
    got = {r["era"]: r["corr"] for r in scores.powered_correlation(long, "target").collect()}
    assert got["0002"] is None and got["0003"] is None and all(-1 <= v <= 1 for v in got.values() if v is not None)
    assert scores.rank_similarity(eras(spark).filter("era = '0001'"), "prediction", "prediction").first()["similarity"] == pytest.approx(1)
    with pytest.raises(ValueError):
        scores.weighted_score(long, {})


def test_scores_do_not_depend_on_row_order(spark):
    df = eras(spark, 5)
    run = lambda d: {(r["era"], r["signal"]): r["corr"] for r in scores.powered_correlation(scores.long_signals(d, ["x", "prediction"], ["id", "era", "target"]), "target").collect()}
    a, b = run(df), run(df.repartition(7).orderBy(F.rand(3)))
    assert a.keys() == b.keys() and all(a[k] == b[k] or math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


@pytest.mark.parametrize(("path", "plain", "zero"), [([-0.02, -0.05, -0.01, -0.03], 0.09, 0.11), ([-0.10, 0.08, -0.04], 0.04, 0.10), ([0.30, -0.10, -0.15, 0.05], 0.25, 0.25)])
def test_drawdown_goldens(spark, path, plain, zero):
    df = spark.createDataFrame([("s", f"{i:04d}", v) for i, v in enumerate(path)], "signal string, era string, v double")
    for flag, want in ((False, plain), (True, zero)):
        assert summary.summarize(df, "v", ["signal"], zero_baseline=flag).first()["max_drawdown"] == pytest.approx(want)


def test_sharpe_of_a_constant_is_null_and_eras_sort_by_number(spark):
    df = spark.createDataFrame([("s", e, 1.0) for e in ("9", "10", "8")], "signal string, era string, v double")
    assert summary.summarize(df, "v", ["signal"]).first()["sharpe"] is None
    assert [r["era"] for r in summary.last_eras(df, 1, ["signal"]).collect()] == ["10"]


def test_blend_endpoints_and_rerank(spark):
    df = eras(spark, 6).filter("era <> '0004'")
    out = ensemble.two_signal_blends(df, "x", "y", [1.0, 0.0]).withColumn("rx", percent_rank("x", "era")).withColumn("ry", percent_rank("y", "era"))
    assert out.filter("abs(w100 - rx) > 1e-12 or abs(w0 - ry) > 1e-12").count() == 0
    firsts = ensemble.target_ensemble(df, ["prediction", "benchmark"]).groupBy("era").agg((F.count("*") - F.count_distinct("ensemble")).alias("d"))
    assert firsts.filter("d <> 0").count() == 0


def test_contracts_fail_loud(spark):
    df = spark.createDataFrame([("a", "0001", 1.0), ("a", "0001", NAN), (None, None, INF)], "id string, era string, v double")
    assert contracts.key_contract(df).first().asDict() == {"null_keys": 1, "duplicate_rows": 1, "null_eras": 1, "empty": 0}
    assert contracts.key_contract(df.limit(0)).first()["empty"] == 1
    assert contracts.finite_contract(df, ["v"]).first()["v"] == 2
    with pytest.raises(contracts.ContractError):
        contracts.finite_contract(df.withColumn("b", F.lit(True)), ["b"])
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.key_contract(df), "df")
    assert contracts.same_column(df, "v", "v").first()["identical"]


def test_strict_joins(spark):
    left = spark.createDataFrame([("c", "0002"), ("a", "0001"), ("b", "0001")], "id string, era string")
    right = spark.createDataFrame([("a", "0001", 1.0), ("b", "0001", 2.0), ("c", "0002", 3.0), ("z", "0009", 4.0)], "id string, era string, v double")
    joined, bad = align.strict_left(left, right, ["v"])
    contracts.enforce(bad, "join")
    assert {r["id"]: r["v"] for r in joined.collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}
    for broken in (right.filter("id <> 'a'"), right.unionByName(right.limit(1)), right.withColumn("era", F.lit("0001")), right.withColumn("v", F.lit(NAN))):
        with pytest.raises(contracts.ContractError):
            contracts.enforce(align.strict_left(left, broken, ["v"])[1], "join")
    with pytest.raises(contracts.ContractError):
        align.strict_left(left, right.withColumn("era", F.col("era").cast("int")), ["v"])
    with pytest.raises(contracts.ContractError):
        align.joined_by_id(left, right.filter("id <> 'a'"), ["v"])
    with pytest.raises(contracts.ContractError):  # a partial era always fails, an absent one by choice
        align.apply_coverage(left, align.coverage(left, right.filter("id <> 'a'")), True)
    absent = align.coverage(left, right.filter("id <> 'c'"))
    assert align.apply_coverage(left, absent, True).count() == 2
    with pytest.raises(contracts.ContractError):
        align.apply_coverage(left, absent, False)


def test_splits_leave_an_embargo_and_cover_every_era(spark):
    df = spark.createDataFrame([(f"{e:04d}",) for e in range(23)], "era string")
    for mode in ("expanding", "blocked"):
        rows = splits.cv_splits(df, 4, 2, mode, min_train=0).collect()
        held = [r["era"] for r in rows if r["role"] == "validation"]
        assert sorted(held) == [f"{e:04d}" for e in range(23)]
        for f in range(4):
            v = [int(r["era"]) for r in rows if r["fold"] == f and r["role"] == "validation"]
            t = [int(r["era"]) for r in rows if r["fold"] == f and r["role"] == "train"]
            assert not [e for e in t if min(v) - 2 <= e < max(v) + 3]
            assert mode == "blocked" or all(e < min(v) for e in t)
    blocks = [r["block"] for r in splits.chronological_blocks(df, 4).orderBy("era").collect()]
    assert blocks == [i for i, a in enumerate(np.array_split(range(23), 4)) for _ in a]
    with pytest.raises(ValueError):
        splits.every_nth_era(df, 1)
    with pytest.raises(ValueError):
        splits.cv_splits(df, 3, mode="other")


def test_balanced_sample_fills_the_cap(spark):
    df = spark.createDataFrame([(f"{e}-{i}", f"{e:04d}") for e, n in enumerate((3, 50, 50, 7)) for i in range(n)], "id string, era string")
    got = {r["era"]: r["count"] for r in splits.balanced_sample(df, 60).groupBy("era").count().collect()}
    assert got == {"0000": 3, "0001": 35, "0002": 15, "0003": 7}
    assert splits.balanced_sample(df, 500).count() == 110
    assert sorted(splits.balanced_sample(df, 60).collect()) == sorted(splits.balanced_sample(df.repartition(5), 60).collect())


def test_out_of_fold_equals_numpy(spark):
    df = eras(spark, 8, 9)
    sp = splits.cv_splits(df, 3, 1, strict=False)
    got = splits.out_of_fold(df, sp, ["x", "benchmark"], "y").toPandas()
    assert not got["id"].duplicated().any()
    pdf, roles = df.toPandas(), sp.toPandas()
    for fold, g in got.groupby("cv_fold"):
        train = pdf[pdf["era"].isin(roles[(roles["fold"] == fold) & (roles["role"] == "train")]["era"])]
        a = np.column_stack([train["x"], train["benchmark"], np.ones(len(train))])
        beta = np.linalg.lstsq(a, train["y"], rcond=None)[0]
        assert np.allclose(g["prediction"], np.column_stack([g["x"], g["benchmark"], np.ones(len(g))]) @ beta, atol=1e-9)


def test_gates_each_condition_alone(spark):
    spec = lambda op, t, u=None: spark.createDataFrame([("c", "m", op, t, u)], "check string, metric string, op string, threshold double, upper double")
    metric = lambda v, ref=None: spark.createDataFrame([("x", "m", v, ref)], "signal string, metric string, value double, reference double")
    cases = [(">", 1.0, None, 1.0, False), (">", 1.0, None, 1.1, True), (">=", 1.0, None, 1.0 - 1e-13, True), ("<", 1.0, None, 0.9, True), ("<=", 1.0, None, 1.1, False), ("range", 1.0, 2.0, 2.0, True), ("range", 1.0, 2.0, 2.1, False), (">", 0.0, None, None, False)]
    for op, t, u, v, want in cases:
        assert gates.checks(metric(v), spec(op, t, u), ["signal"]).first()["passed"] is want, (op, v)
    assert gates.checks(metric(0.9, 1.0), spec("ratio", 0.9), ["signal"]).first()["passed"]
    none = spark.createDataFrame([("a", 1.0, False)], "signal string, best double, eligible boolean")
    assert gates.select_candidate(none, "best", 1e-4, [F.col("signal")]).count() == 0


def test_panel_sources(spark, tmp_path):
    df = eras(spark)
    with pytest.raises(contracts.ContractError):
        panel.resolve_column(df.withColumn("other_x", F.lit(1)).drop("x").withColumn("my_x", F.lit(1)), "x")
    assert panel.resolve_column(df, "pred") == "prediction"
    assert panel.resolve_column(df, "bm", {"bm": "benchmark"}) == "benchmark"
    with pytest.raises(contracts.ContractError):
        panel.write_filtered(df.limit(0), f"file://{tmp_path}/empty")
    df.write.parquet(f"file://{tmp_path}/t")
    with pytest.raises(contracts.ContractError):
        panel.read_columns(spark, f"file://{tmp_path}/t", ["id", "no"])
    plan = panel.in_eras(spark.read.parquet(f"file://{tmp_path}/t").select("id", "era"), ["0001"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(era" in plan or "EqualTo(era" in plan
    codes = spark.createDataFrame([("000640 KS",), ("A",), (None,), ("B ZZ",)], "t string").select(panel.exchange_code(F.col("t"), {"KS": "KR"})).collect()
    assert [r[0] for r in codes] == ["000640 KR", None, None, "B None"]
    with pytest.raises(contracts.ContractError):
        panel.select_groups(df, ["no"], {})
    (tmp_path / "f.json").write_text(json.dumps({"feature_sets": {"a": ["x", "y"], "b": ["y"]}}))
    sizes = {(r["a"], r["b"]): r["size"] for r in panel.set_overlaps(panel.feature_sets(spark, f"file://{tmp_path}/f.json")).collect()}
    assert sizes == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 1}


def test_digest_does_not_depend_on_order(spark):
    df = eras(spark)
    a, b = (panel.digest(d, ["id", "era"]).first() for d in (df, df.repartition(5)))
    assert a == b and panel.digest(df.withColumn("id", F.lit(None).cast("string")), ["id", "era"]).first() != a


def test_stream_scores_only_new_drops(spark, tmp_path):
    drops, out, check = (f"file://{tmp_path}/{n}" for n in ("drops", "out", "check"))
    df = spark.createDataFrame([("a", "0001", 1.0), ("b", "0001", 2.0)], "id string, era string, v double")
    score = lambda d: d.withColumn("p", percent_rank("v", "era"))
    df.coalesce(1).write.parquet(drops)
    score_drops(spark, drops, df.schema, score, out, check)
    df.withColumn("era", F.lit("0002")).coalesce(1).write.mode("append").parquet(drops)
    score_drops(spark, drops, df.schema, score, out, check)
    score_drops(spark, drops, df.schema, score, out, check)
    got = spark.read.parquet(out)
    assert got.count() == 4 and got.filter("p = 1.0").count() == 2


def test_neutralization_to_sixty_columns_equals_pinv(spark):
    from erascope.plans import registry

    data = "/root/testdata/sf0.01"
    for name, k, era in (("rnk11_neutralized_sixty", 60, lambda v: v % 2), ("rnk11_neutralized_embeddings", 16, lambda v: v)):
        pdf = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
        got = registry.QUERIES[name](spark, data).toPandas().set_index("id")["v"]
        z = np.array(pdf["embedding"].tolist(), float)
        y = z[:, 62 if k == 60 else 20]
        for e in set(era(pdf["label"])):
            at = np.flatnonzero(era(pdf["label"]) == e)
            n = np.column_stack([z[at, :k], np.ones(len(at))])
            want = y[at] - n @ (np.linalg.pinv(n) @ y[at])
            assert np.allclose(got.loc[pdf["vec_id"].iloc[at].astype(str)].astype(float), want, atol=2e-6)


def test_plan_of_neutralization_does_not_grow_in_operators(spark):
    df = spark.range(10).select(F.lit("1").alias("era"), *[F.rand(i).alias(f"x{i}") for i in range(40)], F.rand(99).alias("y"))
    nodes = [residual.neutralized(df, "v", "y", [f"x{i}" for i in range(k)], ["era"], native=False)._jdf.queryExecution().sparkPlan().toString().count("\n") for k in (2, 40)]
    assert nodes[0] == nodes[1]


def test_out_of_fold_of_three_features_on_the_table_equals_numpy(spark):
    from erascope.plans import registry
    from erascope.plans.cohorts import orders

    data = "/root/testdata/sf0.001"
    pdf, got = orders(spark, data).toPandas(), registry.QUERIES["trn8_out_of_fold_wide"](spark, data).toPandas()
    roles = splits.cv_splits(orders(spark, data), 5, 4, "blocked").toPandas()
    x = lambda d: np.column_stack([d["benchmark"], d["feature_a"], d["feature_b"], np.ones(len(d))]).astype(float)
    for fold, g in got.groupby("cv_fold"):
        train = pdf[pdf["era"].isin(roles[(roles["fold"] == fold) & (roles["role"] == "train")]["era"])]
        beta = np.linalg.lstsq(x(train), train["target"].astype(float), rcond=None)[0]
        held = pdf.set_index("id").loc[g["id"]]
        assert np.allclose(g["prediction"], x(held) @ beta, atol=2e-6)


def test_out_of_fold_estimators_and_repeated_keys(spark):
    class Nearest:
        def fit(self, x, y):
            self.x, self.y = x[:, 0], y

        def predict(self, x):
            return self.y[np.abs(x[:, :1] - self.x).argmin(axis=1)]

    df = eras(spark, 8, 9)
    sp = splits.cv_splits(df, 3, 1, strict=False)
    out = splits.out_of_fold(df, sp, ["x"], "y", estimator=Nearest(), cap=40).toPandas()
    pdf = df.toPandas()
    assert len(out) and out["prediction"].isin(pdf["y"]).all() and (out.groupby("cv_fold")["prediction"].nunique() <= 40).all()
    with pytest.raises(contracts.ContractError):
        splits.out_of_fold(df.unionByName(df.limit(1)), sp, ["x"], "y")


def test_splits_fail_loud(spark):
    df = spark.createDataFrame([(f"{e:04d}",) for e in range(10)], "era string")
    for bad in (lambda: splits.cv_splits(df, 11, mode="blocked"), lambda: splits.cv_splits(df, 5), lambda: splits.cv_splits(df, 2, 6, "blocked")):
        with pytest.raises(contracts.ContractError):
            bad()
    with pytest.raises(ValueError):
        splits.cv_splits(df, 0)
    assert splits.cv_splits(df, 5, min_train=0).filter("role = 'validation'").count() == 10


def test_capped_sample_takes_the_least(spark):
    import hashlib

    df = spark.range(3000).withColumn("id", F.col("id").cast("string"))
    order = sorted((hashlib.md5(f"3:{i}".encode()).hexdigest(), str(i)) for i in range(3000))
    for cap in (0, 1, 700, 5000):
        assert {r["id"] for r in splits.capped_sample(df, cap, seed=3).collect()} == {i for _, i in order[:cap]}


def test_a_rank_takes_one_sort(spark):
    df = spark.range(10).select(F.lit("1").alias("era"), F.rand(1).alias("v")).withColumn("r", percent_rank("v", "era"))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_eras_are_looked_for_in_the_scan(spark):
    from erascope.plans import registry

    for name, column in (("src2_era_scan", "o_orderdate"), ("src14_prefix_extract", "era"), ("src3_neutralizers_by_date", "ts")):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert any(f"({column}," in part.split("]")[0] for part in plan.split("PushedFilters: [")[1:]), name


def test_cohort_proof_and_key_contracts(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "id string, era string")
    assert not any(contracts.same_cohort({"x": base, "y": base.repartition(3)}, base).values())
    cases = {"missing_keys": base.limit(2), "unexpected_keys": base.unionByName(spark.createDataFrame([("d", "2")], base.schema)), "duplicate_keys": base.unionByName(base.limit(1)), "era_mismatches": base.withColumn("era", F.lit("9"))}
    for problem, run in cases.items():
        assert contracts.same_cohort({"x": run}, base)[problem] > 0, problem
    bad, covered = contracts.id_contracts(base, base.filter("id <> 'c'"), base.filter("id = 'b'"))
    assert bad == {"null_keys": 0, "duplicate_rows": 0, "duplicate_right_rows": 0, "null_eras": 0, "unmatched": 1, "empty": 0}
    assert sorted((c["era"], c["rows"], c["matched"]) for c in covered) == [("1", 1, 0), ("2", 2, 1)]
    assert contracts.id_contracts(base.limit(0), base)[0]["empty"] == 1
    broken = base.unionByName(base.limit(1)).unionByName(spark.createDataFrame([(None, "1"), ("e", None)], base.schema))
    bad, _ = contracts.id_contracts(broken, broken)
    assert bad["duplicate_rows"] == bad["duplicate_right_rows"] == 1 and bad["null_keys"] == 2 and bad["null_eras"] == 1


def test_feature_store_and_sinks_refuse_before_they_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 1.0, 0.5), ("b", "2", 2.0, 0.5)], "id string, era string, f double, target double")
    other = df.select("id", "era", F.lit(1.0).alias("bm"))
    assert [r["row_offset"] for r in panel.feature_store(df, other, ["f"], "target", "bm").orderBy("id").collect()] == [0, 1]
    for a, b in ((df.unionByName(df), other), (df, other.withColumn("era", F.lit("7"))), (df.withColumn("f", F.lit(NAN)), other), (df.limit(0), other)):
        with pytest.raises(contracts.ContractError):
            panel.feature_store(a, b, ["f"], "target", "bm")
    with pytest.raises(contracts.ContractError):
        panel.write_filtered(df.limit(0), f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()

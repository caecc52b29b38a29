"""Jobs on made tables that tell a query from its SQL, and groups larger than a window is to hold."""

import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from erascope.functions.ranking import average_rank, count_in, first_rank
from erascope.operators import ensemble as EN
from erascope.operators import large
from erascope.operators import scores as S
from erascope.operators import splits as SP
from erascope.plans import registry
from erascope.plans.q_decide import TargetMean


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Orders whose prediction and feature_a score alike on the calibration eras and fall by unlike amounts."""
    custkey = lambda a, b: next(k for k in range(35) if k % 5 == a and k % 7 == b)
    rows = []
    for era in [1, 2, 3, 4, 60]:
        up, rising = era in (1, 3, 60), era in (1, 2, 60)
        for i in range(5):
            rows.append((5 * (era * 10 + i), custkey(i, i if rising else 4 - i), datetime.date(1995 + (era - 1) // 12, (era - 1) % 12 + 1, 5), float(i if up else 4 - i)))
    folder = tmp_path_factory.mktemp("tied")
    pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]).to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": range(35), "c_acctbal": 1.0}).to_parquet(folder / "customer.parquet")
    return folder


def test_near_candidates_go_by_name_as_the_sql_has_it(spark, tied):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{tied}/{t}.parquet'")
    want = con.execute(registry.ORACLES["gat6_evaluation_job"]).fetchall()
    assert want == [("feature_a", True)]
    assert [tuple(r) for r in registry.QUERIES["gat6_evaluation_job"](spark, str(tied)).collect()] == want


def panel(spark, rows=600, eras=6):
    return spark.range(rows).selectExpr("cast(id as string) id", f"lpad(cast(id % {eras} + 1 as string), 4, '0') era", "cast(id % 11 as double) x", "cast(id * id % 97 as double) y")


def test_an_estimator_of_parts_is_fitted_on_all_rows(spark):
    df = panel(spark).repartition(3)
    sp = SP.cv_splits(df, 3, 0, strict=False)
    got = SP.out_of_fold(df, sp, ["x"], "y", estimator=TargetMean(), cap=10).groupBy("cv_fold").agg(F.min("prediction").alias("a"), F.max("prediction").alias("b")).collect()
    want = {r["fold"]: r["m"] for r in df.join(sp.filter("role = 'train'"), "era").groupBy("fold").agg(F.avg("y").alias("m")).collect()}
    assert len(got) == len(want) and all(abs(r[c] - want[r["cv_fold"]]) < 1e-9 for r in got for c in "ab")


def test_folds_of_pyspark_ml_make_their_rows_once(spark):
    from pyspark.ml.regression import LinearRegression

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    df = panel(spark).withColumn("y", counted("y"))
    SP.ml_out_of_fold(df, SP.cv_splits(panel(spark), 3, 0, strict=False), ["x"], "y", LinearRegression(solver="normal")).collect()
    assert made.value == 600


@pytest.fixture
def ranges(monkeypatch):
    monkeypatch.setattr(large, "ROWS", 50)
    monkeypatch.setattr(large, "TASK_ROWS", 100)
    monkeypatch.setattr(large, "PART", 1)


def crowded(spark):
    """Eras of 0 to 400 rows; columns of many, few and one value, far outliers, values close to each other, and missing ones."""
    return spark.range(1500).selectExpr(
        "cast(id as string) id", "case when id < 30 then '0009' else lpad(cast(pow(id % 37, 2) % 4 as int), 4, '0') end era", "case when id % 13 <> 5 then cast(pow(-1, id) * exp((id * 7919 % 1000) / 20.0) as double) end a",
        "cast(id % 5 as double) b", "1e6 + (id * 31 % 701) * 1e-9 c", "case when id % 3 = 0 then double('nan') when id = 99 then double('infinity') when id = 700 then 1e308 else cast(-id as double) end d", "1.0d e", "cast(id * 17 % 5 as double) / 4 target",
    ).repartition(3)


def test_ranks_by_ranges_equal_those_of_windows(spark, ranges):
    df = crowded(spark)
    groups = large.Groups(df, list("abcde"), ["era"])
    assert groups.ranges is not None
    for x in "abcde":
        one = groups.ranked(groups.ranked(df, "r_", "n_", x), "place_", "m_", x, "id")
        bad = one.withColumn("w_", average_rank(x, "era")).withColumn("c_", count_in(x, "era")).withColumn("f_", first_rank(x, "id", "era"))
        assert bad.filter(f"not (r_ <=> w_) or not (place_ / m_ <=> f_) or ({x} is not null and n_ <> c_)").count() == 0, x
        assert bad.count() == 1500


def test_a_window_holds_a_range_alone(spark, ranges):
    df = crowded(spark).withColumn("v", F.rand(3))
    groups = large.Groups(df, ["v"], ["era"])
    tasks = groups.ranked(df, "r_", "n_", "v").groupBy("era", F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert tasks < 120 < df.groupBy("era").count().agg(F.max("count")).first()[0]


def same_rows(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("name", ["blends", "seeds", "mean", "target", "corr", "contribution", "era_scores"])
def test_blends_and_scores_of_large_eras(spark, monkeypatch, name):
    df = crowded(spark).select("id", "era", "a", "b", "c", "target")
    long = S.long_signals(df.withColumn("ref", (F.col("c") - 1e6) * 1e9), ["a", "b", "c"], ["id", "era", "target", "ref"])
    run = {
        "blends": lambda: EN.two_signal_blends(df, "a", "b", [0.35, 0.75]),
        "seeds": lambda: EN.seed_ensemble(df, ["a", "c"], "b"),
        "mean": lambda: EN.mean_of_ranks(df, ["a", "b", "c"]),
        "target": lambda: EN.target_ensemble(df, ["a", "b", "c"]),
        "corr": lambda: S.powered_correlation(long, "target"),
        "contribution": lambda: S.contribution(long, "target", "ref"),
        "era_scores": lambda: S.era_scores(long, "target", "ref"),
    }[name]
    want = run()
    monkeypatch.setattr(large, "ROWS", 50)
    monkeypatch.setattr(large, "PART", 1)
    same_rows(run(), want, ["era", "id" if "id" in want.columns else "signal"])

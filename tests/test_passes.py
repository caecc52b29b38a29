"""How often jobs make the rows that they score, and the proof of a cohort without sorts."""

import pytest
from pyspark.sql import functions as F

from erascope.operators.contracts import same_cohort
from erascope.plans.jobs import evaluation_job, replication_job


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(x):
        made.add(1)
        return x

    return made, count


def panel(spark):
    return spark.range(240).selectExpr("cast(id as string) id", "lpad(cast(id % 8 + 1 as string), 4, '0') era", "cast(id * 37 % 101 as double) a", "cast(id * 53 % 97 as double) b", "cast(id % 5 as double) / 4 target", "cast(id * 11 % 89 as double) benchmark")


def specs(spark):
    return spark.createDataFrame([("corr", "corr", ">", -1.0, None)], "check string, metric string, op string, threshold double, upper double")


def test_replicas_are_made_once(spark, counted):
    made, count = counted
    df = panel(spark)
    runs = {n: df.select("id", "era", count(c).alias("prediction")) for n, c in (("one", "a"), ("two", "b"))}
    out = replication_job(runs, df, "benchmark", "target", "benchmark", specs(spark)).collect()
    assert len(out) == 3 and made.value == 2 * 2 * 240  # as rows of their own and of the ensemble


def test_blends_are_made_once_and_the_holdout_scores_the_selected_alone(spark, counted):
    made, count = counted
    df = panel(spark).withColumn("b", count("b"))
    job = lambda **more: evaluation_job(df, ["a", "b"], "target", "benchmark", {"c": (1, 4), "h": (5, 8)}, specs(spark), "c", "h", tie=0.0, **more).collect()
    plain = job()
    made.value = 0
    out = job(blends=("a", "b", [0.35, 0.75]))
    assert len(plain) == len(out) == 1 and made.value <= 240


def test_a_cohort_of_equal_rows_is_proven_without_its_values(spark):
    df = panel(spark).withColumn("target", F.when(F.col("id") != "7", F.col("target")))
    runs = {f"r{i}": df for i in range(3)}
    assert not any(same_cohort({"x": df, "y": df.repartition(3)}, df, also=["target"]).values())
    assert not any(same_cohort(runs, df, also=["target"]).values())
    lost = same_cohort(runs | {"r2": df.filter("id <> '3'"), "r1": df.unionByName(df.filter("id = '4'"))}, df)
    assert {k: v for k, v in lost.items() if v} == {"missing_keys": 1, "duplicate_keys": 1}
    unlike = same_cohort({"x": df.withColumn("target", F.coalesce("target", F.lit(0.0)))}, df.withColumn("era", F.when(F.col("id") != "9", F.col("era"))), also=["target"])
    assert {k: v for k, v in unlike.items() if v} == {"era_mismatches": 1, "differs_target": 1}

"""The wide cohort, whose features are made in the tasks that count them."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from erascope.operators import discrete as D
from erascope.operators import summary as SU
from erascope.plans import registry
from erascope.plans.cohorts import WIDE, WIDE_FEATURES, WIDE_MADE, wide, wide_rows

QUERIES = ["sco9_discrete_exposures", "sco10_discrete_features", "sum3_feature_leaderboard"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Line items with missing keys."""
    rows = pd.read_parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows["l_partkey"] = rows["l_partkey"].astype("Int64").where(rows.index % 7 != 3)
    rows["l_linenumber"] = rows["l_linenumber"].astype("Int32").where(rows.index % 11 != 4)
    rows.to_parquet((folder := tmp_path_factory.mktemp("odd")) / "lineitem.parquet")
    return folder


def in_sql(folder, sql):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    return con.execute(sql).df()


def plain(df):
    return sorted(str([None if v is None or v != v else float(v) if isinstance(v, (int, float)) else v for v in r]) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_missing_keys(spark, odd, name):
    assert plain(registry.QUERIES[name](spark, str(odd)).toPandas()) == plain(in_sql(odd, registry.ORACLES[name]))


def test_wide_columns_of_missing_and_negative_keys(spark, odd, tmp_path):
    rows = pd.read_parquet(odd / "lineitem.parquet")
    rows["l_suppkey"] = rows["l_suppkey"].where(rows.index % 5 != 1, -rows["l_suppkey"])
    rows.to_parquet((odd := tmp_path) / "lineitem.parquet")
    columns = ["id", "era", "prediction", "target", *WIDE_FEATURES]
    assert plain(wide(spark, str(odd)).toPandas()) == plain(in_sql(odd, f"WITH {WIDE} SELECT {', '.join(columns)} FROM wide_c"))


@pytest.mark.parametrize("name", QUERIES)
def test_no_projection_of_many_expressions(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 16 and "f63" not in plan


def test_made_features_equal_columns(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = D.discrete_scores(wide(spark, sf), WIDE_FEATURES, "target").toPandas()
    monkeypatch.setattr(D, "HELD", 8 * 64 * 25 * 3)  # a few groups at a time
    got = D.discrete_scores(wide_rows(spark, sf), WIDE_MADE, "target").toPandas()
    assert plain(got) == plain(want) and len(got) > 64


def test_halves_and_summary_in_one_pass(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    SU.half_delta(spark.range(20).select(F.lit("a").alias("signal"), F.lpad(F.col("id").cast("string"), 4, "0").alias("era"), counted(F.col("id") % 3 + 0.5).alias("v")), "v", ["signal"]).collect()
    assert made.value == 20

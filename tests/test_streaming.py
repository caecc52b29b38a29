"""Drops with parts of eras, keys that come again, and a holdout that opens."""

import pytest
from pyspark.sql import functions as F

from erascope.operators.ranks import transform_in_groups
from erascope.sources import panel as P
from erascope.streaming import live as LV

SCHEMA = "id string, era string, v double"


def rank(rows):
    return transform_in_groups(rows, {"r": ("percent", "v")}, ["era"]).select("id", "era", "r")


def drop(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def ranks(spark, out):
    return {(r.id, r.era): round(r.r, 9) for r in spark.read.schema("id string, r double, era string").parquet(f"{out}/ranked").collect()}


def test_parts_of_eras_rank_as_whole_ones(spark, tmp_path):
    drops, out, mark = (f"file://{tmp_path}/{n}" for n in ("drops", "out", "mark"))
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    go = lambda: LV.rank_drops(spark, drops, schema, lambda b: b.withColumn("v", F.col("v") * 2), rank, out, mark)
    drop(spark, drops, [("a", "0007", 1.0), ("b", "0007", 2.0), ("x", "0008", 5.0)])
    go()
    before = ranks(spark, out)
    assert before == {("a", "0007"): 0.5, ("b", "0007"): 1.0, ("x", "0008"): 1.0}
    drop(spark, drops, [("c", "0007", 0.5), ("d", "0007", 2.0), ("z", None, 1.0)])
    drop(spark, drops, [("a", "0007", 9.0)])  # comes again: the last one counts
    go()
    got = ranks(spark, out)
    assert got == {("a", "0007"): 1.0, ("b", "0007"): 0.625, ("c", "0007"): 0.25, ("d", "0007"): 0.625, ("x", "0008"): 1.0, ("z", None): 1.0}
    go()
    assert ranks(spark, out) == got


def test_a_retry_after_a_break_ends_in_the_same_tables(spark, tmp_path):
    from pyspark.sql.types import StructType

    drops, out, mark = (f"file://{tmp_path}/{n}" for n in ("drops", "out", "mark"))
    drop(spark, drops, [("a", "0001", 1.0), ("b", "0001", 2.0)])
    broken = {"yes": True}

    def failing(rows):
        if broken["yes"]:  # the raw rows are there by now, the ranks are not
            raise RuntimeError("lost")
        return rank(rows)

    go = lambda: LV.rank_drops(spark, drops, StructType.fromDDL(SCHEMA), lambda b: b, failing, out, mark)
    with pytest.raises(Exception, match="lost"):
        go()
    broken["yes"] = False
    go()
    assert ranks(spark, out) == {("a", "0001"): 0.5, ("b", "0001"): 1.0}
    assert spark.read.parquet(f"{out}/raw").count() == 2


def test_holdout_opens_with_its_thirteenth_resolved_era(spark, tmp_path):
    from pyspark.sql.types import StructType

    drops, out, mark = (f"file://{tmp_path}/{n}" for n in ("drops", "out", "mark"))
    zones = [("development", 1, 9), ("holdout", 10, 99)]

    def state():
        counts = LV.count_drops(spark, drops, StructType.fromDDL(SCHEMA), "v", out, mark)
        return counts, {r.zone: (r.eras, r.rows, r.resolved_eras, r.open) for r in P.zone_states(counts, zones, {"holdout": 13}).collect()}

    drop(spark, drops, [(f"{e}{k}", f"{e:04d}", None if e >= 21 else 0.5) for e in range(5, 25) for k in "ab"])
    assert state()[1] == {"development": (5, 10, 5, True), "holdout": (15, 30, 11, False)}
    drop(spark, drops, [("21a", "0021", 0.25), ("22a", "0022", 0.25), ("22b", "0022", 0.5), ("23a", "0023", float("nan"))])
    assert state()[1]["holdout"] == (15, 30, 12, False)  # 21 is resolved in part
    drop(spark, drops, [("21b", "0021", 0.25)])
    counts, now = state()
    assert now["holdout"] == (15, 30, 13, True)
    assert {r.era: (r.rows, r.resolved) for r in counts.collect()}["0023"] == (2, 0)


def test_frontier_by_number(spark):
    df = spark.createDataFrame([("999", 1.0), ("1000", 1.0), ("1001", None)], "era string, t double")
    assert {r.frontier for r in P.resolution(df, "t").collect()} == {"1000"}
    none = spark.createDataFrame([("1", None)], "era string, t double")
    assert P.resolution(none, "t").first().frontier is None

"""Stores by era and date: what scans skip, and what is left after a broken contract."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from erascope.operators.contracts import ContractError
from erascope.sources import layout as L
from erascope.sources import panel as P


@pytest.fixture(scope="module")
def df(spark):
    rows = spark.range(12_000).select(F.format_string("%05d", "id").alias("id"), F.format_string("%04d", (F.col("id") * 7) % 120).alias("era"), (F.col("id") % 5).cast("double").alias("f"), F.rand(1).alias("target"))
    return rows.unionByName(spark.createDataFrame([("a", "X1", 1.0, 0.5), ("b", None, 1.0, 0.5)], "id string, era string, f double, target double"))


def executed(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.finalPhysicalPlan() if plan.getClass().getSimpleName().startswith("Adaptive") else plan


def scan_rows(df):
    """Rows that the scan has handed on, after it skipped files and row groups."""
    df.collect()
    text, node = executed(df), None
    todo = [text]
    while todo:
        n = todo.pop()
        if "FileSourceScan" in n.getClass().getSimpleName():
            node = n
        children = n.children()
        todo += [children.apply(i) for i in range(children.size())]
    return node.metrics().apply("numOutputRows").value()


def test_buckets_prune_by_partition(spark, df, tmp_path):
    path = f"file://{tmp_path}/store"
    index = L.write_era_buckets(df, path, width=10)
    assert index.count() == 122 and index.filter("era = '0003'").first()["bucket"] == 0 and index.filter("era = 'X1'").first()["bucket"] == -1
    some = L.read_era_buckets(spark, path, ["0003", "0057", "X1", "none"])
    plan = executed(some).toString()
    assert "bucket_" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(era" in plan
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in df.filter("era in ('0003', '0057', 'X1')").collect())
    assert scan_rows(some) <= 12_000 * 21 / 120 + 2
    early = L.read_era_buckets(spark, path, last=4)
    assert early.count() == 500 and scan_rows(early) <= 1000
    assert L.read_era_buckets(spark, path, []).count() == 0
    assert L.read_era_buckets(spark, path).count() == df.count()


def test_offsets_with_and_without_stored_numbers(spark, df, tmp_path):
    rows = df.filter("id rlike '^[0-9]'")
    want = {r.id: i for i, r in enumerate(rows.orderBy("era", "id").collect())}
    for numbered in (True, False):
        path = f"file://{tmp_path}/n{numbered}"
        L.write_era_buckets(rows, path, numbered=numbered)
        assert {r.id: r.row_offset for r in L.with_offsets(spark, path).collect()} == want


def test_broken_contracts_leave_nothing(spark, df, tmp_path):
    path = f"file://{tmp_path}/bad"
    with pytest.raises(ContractError, match="wrong"):
        L.write_era_buckets(df, path, counts={"wrong": F.count_if(F.col("f") > 3)})
    with pytest.raises(ContractError, match="empty"):
        L.write_era_buckets(df.limit(0), path)
    assert not os.path.exists(f"{tmp_path}/bad")


def test_row_groups_are_skipped(spark, df, tmp_path):
    path = f"file://{tmp_path}/by-era"
    stored = L.write_by_era(df, path, rows_per_group=500)
    groups = sum(pq.ParquetFile(f"{tmp_path}/by-era/{f}").num_row_groups for f in os.listdir(f"{tmp_path}/by-era") if f.endswith(".parquet"))
    assert groups >= 12_000 / 500
    some = P.up_to_era(stored, 11, width=4)
    assert "LessThanOrEqual(era,0011)" in executed(some).toString()
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in df.filter("era <= '0011'").collect())
    assert scan_rows(some) < 12_000 / 3


def test_dates_prune_the_matrix(spark, df, tmp_path):
    rows = df.filter("era is not null").withColumnRenamed("era", "date")
    matrix = L.write_matrix(rows.select("id", "date", (F.col("f") * 2).alias("n1")), f"file://{tmp_path}/matrix")
    got = L.join_by_date(rows.filter("id < '00003'"), matrix, ["id", "date"])
    assert "dynamicpruning" in executed(got).toString()
    assert sorted((r.id, r.f * 2 == r.n1) for r in got.collect()) == [("00000", True), ("00001", True), ("00002", True)]


def test_write_filtered_runs_once_and_publishes_last(spark, df, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = P.write_filtered(df.mapInArrow(touched, df.schema), f"file://{tmp_path}/out/rows")
    assert seen.value == df.count() == out.count()
    with pytest.raises(ContractError, match="nothing"):
        P.write_filtered(df.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(ContractError, match="already"):
        P.write_filtered(df, f"file://{tmp_path}/out/rows")
    assert sorted(os.listdir(tmp_path)) == ["out"] and os.listdir(f"{tmp_path}/out") == ["rows"]

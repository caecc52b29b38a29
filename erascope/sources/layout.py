"""Tables laid out for the questions that are asked of them: by era, so that scans skip files and row groups, and by date.

A store has its rows below path/rows, in one folder for each bucket of eras, clustered and sorted by era inside; and one row an
era below path/index: the bucket, the rows, and where the era starts in the order of the whole table. The index is written
last: what has none was not finished or broke its contract, and is not there for readers.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.contracts import ContractError, refuse
from ..operators.summary import era_number

#: Eras of a bucket: about a year of weeks.
WIDTH = 52
ROWS_PER_GROUP = 100_000


def bucket_of(era: str = "era", width: int = WIDTH) -> Column:
    """The bucket of an era that is a number; -1 for others."""
    return F.coalesce(F.floor(F.expr(f"try_cast(`{era}` as bigint)") / width), F.lit(-1)).cast("int")


def observed(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """(df, a function that gives some aggregates of its rows once a job has run over it). A task that is run again can raise a
    count, never hide one. Of a plan that turns out to have no rows Spark may observe nothing: all counts are then 0."""
    seen = Observation()

    def got() -> dict[str, int]:
        try:
            said = seen.get
        except Py4JJavaError:  # no metrics: the plan was known to be empty before it ran
            said = {}
        return {n: said.get(n) or 0 for n in counts}

    return df.observe(seen, *[x.alias(n) for n, x in counts.items()]), got


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a written folder to its final name, which must be free."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    store = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(Path(path)):
        raise ContractError(f"{path} is there already")
    store.mkdirs(Path(path).getParent())
    if not store.rename(Path(staged), Path(path)):
        raise OSError(f"cannot rename {staged} to {path}")


def clustered(df: DataFrame, key: str = "id", era: str = "era") -> DataFrame:
    """df dealt by ranges of era and key and sorted by them: a file holds few eras, and a large era several files."""
    return df.repartitionByRange(era, key).sortWithinPartitions(era, key)


def write_era_buckets(df: DataFrame, path: str, key: str = "id", era: str = "era", width: int = WIDTH, counts: dict[str, Column] | None = None, drop: list[str] | None = None, numbered: bool = False, what: str = "store") -> DataFrame:
    """Write a store and return its index. counts are violations of a contract, taken on the way of the rows (whose columns drop
    go afterwards): if any is not zero, or there are no rows, the rows are removed, no index is written and an error is raised.

    Rows are dealt by bucket and sorted by era; a large bucket is split by AQE. With numbered, they are dealt by era and hold
    their number in it, as row_in_era, so an era is one task's.
    """
    spark, rows = df.sparkSession, f"{path}/rows"
    df, got = observed(df, {"rows_": F.count("*")} | (counts or {}))
    df = df.drop(*(drop or [])).withColumn("bucket_", bucket_of(era, width))
    if numbered:
        df = df.withColumn("row_in_era", F.row_number().over(W.partitionBy("bucket_", era).orderBy(key)) - 1)
    else:
        df = df.hint("rebalance", "bucket_").sortWithinPartitions("bucket_", era, key)
    df.write.partitionBy("bucket_").parquet(rows)
    seen = got()
    bad = {n: seen[n] for n in counts or {}} | {"empty": int(not seen["rows_"])}
    if any(bad.values()):
        delete_folder(spark, path)
        refuse(bad, what)
    per = spark.read.parquet(rows).groupBy(F.col("bucket_").alias("bucket"), era).agg(F.count("*").alias("rows"))  # reads the eras alone
    starts = F.coalesce(F.sum("rows").over(W.orderBy(era_number(era)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per.withColumn("start", starts).coalesce(1).write.parquet(f"{path}/index")  # one row an era
    return era_index_of(spark, path)


def era_index_of(spark: SparkSession, path: str) -> DataFrame:
    """Rows (bucket, era, rows, start) of a store, one an era."""
    return spark.read.parquet(f"{path}/index")


def read_era_buckets(spark: SparkSession, path: str, eras: list[str] | None = None, last: int | None = None, era: str = "era") -> DataFrame:
    """The rows of a store, of some eras, or of those up to a number. The index, one row an era, says which buckets hold them:
    other folders are not listed for reading, and the filter on the stored era lets the reader skip row groups."""
    index = era_index_of(spark, path)
    df = spark.read.parquet(f"{path}/rows")
    if eras is None and last is None:
        return df.drop("bucket_")
    want = index.filter(F.col(era).isin(eras)) if eras is not None else index
    want = want if last is None else want.filter(F.expr(f"try_cast(`{era}` as bigint)") <= last)
    found = want.select("bucket", era).collect()  # one row an era
    df = df.filter(F.col("bucket_").isin(sorted({r["bucket"] for r in found})))
    if eras is not None:
        return df.filter(F.col(era).isin(sorted(r[era] for r in found))).drop("bucket_")
    widths = {len(r[era]) for r in found}
    if len(widths) <= 1:  # padded eras are in order as texts: the filter is on the stored column
        return df.filter(F.col(era) <= F.lit(max((r[era] for r in found), default=""))).drop("bucket_")
    return df.filter(F.col(era).isin(sorted(r[era] for r in found))).drop("bucket_")


def with_offsets(spark: SparkSession, path: str, key: str = "id", era: str = "era", name: str = "row_offset") -> DataFrame:
    """The rows of a store with their place in the order of era and key: where the era starts, and the number inside it, which
    is stored or else found by a sort of each era."""
    index = F.broadcast(era_index_of(spark, path).select(era, "start"))  # one row an era
    rows = read_era_buckets(spark, path)
    if "row_in_era" not in rows.columns:
        rows = rows.withColumn("row_in_era", F.row_number().over(W.partitionBy(era).orderBy(key)) - 1)
    return rows.join(index, era).withColumn(name, F.col("start") + F.col("row_in_era")).drop("row_in_era", "start")


def write_by_era(df: DataFrame, path: str, key: str = "id", era: str = "era", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """df as Parquet clustered by era, in small row groups whose minimum and maximum let a scan by era skip them."""
    clustered(df, key, era).write.option("parquet.block.row.count.limit", rows_per_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_matrix(df: DataFrame, path: str, date: str = "date") -> DataFrame:
    """A matrix by date as one folder a date, each written by few tasks."""
    df.repartition(date).write.partitionBy(date).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_by_date(rows: DataFrame, matrix: DataFrame, on: list[str], date: str = "date") -> DataFrame:
    """rows with the matrix's values of their keys (on, the date among them). The dates of rows, one row each, go to every task
    first, so that the scan of the matrix reads the folders of those dates alone, whatever filter has left them."""
    dates = F.broadcast(rows.select(date).distinct())  # one row a date
    return rows.join(matrix.join(dates, date, "left_semi"), on)

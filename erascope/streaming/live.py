"""Files as they arrive: scored, ranked by era, and counted, with what has come before.

A drop is never the only place of its rows: what it holds is appended to a raw table, one folder for each era and micro-batch,
which a micro-batch that is tried again replaces by the same rows. Everything else is derived from the raw rows of the eras
that a drop touches, read back by partition, and replaces those eras' partitions alone. So a retry, at whatever point the run
before it broke, ends in the same tables, and an era that comes in many files is ranked as if it had come in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.panel import path_exists


def _stream(spark: SparkSession, drops: str, schema: StructType, each: Callable[[DataFrame, int], None], checkpoint: str, files: int) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(drops)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def score_drops(spark: SparkSession, drops: str, schema: StructType, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Score all files of the drop folder that were not scored before, one file a micro-batch, and append the results as Parquet.
    The checkpoint remembers files, so a repeated call scores only new ones. Each drop stands alone: for eras that come in
    several files see rank_drops()."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is tried again replaces itself

    _stream(spark, drops, schema, each, checkpoint, 1)


def _arrived(batch: DataFrame, number: int, raw: str, era: str) -> list:
    """Append a micro-batch to the raw table; the eras that it has touched, one row an era."""
    spark = batch.sparkSession
    dealt = batch.withColumn("batch_", F.lit(number).cast("bigint")).repartition(era)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(era, "batch_").parquet(raw)
    mine = spark.read.schema(_stored(batch.schema)).parquet(raw).filter(F.col("batch_") == number)  # folders alone are looked at
    return sorted((r[0] for r in mine.select(era).distinct().collect()), key=lambda e: (e is None, e))


def _stored(schema: StructType) -> StructType:
    """A raw table's columns, types and all: a partition of digits is no number unless it was one."""
    return StructType([*schema.fields, StructField("batch_", LongType())])


def current(spark: SparkSession, raw: str, schema: StructType, eras: list | None = None, key: str = "id", era: str = "era") -> DataFrame:
    """The raw rows of some eras (all unless given), of a key that came more than once those of the last micro-batch; repeated
    rows in that one stay repeated."""
    rows = spark.read.schema(_stored(schema)).parquet(raw)
    if eras is not None:
        known = F.col(era).isin([e for e in eras if e is not None])
        rows = rows.filter(known | F.col(era).isNull() if None in eras else known)
    last = F.max("batch_").over(W.partitionBy(era, key))
    return rows.withColumn("last_", last).filter((F.col("batch_") == F.col("last_")) | F.col(key).isNull()).drop("last_", "batch_")


def rank_drops(spark: SparkSession, drops: str, schema: StructType, predict: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id", era: str = "era", files: int = 1) -> None:
    """Take all files of the drop folder that were not taken before, files at most a micro-batch. predict(rows), row by row, gives
    what is stored below out/raw; rank(rows of whole eras) what stands below out/ranked, one folder an era, for all eras that
    have come so far. A drop may hold parts of eras: those that it touches are read back, ranked whole and replaced. Of a key
    that comes again in an era, the last one counts. A drop without rows changes nothing."""
    raw, ranked = f"{out}/raw", f"{out}/ranked"

    def each(batch: DataFrame, number: int) -> None:
        said = predict(batch)
        eras = _arrived(said, number, raw, era)
        if eras:
            whole = rank(current(batch.sparkSession, raw, said.schema, eras, key, era)).repartition(era)
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(era).parquet(ranked)

    _stream(spark, drops, schema, each, checkpoint, files)


def count_drops(spark: SparkSession, drops: str, schema: StructType, target: str, out: str, checkpoint: str, key: str = "id", era: str = "era", files: int = 1) -> DataFrame:
    """The state of resolution after all files that have come: rows (era, rows, resolved), one an era. A drop holds rows whose
    target may still be open, or comes to resolve rows of earlier ones; a key counts once, as it came last. The state is kept
    below out/counts between runs, and only the eras that a drop touches are counted again."""
    raw, counts = f"{out}/raw", f"{out}/counts"

    def each(batch: DataFrame, number: int) -> None:
        few = batch.select(key, era, F.when(~F.isnan(F.col(target).cast("double")), F.col(target)).isNotNull().alias("resolved_"))
        eras = _arrived(few, number, raw, era)
        if eras:
            now = current(batch.sparkSession, raw, few.schema, eras, key, era).groupBy(era).agg(F.count_distinct(key).alias("rows"), F.count_distinct(F.when(F.col("resolved_"), F.col(key))).alias("resolved"))
            now.repartition(era).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(era).parquet(counts)

    _stream(spark, drops, schema, each, checkpoint, files)
    state = StructType([StructField(era, schema[era].dataType), StructField("rows", LongType()), StructField("resolved", LongType())])
    return spark.read.schema(state).parquet(counts).select(era, "rows", "resolved") if path_exists(spark, counts) else spark.createDataFrame([], state)

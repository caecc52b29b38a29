"""What the text operators share: tables, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 512
#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that no task decodes very many texts at once. Spark bounds the bytes of a batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names for checkpoints. Where none is named, a local session has one of its
    own; on a cluster that is an error, since no folder of one machine will do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, written as Parquet in a shared folder and read again: cuts the lineage, and a lost executor loses nothing.

    With by, files are grouped in one folder per value of that column, so that a reader of one value reads only its files.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder_ = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the folders of tables from written(), once nothing that is still to run reads them. Others are left alone."""
    for df in tables:
        folder = getattr(df, "folder_", None)
        if folder:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def per_batch(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function from small batches that yields a dict of columns for each batch of results."""
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _fields(schema)])

    def run(batches):
        for out in fn(small_batches(batches)):
            if out is not None and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((out[n], arrow.field(n).type) for n in arrow.names)], schema=arrow)

    return df.mapInArrow(run, schema)


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(), "tinyint": pa.int8()}[kind]


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(sizes: list[int], most: int = 2_000_000) -> Iterator[slice]:
    """Consecutive ranges of at most so much in all, or of one: long texts of a batch are not worked on together."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def same_remainder(modulus: int, remainder: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo: a fold that any engine can compute again. A null id is in no named fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))

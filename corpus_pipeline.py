"""A training corpus from the documents table: five stages, each one of the text operators, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.llm.common import release, table, written
from erascope.llm.decontaminate import without_contaminated
from erascope.llm.language_id import identified, learn
from erascope.llm.mixing import mix
from erascope.llm.secrets import redact
from erascope.llm.similar import without_copies

#: Languages to keep; None keeps all that the labels name.
LANGUAGES: list[str] | None = None
#: Rows of an Arrow batch at most: texts are long, and the JVM and the worker of each task hold a batch or two.
BATCH_ROWS = 1000


_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, for what a stage returns as well: called alone, it leaves the setting; run() restores it."""
    if not 0 < int(spark.conf.get(_BATCHES)) <= BATCH_ROWS:
        spark.conf.set(_BATCHES, BATCH_ROWS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from all labelled texts of docs: texts without a language (null, or no letter) go, as do those
    clearly of a language outside LANGUAGES; a missing label is filled by a clear decision. See identified()."""
    _small_batches(spark)
    return identified(docs, learn(docs), languages=LANGUAGES)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of documents whose five-word shingles resemble by 0.8 or more, that of the least doc_id stays."""
    _small_batches(spark)
    return without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold ten words of a benchmark text in line go."""
    _small_batches(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: spans found are masked, and n_chars follows where docs have it."""
    _small_batches(spark)
    masked = redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix takes it, whole, numbered by copy; a column copy of docs is
    replaced, as are those that mix() adds."""
    _small_batches(spark)
    mixed = mix(docs).filter(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_copies),
    ("benchmark", drop_leaks),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
]
#: SQL has no SimHash, no output codes and no search for linked secrets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table. Each stage's table is removed when the next one is written.
    The session's settings are left as they were; what is returned sends no texts to Python."""
    docs, batches = table(spark, sf_dir, "documents"), spark.conf.get(_BATCHES)
    try:
        for _, stage in STAGES[:-1]:
            before, docs = docs, written(stage(spark, docs, sf_dir))
            release(before)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(_BATCHES, batches)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

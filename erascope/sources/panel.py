"""Reading, assembling and writing panel tables."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import clean
from ..operators.contracts import ContractError, numbers_only
from ..operators.summary import era_number
from .layout import WIDTH, delete_folder, observed, publish, with_offsets, write_era_buckets
from .store import shared_folder


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of a Parquet table; unknown ones are an error before anything runs."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{path} has no columns {missing}")
    return df.select(*columns)


def in_eras(df: DataFrame, eras: list[str] | DataFrame, era: str = "era", few: int = 200) -> DataFrame:
    """Rows of the eras: pushed to the scan for short lists, a semi join for long ones and tables."""
    if isinstance(eras, list) and len(eras) <= few:
        return df.filter(F.col(era).isin(eras))
    if isinstance(eras, list):
        eras = df.sparkSession.createDataFrame([(e,) for e in eras], [era])
    return df.join(eras.select(era).distinct(), era, "left_semi")


def resolve_column(df: DataFrame, wanted: str, aliases: dict[str, str] | None = None) -> str:
    """The column meant by a name: exact, an alias, the only one that ends in it, or the only one that holds it."""
    wanted = (aliases or {}).get(wanted, wanted)
    if wanted in df.columns:
        return wanted
    for test in (str.endswith, str.__contains__):
        found = [c for c in df.columns if test(c, wanted)]
        if len(found) == 1:
            return found[0]
        if found:
            raise ContractError(f"{wanted!r} may be any of {found}")
    raise ContractError(f"no column for {wanted!r}")


def full_panel(train: DataFrame, validation: DataFrame, kind: str = "data_type") -> DataFrame:
    """Train rows and the validation rows of type validation, without the type."""
    return train.drop(kind).unionByName(validation.filter(F.col(kind) == "validation").drop(kind), allowMissingColumns=True)


def full_benchmark(train: DataFrame, validation: DataFrame, panel_validation: DataFrame, key: str = "id", kind: str = "data_type") -> DataFrame:
    """Train rows and those validation rows whose id is of type validation in the panel."""
    ids = panel_validation.filter(F.col(kind) == "validation").select(key)
    return train.unionByName(validation.join(ids, key, "left_semi"), allowMissingColumns=True)


def surviving(df: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    return df.join(kept.select(key), key, "left_semi")


def write_filtered(df: DataFrame, path: str, level: int = 3) -> DataFrame:
    """The rows, as zstd Parquet; returns the written table. One job writes them beside the target and counts them; they take
    its name afterwards. An empty result is an error, and nothing is left at the target."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    counted, got = observed(df, {"rows": F.count("*")})
    try:
        counted.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(staged)
        if not got()["rows"]:
            raise ContractError(f"nothing to write to {path}")
        publish(spark, staged, path)
    finally:
        delete_folder(spark, staged)
    return spark.read.schema(df.schema).parquet(path)


def feature_store(panel: DataFrame, benchmark: DataFrame, features: list[str], target: str, column: str, key: str = "id", era: str = "era", path: str | None = None, width: int = WIDTH) -> DataFrame:
    """Panel rows that have a benchmark value, with a row_offset by era and key, from a store below path (a new shared folder
    unless given), which layout.read_era_buckets() reads by era. Raises on keys, eras, targets or features that break their
    contract; then nothing is left of the store. The join runs once: its contract is counted while it is written."""
    values, spark = [target, *features], panel.sparkSession
    numbers_only(panel, values)
    path = path or shared_folder(spark, "feature-store")
    joined = panel.join(benchmark.select(key, F.col(era).alias("e_"), column), key).withColumn("again_", F.row_number().over(W.partitionBy(key).orderBy(key)) > 1)
    bad = {"duplicate_rows": F.col("again_"), "era_mismatches": ~F.col(era).eqNullSafe(F.col("e_")), "null_eras": F.col(era).isNull()} | {f"not_finite_{c}": clean(c).isNull() for c in values}
    write_era_buckets(joined, path, key, era, width, {n: F.count_if(x) for n, x in bad.items()}, ["e_", "again_"], numbered=True, what="feature store")
    return with_offsets(spark, path, key, era)


def digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """rows and an order-free content hash by group: sums of the first 32 bits of md5 over the columns' texts; nulls differ from
    empty strings."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.sum(part).alias("content"))


def schema_sha256(df: DataFrame) -> str:
    """Digest of the columns' names and types, in order."""
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields], separators=(",", ":")).encode()).hexdigest()


def order_sha256(names: list[str]) -> str:
    """Digest of some names in their order."""
    return hashlib.sha256(json.dumps(list(names), separators=(",", ":")).encode()).hexdigest()


def fingerprint(df: DataFrame, features: list[str], columns: list[str], era: str = "era") -> DataFrame:
    """One row that says whether a table can be used again: rows, content (digest() over the columns), and digests of the
    schema, of the features in order and of the kept eras."""
    eras = df.select(F.col(era).cast("string").alias("e")).distinct().agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("e"))), 256).alias("eras_sha256"))  # one short text an era
    both = digest(df, columns).crossJoin(F.broadcast(eras))  # one row
    return both.withColumns({"schema_sha256": F.lit(schema_sha256(df)), "features_sha256": F.lit(order_sha256(features))})


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_panel(spark: SparkSession, full: str, train: str, validation: str, columns: list[str] | None = None) -> DataFrame:
    """The full table where there is one, else train and validation by name; columns that one of them lacks are null."""
    read = lambda path: spark.read.parquet(path)
    out = read(full) if path_exists(spark, full) else read(train).unionByName(read(validation), allowMissingColumns=True)
    if columns is None:
        return out
    missing = [c for c in columns if c not in out.columns]
    if missing:
        raise ContractError(f"no columns {missing}")
    return out.select(*columns)


def up_to_era(df: DataFrame, last: int, era: str = "era", width: int | None = None) -> DataFrame:
    """The rows of the eras up to a number. Where all eras are digits padded to one width (operators.contracts.era_contract),
    give it: the filter is then on the stored column, by which a reader skips row groups of a table from write_by_era()."""
    if width is not None:
        return df.filter(F.col(era) <= F.lit(str(last).zfill(width)))
    return df.filter(F.expr(f"try_cast(`{era}` as bigint)") <= last)


def feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """Rows (feature_set, feature) of a metadata JSON file {"feature_sets": {name: [feature, ...]}}."""
    sets = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<feature_sets:map<string,array<string>>>").alias("j"))
    return sets.select(F.explode("j.feature_sets").alias("feature_set", "l_")).select("feature_set", F.explode("l_").alias("feature"))


def set_overlaps(sets: DataFrame) -> DataFrame:
    """Rows (a, b, size): how many features two sets share."""
    a, b = sets.select(F.col("feature_set").alias("a"), "feature"), sets.select(F.col("feature_set").alias("b"), "feature")
    return a.join(b, "feature").groupBy("a", "b").agg(F.count("*").alias("size"))


# The field names of results records.
RESULTS = "model string, metrics struct<corr:struct<mean:double,std:double,sharpe:double,max_drawdown:double>,bmc:struct<mean:double>,bmc_last_200_eras:struct<mean:double>>"


def results(spark: SparkSession, path: str) -> DataFrame:
    """Results records with missing sections as nulls; bmc falls back from the last 200 eras to all."""
    return spark.read.schema(RESULTS).json(path).select("model", F.col("metrics.corr.mean").alias("corr_mean"), F.col("metrics.corr.sharpe").alias("corr_sharpe"), F.coalesce(F.col("metrics.bmc_last_200_eras.mean"), F.col("metrics.bmc.mean")).alias("bmc_mean"))


def write_predictions(df: DataFrame, path: str, target: str, semantics: dict, key: str = "id", era: str = "era") -> DataFrame:
    """The fixed columns of out-of-fold predictions, with what the prediction means as column metadata."""
    out = df.select(key, era, target, F.col("prediction").alias("prediction", metadata={"semantics": json.dumps(semantics, sort_keys=True)}), "cv_fold")
    out.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_long_scores(scores: DataFrame, path: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Scores as CSV rows (keys..., metric, value)."""
    long = scores.unpivot(keys, metrics, "metric", "value")
    long.write.option("header", True).csv(path)
    return df_csv(scores.sparkSession, path, long.schema)


def df_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def exchange_code(ticker, codes: dict[str, str], keep_unknown: bool = True):
    """'SYM EXCH' to 'SYM ISO': null for null and for a single token; an unknown exchange gives 'SYM None', or null."""
    parts = F.split(ticker, " ")
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    code = F.element_at(known, F.element_at(parts, -1))
    if keep_unknown:
        code = F.coalesce(code, F.lit("None"))
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", parts[0], code) if keep_unknown else F.when(code.isNotNull(), F.concat_ws(" ", parts[0], code)))


def missing_when_all(df: DataFrame, features: list[str], filler: float = 2, era: str = "era") -> DataFrame:
    """A feature becomes null in the eras where every value is the filler."""
    flags = df.groupBy(era).agg(*[F.bool_and(F.col(f) == filler).alias(f"all_{f}") for f in features])
    joined = df.join(F.broadcast(flags), era)  # one row an era
    return joined.select(*[F.when(~F.coalesce(F.col(f"all_{c}"), F.lit(False)), F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns])


def select_groups(df: DataFrame, groups: list[str], members: dict[str, list[str]]) -> DataFrame:
    """The columns of some groups, in order and once each; an unknown group is an error."""
    unknown = [g for g in groups if g not in members]
    if unknown:
        raise ContractError(f"no such groups: {unknown}")
    return df.select(*dict.fromkeys(c for g in groups for c in members[g]))


def resolution(df: DataFrame, target: str, era: str = "era") -> DataFrame:
    """Per era: rows, resolved rows, status; and the last resolved era, by number, as frontier. Eras before it may still be open; their
    status says so."""
    per = df.groupBy(era).agg(F.count("*").alias("rows"), F.count(target).alias("resolved"))
    status = F.when(F.col("rows") == F.col("resolved"), "resolved").when(F.col("resolved") == 0, "open").otherwise("partial")
    resolved = F.when(F.col("status") == "resolved", F.col(era))
    return per.withColumn("status", status).withColumn("frontier", F.max_by(resolved, F.when(F.col("status") == "resolved", era_number(era))).over(W.partitionBy()))


def zones(era_value, bounds: list[tuple[str, int, int]]):
    """The name of the range (name, first, last) that holds an era number."""
    out = None
    for name, a, b in bounds:
        out = (F.when if out is None else out.when)(era_value.between(a, b), name)
    return out


def zone_states(counts: DataFrame, bounds: list[tuple[str, int, int]], needed: dict[str, int] | None = None, era: str = "era") -> DataFrame:
    """Per zone (name, first, last era number): eras, rows, resolved_eras (of rows that all have their target) and whether it is
    open. counts has rows (era, rows, resolved), one an era. A zone named in needed opens with so many resolved eras, others at
    once; zones without eras are there, with none."""
    spark, needed = counts.sparkSession, needed or {}
    per = counts.withColumn("zone", zones(F.expr(f"try_cast(`{era}` as bigint)"), bounds)).groupBy("zone").agg(F.count("*").alias("eras"), F.sum("rows").alias("rows"), F.count_if((F.col("rows") > 0) & (F.col("rows") == F.col("resolved"))).alias("resolved_eras"))
    named = spark.createDataFrame([(n, needed.get(n, 0)) for n, _, _ in bounds], "zone string, needed_ bigint")
    out = named.join(per, "zone", "left").fillna(0, ["eras", "rows", "resolved_eras"])
    return out.withColumn("open", F.col("resolved_eras") >= F.col("needed_")).drop("needed_")


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which none of the columns is null or NaN."""
    return df.na.drop(subset=columns)


def from_era(df: DataFrame, first: int, era: str = "era") -> DataFrame:
    """The rows whose era's digits are a number from first on; eras without digits stay."""
    number = F.expr(f"try_cast(regexp_replace(`{era}`, '[^0-9]', '') as bigint)")
    return df.filter(number.isNull() | (number >= first))


def after_training(df: DataFrame, train: DataFrame, embargo: int, era: str = "era") -> DataFrame:
    """The rows of eras more than embargo after the last train era, by number."""
    number = lambda: F.expr(f"try_cast(`{era}` as bigint)")
    last = train.agg(F.max(number()).alias("last_"))
    return df.crossJoin(F.broadcast(last)).filter(number() > F.col("last_") + embargo).drop("last_")  # one row


def by_horizon(names: DataFrame, name: str = "name", horizons: tuple[str, ...] = ("20", "60")) -> DataFrame:
    """Rows (target, h20, h60 ...): names stem_horizon side by side, null where a stem lacks a horizon."""
    pattern = f"^(.*)_({'|'.join(horizons)})$"
    parts = names.select(F.regexp_extract(name, pattern, 1).alias("target"), F.concat(F.lit("h"), F.regexp_extract(name, pattern, 2)).alias("h_"), F.col(name).alias("n_"))
    return parts.groupBy("target").pivot("h_", [f"h{h}" for h in horizons]).agg(F.max("n_"))


def centred(df: DataFrame, columns: list[str], centre: float = 2.0, scale: float = 2.0) -> DataFrame:
    """df with (x - centre) / scale in place of each of the columns."""
    return df.withColumns({c: (F.col(c) - F.lit(float(centre))) / F.lit(float(scale)) for c in columns})

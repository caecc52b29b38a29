"""Key-aligned joins of panels, with what they must prove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import clean
from .contracts import ContractError, enforce, key_contract


def strict_left(left: DataFrame, right: DataFrame, columns: list[str], key: str = "id", era: str = "era", right_era: str | None = "era") -> tuple[DataFrame, DataFrame]:
    """(left with columns of right; one row of violations): every left key matches one right row, of the same era in value and
    type, with finite columns. Right rows without a left one are allowed."""
    if right_era and left.schema[era].dataType != right.schema[right_era].dataType:
        raise ContractError(f"{era} is {left.schema[era].dataType.simpleString()} on the left, {right.schema[right_era].dataType.simpleString()} on the right")
    r = right.select(F.col(key).alias("k_"), *([F.col(right_era).alias("e_")] if right_era else []), *columns)
    joined = left.join(r, F.col(key) == F.col("k_"), "left")
    matched = F.col("k_").isNotNull()
    bad = joined.agg(
        F.count_if(~matched).alias("unmatched"),
        F.count_if(matched & ~F.col(era).eqNullSafe(F.col("e_"))).alias("era_mismatches") if right_era else F.lit(0).alias("era_mismatches"),
        *[F.count_if(matched & clean(c).isNull()).alias(f"not_finite_{c}") for c in columns],
        (F.count("*") - F.count_distinct(key)).alias("duplicate_rows"),
    )
    return joined.drop("k_", "e_"), bad


def joined_by_id(left: DataFrame, right: DataFrame, columns: list[str], key: str = "id", full: bool = True) -> DataFrame:
    """left with columns of right; raises on duplicate keys on the right and, if full, on left keys without a match."""
    enforce(key_contract(right.withColumn("e_", F.lit(1)), key, "e_").select("null_keys", "duplicate_rows"), "right side")
    joined, bad = strict_left(left, right, columns, key, right_era=None)
    if full:
        enforce(bad.select("unmatched"), "left side")
    return joined


def coverage(left: DataFrame, right: DataFrame, key: str = "id", era: str = "era") -> DataFrame:
    """Per era: rows, matched rows and their share; status covered, partial or absent."""
    ids = right.select(F.col(key).alias("k_")).distinct()
    per = left.join(ids, F.col(key) == F.col("k_"), "left").groupBy(era).agg(F.count("*").alias("rows"), F.count("k_").alias("matched"))
    share = F.col("matched") / F.col("rows")
    return per.withColumn("share", share).withColumn("status", F.when(share == 1, "covered").when(share == 0, "absent").otherwise("partial"))


def apply_coverage(df: DataFrame, covered: DataFrame, exclude_absent: bool, era: str = "era") -> DataFrame:
    """df without absent eras; raises on partial ones, and on absent ones unless they are excluded."""
    enforce(covered.agg(F.count_if(F.col("status") == "partial").alias("partial_eras"), F.count_if((F.col("status") == "absent") & ~F.lit(exclude_absent)).alias("absent_eras")), "coverage")
    return df.join(F.broadcast(covered.filter("status = 'absent'").select(era)), era, "left_anti")  # one row an era


def attach(left: DataFrame, right: DataFrame, columns: list[str], required: str | None = None, key: str = "id") -> DataFrame:
    """left with right's columns; with a required one, only rows where it is present (right is filtered first)."""
    r = right.select(key, *columns)
    if required is None:
        return left.join(r, key, "left")
    return left.join(r.filter(clean(required).isNotNull()), key)


def attach_baseline(left: DataFrame, other: DataFrame, prediction: str, name: str, key: str = "id", era: str = "era") -> DataFrame:
    """Another model's predictions as a column; strict."""
    joined, bad = strict_left(left, other.withColumnRenamed(prediction, name), [name], key, era)
    enforce(bad, "baseline")
    return joined


def agreed_inner(a: DataFrame, b: DataFrame, columns: list[str], key: str = "id", era: str = "era") -> tuple[DataFrame, DataFrame]:
    """(inner join by key; one row: rows whose eras differ, and rows beyond one for a key)."""
    joined = a.join(b.select(key, F.col(era).alias("e_"), *columns), key)
    return joined.drop("e_"), joined.agg(F.count_if(~F.col(era).eqNullSafe(F.col("e_"))).alias("era_mismatches"), (F.count("*") - F.count_distinct(key)).alias("duplicate_rows"))


def align_series(series: dict[str, DataFrame], base: str, era: str = "era") -> DataFrame:
    """Outer join of (era, value) series, one column each; the base is 0 where it lacks an era."""
    out = None
    for name, s in series.items():
        s = s.select(era, F.col("value").alias(name))
        out = s if out is None else out.join(s, era, "full_outer")
    return out.withColumn(base, F.coalesce(base, F.lit(0.0)))


def common_keys(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Inner join of all tables on the keys."""
    out, *rest = tables
    for t in rest:
        out = out.join(t, on)
    return out


def reconcile(artifact: DataFrame, manifest: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """One row: keys on one side only, and values of the columns that differ (null-safe)."""
    a = artifact.select(F.col(key).alias("ka_"), *[F.col(c).alias(f"a_{c}") for c in columns])
    m = manifest.select(F.col(key).alias("km_"), *[F.col(c).alias(f"m_{c}") for c in columns])
    both = F.col("ka_").isNotNull() & F.col("km_").isNotNull()
    return a.join(m, F.col("ka_") == F.col("km_"), "full_outer").agg(
        F.count_if(F.col("km_").isNull()).alias("only_artifact"), F.count_if(F.col("ka_").isNull()).alias("only_manifest"), *[F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"m_{c}"))).alias(f"differs_{c}") for c in columns]
    )


def folds_of_eras(df: DataFrame, fold: str = "cv_fold", era: str = "era") -> DataFrame:
    """Eras that lie in more than one fold."""
    return df.groupBy(era).agg(F.count_distinct(fold).alias("folds")).filter("folds > 1")


def common_eras(scores: DataFrame, by: str = "signal", era: str = "era") -> DataFrame:
    """Rows of the eras that every signal has."""
    signals = scores.agg(F.count_distinct(by).alias("all_"))
    full = scores.groupBy(era).agg(F.count_distinct(by).alias("n_")).crossJoin(F.broadcast(signals)).filter("n_ = all_").select(era)  # one row
    return scores.join(full, era, "left_semi")


def joined_by_keys(left: DataFrame, right: DataFrame, columns: list[str], on: tuple[str, ...] = ("id", "era")) -> DataFrame:
    """left with columns of right where all of the keys are equal; other rows of either side go."""
    return left.join(right.select(*on, *columns), list(on))


def kept_and_lost(left: DataFrame, right: DataFrame, on: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of left whose key right has, the other rows of left, null keys among them)."""
    keys = right.select(on)
    return left.join(keys, on, "left_semi"), left.join(keys, on, "left_anti")


def era_sets(first: DataFrame, second: DataFrame, era: str = "era") -> DataFrame:
    """Rows (side, era): the distinct eras of both tables, of the first alone and of the second alone."""
    a, b = first.select(era).distinct(), second.select(era).distinct()
    said = lambda df, side: df.select(F.lit(side).alias("side"), era)
    return said(a.intersect(b), "both").unionByName(said(a.exceptAll(b), "first")).unionByName(said(b.exceptAll(a), "second"))

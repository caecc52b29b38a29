"""Contracts of panel tables: each returns a small table of counts or of offenders; enforce() raises on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import clean


class ContractError(ValueError):
    """A table breaks a contract."""


def enforce(violations: DataFrame, what: str) -> None:
    """Raise if any count in the one row of violations is not zero."""
    row = violations.first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ContractError(f"{what}: {bad}")


def key_contract(df: DataFrame, key: str = "id", era: str = "era") -> DataFrame:
    """One row: null keys, rows beyond the first of a key, null eras, and 1 if the table is empty."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n_"), F.count_if(F.col(era).isNull()).alias("e_"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n_"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n_") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("e_"), F.lit(0)).alias("null_eras"),
        F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"),
    )


def finite_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: values of each column that are null, NaN or infinite. Columns that are no numbers are refused."""
    numbers_only(df, columns)
    return df.agg(*[F.count_if(clean(c).isNull()).alias(c) for c in columns])


def numbers_only(df: DataFrame, columns: list[str]) -> None:
    """Raise on columns that are no numbers."""
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
            raise ContractError(f"{c} is {kind}, not a number")


def era_contract(df: DataFrame, era: str = "era") -> DataFrame:
    """One row over the distinct eras: those not all digits, the number of widths beyond one, and gaps in their numbers."""
    eras = df.select(era).distinct()
    placed = eras.withColumn("n_", F.expr(f"try_cast(`{era}` as bigint)")).withColumn("gap_", F.col("n_") - F.lag("n_").over(W.orderBy("n_")) > 1)
    return placed.agg(F.count_if(~F.coalesce(F.col(era).rlike("^[0-9]+$"), F.lit(False))).alias("not_digits"), (F.greatest(F.count_distinct(F.length(era)), F.lit(1)) - 1).alias("extra_widths"), F.count_if(F.col("gap_")).alias("gaps"))


def allowlist(df: DataFrame, allowed: DataFrame, era: str = "era") -> tuple[DataFrame, DataFrame]:
    """(rows of the allowed eras; rows (era, problem) for allowed eras that are missing and others that are present)."""
    allowed = allowed.select(era).distinct()
    seen = df.select(era).distinct()
    off = allowed.join(seen, era, "left_anti").select(era, F.lit("missing").alias("problem")).unionByName(seen.join(allowed, era, "left_anti").select(era, F.lit("unexpected").alias("problem")))
    return df.join(allowed, era, "left_semi"), off


def forbidden_eras(df: DataFrame, first_forbidden: int, era: str = "era") -> DataFrame:
    """One row: rows at or after the first forbidden era."""
    return df.agg(F.count_if(F.expr(f"try_cast(`{era}` as bigint)") >= first_forbidden).alias("forbidden_rows"))


def same_column(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether two columns agree everywhere, nulls and NaN included, and in how many rows they do not."""
    same = clean(a).eqNullSafe(clean(b))
    return df.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("identical"), F.count_if(~same).alias("differences"))


def id_contracts(panel: DataFrame, right: DataFrame, covering: DataFrame | None = None, key: str = "id", era: str = "era") -> tuple[dict[str, int], list[dict]]:
    """(violations of a panel joined to right by key, coverage of its eras by covering), from one pass over the keys of all tables.

    Violations: null keys, null eras and rows beyond the first of a key in the panel, the same of keys on the right, keys of
    the panel without a right row, and 1 if the panel is empty. Coverage: one dict an era (era, rows, matched). The tables'
    keys meet in one shuffle; what comes back is one row an era.
    """
    side = lambda df, of, name: df.select(F.col(key).alias("k_"), of.alias("e_"), *[F.lit(int(n == name)).alias(n) for n in ("p", "r", "c")])
    none = F.lit(None).cast(panel.schema[era].dataType)
    keys = side(panel, F.col(era), "p").unionByName(side(right, none, "r"))
    if covering is not None:
        keys = keys.unionByName(side(covering, none, "c"))
    per = keys.groupBy("k_").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("c").alias("c"), F.max("e_").alias("e_"), F.count_if((F.col("p") == 1) & F.col("e_").isNull()).alias("null_eras"))
    null, one = F.col("k_").isNull(), lambda n: F.sum(F.when(null, 0).otherwise(F.greatest(F.col(n) - 1, F.lit(0))))
    counts = {
        "null_keys": F.sum(F.when(null, F.col("p") + F.col("r"))),
        "duplicate_rows": one("p"),
        "duplicate_right_rows": one("r"),
        "null_eras": F.sum("null_eras"),
        "unmatched": F.sum(F.when((F.col("p") > 0) & ~null & (F.col("r") == 0), F.col("p"))),
        "rows": F.sum("p"),
        "matched": F.sum(F.when(F.col("c") > 0, F.col("p"))),
    }
    rows = [r.asDict() for r in per.groupBy("e_").agg(*[F.coalesce(x, F.lit(0)).alias(n) for n, x in counts.items()]).collect()]  # one row an era
    bad = {n: sum(r[n] for r in rows) for n in ("null_keys", "duplicate_rows", "duplicate_right_rows", "null_eras", "unmatched")}
    bad["empty"] = int(not sum(r["rows"] for r in rows))
    return bad, [{"era": r["e_"], "rows": r["rows"], "matched": r["matched"]} for r in rows if r["rows"]]


def refuse(violations: dict[str, int], what: str) -> None:
    """Raise if any count is not zero."""
    bad = {k: v for k, v in violations.items() if v}
    if bad:
        raise ContractError(f"{what}: {bad}")


def same_cohort(runs: dict[str, DataFrame], base: DataFrame, key: str = "id", era: str = "era", also: list[str] | None = None) -> dict[str, int]:
    """Violations of the proof that all runs hold the keys and eras of the base, once each: keys that a run lacks, has more
    than once or has besides, and eras that differ; of the columns in also, such as target, fold and benchmark, keys whose
    values differ (null equals null alone). A run without one of them is an error. One shuffle of keys for all runs, and a second
    one of the keys' values where some differ, to say which."""
    also = also or []
    lacking = {n: [c for c in also if c not in df.columns] for n, df in {"base": base, **runs}.items()}
    if any(lacking.values()):
        raise ContractError(f"cohort: columns are missing: {({n: c for n, c in lacking.items() if c})}")
    value = lambda c: F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))
    side = lambda df, name, i: df.select(F.col(key).alias("k_"), F.col(era).alias("e_"), F.lit(name).alias("run_"), F.lit(1 << i % 63).cast("bigint").alias("bit_"), F.lit(i // 63).alias("word_"), *[value(c).alias(f"v{i}_") for i, c in enumerate(also)])
    rows = side(base, "", 0)
    for i, (name, df) in enumerate(runs.items(), 1):
        rows = rows.unionByName(side(df, name, i))
    all_ = len(runs) + 1
    counted = _keys_of_cohort(rows, all_, [f"v{i}_" for i in range(len(also))])
    if not counted.pop("unlike_"):
        return counted | dict.fromkeys(["era_mismatches", *[f"differs_{c}" for c in also]], 0)
    ends = [f(f"v{i}_").alias(f"{n}{i}_") for i in range(len(also)) for n, f in (("lo", F.min), ("hi", F.max))]
    per = rows.groupBy("k_").agg(F.count_if(F.col("run_") == "").alias("b"), F.count("*").alias("n"), F.count_distinct("run_").alias("d"), F.min("e_").alias("lo"), F.max("e_").alias("hi"), F.count("e_").alias("known"), *ends)
    got = per.agg(
        F.count_if(F.col("k_").isNull()).alias("null_keys"),
        F.count_if((F.col("b") > 0) & (F.col("d") < all_)).alias("missing_keys"),
        F.count_if(F.col("b") == 0).alias("unexpected_keys"),
        F.count_if(F.col("n") > F.col("d")).alias("duplicate_keys"),
        F.count_if(~F.col("lo").eqNullSafe(F.col("hi")) | (F.col("known") < F.col("n"))).alias("era_mismatches"),
        *[F.count_if(F.col(f"lo{i}_") != F.col(f"hi{i}_")).alias(f"differs_{c}") for i, c in enumerate(also)],
    )
    return got.first().asDict()


def _keys_of_cohort(rows: DataFrame, tables: int, values: list[str]) -> dict[str, int]:
    """The counts of same_cohort() that need no values, and keys whose era is missing or that have unlike eras or values. Sums of
    numbers by whole rows are hashed, where the least and greatest era and value of a key would be sorted."""
    words = range((tables - 1) // 63 + 1)
    seen = lambda c, w: F.bit_or(F.when(F.col("word_") == w, F.col(c)).otherwise(0).cast("bigint")).alias(f"s{w}_")
    alike = rows.select("k_", "e_", *values, "bit_", "word_").repartition("k_").groupBy("k_", "e_", *values)
    alike = alike.agg(F.count_if((F.col("word_") == 0) & (F.col("bit_") == 1)).alias("b"), F.count("*").alias("n"), *[seen("bit_", w) for w in words])
    per = alike.groupBy("k_").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.count("*").alias("kinds"), F.count("e_").alias("known"), *[F.bit_or(f"s{w}_").alias(f"s{w}_") for w in words])
    per = per.withColumn("d", sum((F.bit_count(f"s{w}_") for w in words), F.lit(0)))
    return per.agg(
        F.count_if(F.col("k_").isNull()).alias("null_keys"),
        F.count_if((F.col("b") > 0) & (F.col("d") < tables)).alias("missing_keys"),
        F.count_if(F.col("b") == 0).alias("unexpected_keys"),
        F.count_if(F.col("n") > F.col("d")).alias("duplicate_keys"),
        F.count_if((F.col("kinds") > 1) | (F.col("known") < F.col("kinds"))).alias("unlike_"),
    ).first().asDict()

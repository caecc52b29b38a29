"""Era splits, samples, weights, and jobs that fit and predict by fold."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import clean, percent_rank
from ..sources.store import kept, shared_folder
from .contracts import ContractError, enforce, key_contract
from .grams import fitted, grams, least_squares, linear
from .models import fit_in_parts, fit_in_tasks, fit_ml_folds, fits_in_parts, fold_samples, predict_by_fold, predict_ml_folds, write_models
from .summary import era_number


def era_index(df: DataFrame, era: str = "era") -> DataFrame:
    """Rows (era, i, n): distinct eras numbered from 0 in time order, and how many there are. One row an era."""
    eras = df.select(era).distinct()
    return eras.select(era, (F.row_number().over(W.orderBy(era_number(era))) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))


def every_nth_era(df: DataFrame, step: int, offset: int = 0, era: str = "era") -> DataFrame:
    """Rows of the eras whose place in time order leaves offset modulo step."""
    if step < 2 or not 0 <= offset < step:
        raise ValueError("step is 2 or more, offset from 0 to below step")
    kept = era_index(df, era).filter(F.col("i") % step == offset).select(era)
    return df.join(F.broadcast(kept), era, "left_semi")  # one row an era


def cv_splits(df: DataFrame, folds: int, embargo: int = 0, mode: str = "expanding", min_train: int = 1, max_train: int | None = None, era: str = "era", strict: bool = True) -> DataFrame:
    """Rows (fold, era, role): era cross-validation. Raises on more folds than eras and, if strict, on a fold with too few
    train eras.

    Eras are cut in equal parts, one a fold, the rest going to the last; fold k validates on part k. expanding: it trains on
    the eras before, less embargo eras at their end. blocked: on all others, less embargo eras on either side. If not
    strict, folds with fewer than min_train train eras are left out; max_train keeps the last train eras alone.
    """
    if folds < 1 or embargo < 0:
        raise ValueError("folds are 1 or more, an embargo is 0 or more")
    if mode not in ("expanding", "blocked"):
        raise ValueError(f"no such mode: {mode!r}")
    eras = era_index(df, era)
    n = eras.count()
    if folds > n > 0:
        raise ContractError(f"{folds} folds of {n} eras")
    if strict:
        size = n // folds
        starts = [(k * size, n if k == folds - 1 else (k + 1) * size) for k in range(folds)]
        train = [max(0, a - embargo) + (max(0, n - z - embargo) if mode == "blocked" else 0) for a, z in starts]
        if n and min(train) < min_train:
            raise ContractError(f"folds have {train} train eras, fewer than {min_train}")
    size = F.floor(F.col("n") / folds)
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    placed = eras.select(era, "i", "n", size.alias("z_"), fold.alias("fold"))
    start = F.col("z_") * F.col("fold")
    end = F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(start + F.col("z_"))
    before = F.col("i") < start - embargo
    train = before if mode == "expanding" else before | (F.col("i") >= end + embargo)
    role = F.when((F.col("i") >= start) & (F.col("i") < end), "validation").when(train, "train")
    out = placed.withColumn("role", role).filter(F.col("role").isNotNull())
    w = W.partitionBy("fold", "role")
    out = out.withColumn("c_", F.sum(F.when(F.col("role") == "train", 1).otherwise(0)).over(W.partitionBy("fold"))).filter(F.col("c_") >= min_train)
    if max_train is not None:
        out = out.withColumn("r_", F.row_number().over(w.orderBy(F.col("i").desc()))).filter((F.col("role") != "train") | (F.col("r_") <= max_train))
    return out.select("fold", era, "role")


def fold_geometry(df: DataFrame, splits: DataFrame, cap: int | None = None, era: str = "era") -> DataFrame:
    """Per fold and role: eras, rows, rows up to a cap, first and last era."""
    per_era = df.groupBy(era).agg(F.count("*").alias("r_"))
    rows = F.sum("r_")
    return splits.join(F.broadcast(per_era), era).groupBy("fold", "role").agg(F.count("*").alias("eras"), rows.alias("rows"), (rows if cap is None else F.least(rows, F.lit(cap))).alias("capped_rows"), F.min_by(era, era_number(era)).alias("first_era"), F.max_by(era, era_number(era)).alias("last_era"))  # one row an era


def walk_forward(df: DataFrame, blocks: list[tuple[str, int, int]], embargo: int = 8, min_history: int = 1, era: str = "era") -> DataFrame:
    """Rows (block, era, role): each named range (name, first, last era number) validates; eras that end at least embargo
    before its first train, if there are min_history of them."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("b"), F.lit(a).alias("a"), F.lit(z).alias("z")) for n, a, z in blocks]))
    rows = df.select(era).distinct().select(era, F.expr(f"try_cast(`{era}` as bigint)").alias("e_"), named.alias("s_"))
    role = F.when(F.col("e_").between(F.col("s_.a"), F.col("s_.z")), "validation").when(F.col("e_") < F.col("s_.a") - embargo, "train")
    out = rows.select(F.col("s_.b").alias("block"), era, role.alias("role")).filter(F.col("role").isNotNull())
    return out.withColumn("c_", F.sum(F.when(F.col("role") == "train", 1).otherwise(0)).over(W.partitionBy("block"))).filter(F.col("c_") >= min_history).select("block", era, "role")


def inner_validation(df: DataFrame, fraction: float, embargo: int = 0, mode: str = "eras", key: str = "id", seed: int = 1337, era: str = "era") -> DataFrame:
    """df with inner_role: the last fraction of eras validates, with an embargo before (null role); or, with mode rows, so
    much of the rows by order of md5; or, with mode none, all train."""
    if mode == "none":
        return df.withColumn("inner_role", F.lit("train"))
    if mode == "rows":
        share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        return df.withColumn("inner_role", F.when(share < fraction, "validation").otherwise("train"))
    held = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)).cast("int"))
    first = F.col("n") - held
    roles = era_index(df, era).select(era, F.when(F.col("i") >= first, "validation").when(F.col("i") < first - embargo, "train").alias("inner_role"))
    return df.join(F.broadcast(roles), era)  # one row an era


def _order(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def capped_sample(df: DataFrame, cap: int, key: str = "id", seed: int = 1337) -> DataFrame:
    """At most cap rows, those of the least md5 of (seed, key). Counts of the first four digits say which of them are taken
    whole; only the rows of the last are sorted."""
    head = F.substring(_order(seed, key), 1, 4)
    taken, last = 0, None
    for r in sorted(df.groupBy(head.alias("h_")).count().collect()):  # at most 65,536 rows
        if taken + r["count"] > cap:
            last = r["h_"]
            break
        taken += r["count"]
    if last is None:
        return df
    return df.filter(head < last).unionByName(df.filter(head == last).orderBy(_order(seed, key), key).limit(cap - taken))


def balanced_sample(df: DataFrame, cap: int, key: str = "id", seed: int = 1337, era: str = "era", by: list[str] | None = None) -> DataFrame:
    """At most cap rows with an equal quota for each era; what short eras leave goes to the others in era order. Rows of an
    era are taken by md5 of (seed, key). With by, so many rows of each of these groups."""
    by = by or []
    sizes = df.groupBy(*by, era).agg(F.count("*").alias("c_"))
    everything = W.partitionBy(*by)
    quota = F.floor(F.lit(cap) / F.count("*").over(everything))
    sizes = sizes.withColumn("q_", F.least(F.col("c_"), quota))
    left = F.lit(cap) - F.sum("q_").over(everything)
    spare = F.col("c_") - F.col("q_")
    before = F.coalesce(F.sum(spare).over(everything.orderBy(era_number(era)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("left_", left).withColumn("take_", F.col("q_") + F.greatest(F.lit(0), F.least(spare, F.col("left_") - before))).select(*by, era, "take_")
    ranked = df.withColumn("k_", F.row_number().over(W.partitionBy(*by, era).orderBy(_order(seed, key), key)))
    return ranked.join(F.broadcast(sizes), [*by, era]).filter(F.col("k_") <= F.col("take_")).drop("k_", "take_")  # one row an era


def predict_linear(df: DataFrame, weights: dict[str, float], intercept: float = 0.0, name: str = "prediction", era: str = "era", rank: bool = True) -> DataFrame:
    """A linear model's output, as a percentile rank by era unless told otherwise. Features that are not finite count as 0."""
    raw = sum((F.lit(float(w)) * F.coalesce(clean(f), F.lit(0.0)) for f, w in weights.items()), F.lit(float(intercept)))
    df = df.withColumn("raw_", raw)
    return df.withColumn(name, percent_rank("raw_", era) if rank else F.col("raw_")).drop("raw_")


def predict_with(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: list[str], name: str = "prediction", era: str = "era", rank: bool = True) -> DataFrame:
    """Any callable from a feature matrix to a vector, applied in Arrow batches; then ranked by era."""

    def run(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(np.asarray(predict(batch.to_numpy(np.float64)), float), index=batch.index)

    run = F.pandas_udf(run, "double")
    df = df.withColumn("raw_", run(F.struct(*[F.coalesce(clean(f), F.lit(0.0)).alias(f) for f in features])))
    return df.withColumn(name, percent_rank("raw_", era) if rank else F.col("raw_")).drop("raw_")


def out_of_fold(df: DataFrame, splits: DataFrame, features: list[str], target: str, era: str = "era", ridge: float = 0.0, key: str | None = "id", estimator=None, cap: int = 500_000, seed: int = 1337) -> DataFrame:
    """Validation rows of every fold with the prediction of a model fitted on the fold's train eras. Raises on repeated keys,
    unless key is None.

    Without an estimator the model is least squares with an intercept: products are summed by era once, then by fold over
    eras, so each row is read twice whatever the number of folds, and a small system is solved for each fold. An estimator
    is an object with fit(X, y) and predict(X); it is fitted in one task a fold, on at most cap rows (those that
    balanced_sample takes of the fold's eras), kept in a shared folder and fetched by the tasks that predict. One that also
    has partial_fit(X, y) and merge(other) is fitted on all rows, in parts, and cap does not count. For
    pyspark.ml regressors see ml_out_of_fold().
    """
    if key is not None:
        enforce(key_contract(df.select(key, era), key, era).select("null_keys", "duplicate_rows"), "out-of-fold rows")
    train = F.broadcast(splits.filter("role = 'train'").select("fold", era))  # a row for each fold and era
    held = F.broadcast(splits.filter("role = 'validation'").select("fold", era))
    if estimator is not None:
        return _fitted_out_of_fold(df, train, held, features, target, era, key or era, estimator, cap, seed)
    sums = grams(df, target, features, [era]).join(train, era).select("fold", "sums_")
    betas = fitted(sums, ["fold"], len(features), least_squares(ridge=ridge, varying=False))
    rows = df.join(held, era).join(F.broadcast(betas), "fold")  # a row for each fold
    return rows.withColumn("prediction", linear("beta_", features)).withColumnRenamed("fold", "cv_fold").drop("beta_")


def _fitted_out_of_fold(df, train, held, features, target, era, key, estimator, cap, seed) -> DataFrame:
    xs = [F.coalesce(clean(f), F.lit(0.0)) for f in features]
    names = [f"x{i}_" for i in range(len(features))]
    rows = df.filter(clean(target).isNotNull()).select(era, F.col(key).alias("key_"), *[x.alias(n) for x, n in zip(xs, names, strict=True)], clean(target).alias("y_"))
    if fits_in_parts(estimator):
        models = fit_in_parts(rows, train, names, estimator, era)
    else:
        models = fit_in_tasks(fold_samples(rows, train, cap, "key_", _order, seed, era), names, estimator, [era, "key_"])  # at most cap rows a fold
    folder = write_models(models, shared_folder(df.sparkSession, "models"))
    return predict_by_fold(df.join(held, era), folder, xs).withColumnRenamed("fold", "cv_fold")


def ml_out_of_fold(df: DataFrame, splits: DataFrame, features: list[str], target: str, estimator, era: str = "era", key: str | None = "id", folder: str | None = None) -> DataFrame:
    """out_of_fold() with a pyspark.ml regressor: each fold's fit is a Spark job over all of its train rows, and prediction stays
    in the JVM. The fitted pipelines are saved below folder (a new shared one unless given); see models.fit_ml_folds(). The rows are kept in
    a shared folder, so select the columns that are needed first."""
    if key is not None:
        enforce(key_contract(df.select(key, era), key, era).select("null_keys", "duplicate_rows"), "out-of-fold rows")
    df = kept(df, "fold-rows")  # every fold reads the rows twice: what makes them, joins and their broadcasts, runs once
    splits = df.sparkSession.createDataFrame(splits.select("fold", era, "role").collect(), splits.select("fold", era, "role").schema)  # a row for each fold and era
    _, models = fit_ml_folds(df, splits, features, target, estimator, folder, era)
    return predict_ml_folds(df, splits, features, models, era)


def era_weights(df: DataFrame, name: str = "weight", era: str = "era") -> DataFrame:
    """Row weights that give each era the same sum; their mean is 1."""
    per = df.groupBy(era).agg(F.count("*").alias("c_"))
    per = per.select(era, (F.sum("c_").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.col("c_"))).alias(name))
    return df.join(F.broadcast(per), era)  # one row an era


def chronological_blocks(df: DataFrame, k: int, era: str = "era") -> DataFrame:
    """Rows (era, block): distinct eras in k runs from 0, the first ones longer by one where k does not divide."""
    return df.select(era).distinct().select(era, (F.ntile(k).over(W.orderBy(era_number(era))) - 1).alias("block"))


def recency_weights(df: DataFrame, half_life: float, era: str = "era") -> DataFrame:
    """Rows (era, weight): 2 ** (-age / half_life), age in eras before the last."""
    return era_index(df, era).select(era, F.pow(F.lit(2.0), -(F.col("n") - 1 - F.col("i")) / F.lit(float(half_life))).alias("weight"))


def positional_split(df: DataFrame, fraction: float, key: str = "id", era: str = "era") -> DataFrame:
    """df with part: the first fraction of all rows, by era and key, are train. Places come from era counts and a number
    inside the era, so no window holds the table."""
    counts = df.groupBy(era).agg(F.count("*").alias("c_"))
    places = counts.select(era, F.coalesce(F.sum("c_").over(W.orderBy(era_number(era)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b_"), F.sum("c_").over(W.partitionBy()).alias("all_"))
    placed = df.withColumn("k_", F.row_number().over(W.partitionBy(era).orderBy(key))).join(F.broadcast(places), era)  # one row an era
    return placed.withColumn("part", F.when(F.col("b_") + F.col("k_") <= F.floor(F.col("all_") * F.lit(fraction)), "train").otherwise("validation")).drop("k_", "b_", "all_")

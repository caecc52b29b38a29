"""Models by fold: fitted by Spark or in a task, kept by fold in a shared folder, fetched there by the tasks that predict.

A fitted model never travels with the rows. The folder holds one directory a fold; a task reads those of the folds that it
meets, each once, so the time of a prediction does not depend on how many bytes a model has. A lost executor costs nothing:
whoever takes its tasks reads the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.ranking import clean
from ..sources.store import shared_folder
from .contracts import ContractError
from .summary import era_number

#: Models that a task keeps at a time.
KEPT = 8


def write_models(models: DataFrame, folder: str) -> str:
    """Rows (fold, model_): a fitted model's bytes for each fold, written below folder by fold."""
    models.select("fold", "model_").write.partitionBy("fold").parquet(folder)
    return folder


def read_model(folder: str, fold: int) -> bytes:
    """One model's bytes, from wherever Spark has written them; called in tasks."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    store, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    files = [f.path for f in store.get_file_info(pafs.FileSelector(f"{path}/fold={fold}")) if f.path.endswith(".parquet")]
    return next(m for f in files for m in pq.read_table(f, filesystem=store, columns=["model_"], partitioning=None)["model_"].to_pylist())


def predict_by_fold(rows: DataFrame, folder: str, features: list[Column], name: str = "prediction", fold: str = "fold") -> DataFrame:
    """rows with what the model of their fold, an object with predict(X), says of the features; X is a float64 matrix."""

    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        kept: dict[int, object] = {}
        for which, x in batches:
            out = np.full(len(which), np.nan)
            for f in which.unique():
                if f not in kept:
                    if len(kept) >= KEPT:
                        kept.pop(next(iter(kept)))
                    kept[f] = cloudpickle.loads(read_model(folder, int(f)))
                at = (which == f).to_numpy()
                out[at] = np.asarray(kept[f].predict(x[at].to_numpy(np.float64)), float)
            yield pd.Series(out)

    return rows.withColumn(name, F.pandas_udf(run, "double")(F.col(fold), F.struct(*[x.alias(f"x{i}") for i, x in enumerate(features)])))


def fold_samples(df: DataFrame, train: DataFrame, cap: int, key: str, order: Callable[[int, str], Column], seed: int = 1337, era: str = "era") -> DataFrame:
    """Rows of df once for each fold that takes them: at most cap rows a fold, an equal quota for each of its train eras (rows
    (fold, era) of train), leftovers in era order, within an era by md5 of (seed, key).

    An era's rows are placed once and cut at the most that any fold takes of it; only what is left is dealt to folds.
    """
    sizes = df.groupBy(era).agg(F.count("*").alias("c_")).join(train, era)
    fold = W.partitionBy("fold")
    sizes = sizes.withColumn("q_", F.least(F.col("c_"), F.floor(F.lit(cap) / F.count("*").over(fold))))
    spare = F.col("c_") - F.col("q_")
    before = F.coalesce(F.sum(spare).over(fold.orderBy(era_number(era)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("left_", F.lit(cap) - F.sum("q_").over(fold)).withColumn("before_", before)
    takes = sizes.select("fold", era, (F.col("q_") + F.greatest(F.lit(0), F.least(spare, F.col("left_") - F.col("before_")))).alias("take_"))
    most = takes.groupBy(era).agg(F.max("take_").alias("most_"))
    placed = df.join(F.broadcast(most), era).withColumn("k_", F.row_number().over(W.partitionBy(era).orderBy(order(seed, key), key))).filter(F.col("k_") <= F.col("most_"))  # one row an era
    return placed.join(F.broadcast(takes), era).filter(F.col("k_") <= F.col("take_")).drop("k_", "take_", "most_")  # a row for each fold and era


def fit_in_tasks(taken: DataFrame, names: list[str], estimator, order: list[str]) -> DataFrame:
    """Rows (fold, model_): an estimator with fit(X, y) fitted on the rows (fold, y_, names...) of each fold, in one task a fold."""
    packed = cloudpickle.dumps(estimator)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        model = cloudpickle.loads(packed)
        said = model.fit(pdf[names].to_numpy(np.float64), pdf["y_"].to_numpy(np.float64))
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "model_": [cloudpickle.dumps(model if said is None else said)]})

    return taken.groupBy("fold").applyInPandas(fit, "fold int, model_ binary")


def fits_in_parts(estimator) -> bool:
    return hasattr(estimator, "partial_fit") and hasattr(estimator, "merge")


def fit_in_parts(rows: DataFrame, train: DataFrame, names: list[str], estimator, era: str = "era") -> DataFrame:
    """Rows (fold, model_): an estimator with partial_fit(X, y) and merge(other) fitted on all rows (era, y_, names...) of each
    fold's train eras (rows (fold, era) of train). A task fits one copy for each era that it meets; copies are merged by era, then
    by fold, so a row is read once whatever the number of folds, and copies are all that is shuffled."""
    packed = cloudpickle.dumps(estimator)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, object] = {}
        for b in batches:
            for e, part in b.groupby(era, sort=False, dropna=False):
                if e not in own:
                    own[e] = cloudpickle.loads(packed)
                own[e].partial_fit(part[names].to_numpy(np.float64), part["y_"].to_numpy(np.float64))
        if own:
            yield pd.DataFrame({era: list(own), "model_": [cloudpickle.dumps(m) for m in own.values()]})

    def merged(by: str, keep: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            first, *rest = (cloudpickle.loads(m) for m in sorted(pdf["model_"]))  # sorted, so that reruns agree
            for m in rest:
                first.merge(m)
            return pd.DataFrame({by: pdf[by].iloc[:1], "model_": [cloudpickle.dumps(first)]})[keep]

        return run

    wanted = rows.join(F.broadcast(train.select(era).distinct()), era, "left_semi")  # one row an era
    schema = StructType([rows.schema[era]]).add("model_", "binary")
    eras = wanted.select(era, "y_", *names).mapInPandas(fit, schema).groupBy(era).applyInPandas(merged(era, [era, "model_"]), schema)
    return eras.join(train.select("fold", era), era).groupBy("fold").applyInPandas(merged("fold", ["fold", "model_"]), "fold int, model_ binary")


def fit_ml_folds(df: DataFrame, splits: DataFrame, features: list[str], target: str, estimator, folder: str | None = None, era: str = "era") -> tuple[str, dict[int, object]]:
    """(folder, fitted pipelines by fold): a pyspark.ml regressor for each fold, fitted by Spark on all rows of the fold's train
    eras whose target is finite, and saved below folder as fold=k. The regressor reads the columns features_ and label_ and
    writes prediction_, whatever it was set to. Features that are not finite count as 0; a fold without rows is an error."""
    from pyspark.ml import Pipeline

    folder = folder or shared_folder(df.sparkSession, "models")
    rows, train = _numbered(df, features, target).filter("label_ is not null"), splits.filter("role = 'train'")
    own = estimator.copy({estimator.getParam(p): c for p, c in (("featuresCol", "features_"), ("labelCol", "label_"), ("predictionCol", "prediction_"))})
    models = {}
    for fold in sorted(r["fold"] for r in splits.select("fold").distinct().collect()):  # a row a fold
        eras = F.broadcast(train.filter(F.col("fold") == fold).select(era))  # one row an era
        mine = rows.join(eras, era, "left_semi").select("features_", "label_")
        if mine.isEmpty():
            raise ContractError(f"fold {fold} has no train rows")
        models[fold] = Pipeline(stages=[own]).fit(mine)
        models[fold].write().save(f"{folder}/fold={fold}")
    return folder, models


def load_ml_folds(spark: SparkSession, folder: str, folds: list[int]) -> dict[int, object]:
    """The pipelines that fit_ml_folds() has saved."""
    from pyspark.ml import PipelineModel

    return {f: PipelineModel.load(f"{folder}/fold={f}") for f in folds}


def predict_ml_folds(df: DataFrame, splits: DataFrame, features: list[str], models: dict[int, object], era: str = "era", name: str = "prediction") -> DataFrame:
    """Validation rows of every fold with their fold as cv_fold and the prediction of its pipeline, in the JVM."""
    rows, held, out = _numbered(df, features, None), splits.filter("role = 'validation'"), None
    for fold, model in models.items():
        eras = F.broadcast(held.filter(F.col("fold") == fold).select(era))  # one row an era
        said = model.transform(rows.join(eras, era, "left_semi")).select(*df.columns, F.lit(fold).alias("cv_fold"), F.col("prediction_").alias(name))
        out = said if out is None else out.unionByName(said)
    return out


def _numbered(df: DataFrame, features: list[str], target: str | None) -> DataFrame:
    """df with its features as a vector and its target as label_, if it has one."""
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector(F.array(*[F.coalesce(clean(f), F.lit(0.0)) for f in features]))
    return df.withColumns({"features_": vector} | ({"label_": clean(target)} if target else {}))


#: Most rows of an era that predict_pairs() puts in one task.
ERA_ROWS = 1_000_000


def predict_pairs(live: DataFrame, benchmarks: DataFrame, predict: Callable[[pd.DataFrame, pd.DataFrame], object], key: str = "id", era: str = "era", name: str = "prediction", most: int = ERA_ROWS) -> DataFrame:
    """Rows (key, era, name): what a predictor of two tables says of the live rows, era by era.

    predict(live, benchmarks) gets the rows of one era of both, without the era's column, each indexed and sorted by key, and
    returns a value for each live row: a series or a frame (its first column) by key, or an array in order. A live era without
    benchmark rows comes with an empty table; benchmark eras without live rows are not predicted. An era is one task's; one of
    more than most rows in either table is an error, as are repeated or null live keys within it and a result that lacks a live key.
    """
    sizes = live.select(era, F.lit(0).alias("t_")).unionByName(benchmarks.select(era, F.lit(1).alias("t_"))).groupBy(era, "t_").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > most:
        raise ContractError(f"an era has {sizes} rows, more than {most}")
    schema = StructType([live.schema[key], live.schema[era], StructField(name, DoubleType())])

    def run(group, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one):
            return one[[key, era]].assign(**{name: pd.Series(dtype=float)})
        if one[key].isna().any() or one[key].duplicated().any():
            raise ContractError(f"era {group[0]}: live keys are null or repeated")
        one, two = (t.drop(columns=era).set_index(key).sort_index() for t in (one, two))
        said = predict(one, two)
        said = said.iloc[:, 0] if isinstance(said, pd.DataFrame) else said
        if isinstance(said, pd.Series):
            if not one.index.isin(said.index).all():
                raise ContractError(f"era {group[0]}: the predictor left out live keys")
            said = said.reindex(one.index)
        values = np.asarray(said, float)
        if len(values) != len(one):
            raise ContractError(f"era {group[0]}: {len(values)} values for {len(one)} rows")
        return pd.DataFrame({key: one.index, era: group[0], name: values})

    other = benchmarks.select(*[F.col(c).alias(c) for c in benchmarks.columns])  # names of its own, if both come from one table
    return live.groupBy(era).cogroup(other.groupBy(era)).applyInPandas(run, schema)

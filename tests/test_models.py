"""Models by fold: samples, stores, and pyspark.ml regressors."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from erascope.operators import models as M
from erascope.operators import splits as SP
from erascope.operators.contracts import ContractError
from erascope.sources.store import shared_folder


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{e:02d}-{i:03d}", f"{e:04d}", float(rng.normal()), None if i % 17 == 0 else float(rng.normal()), float(rng.normal())) for e in range(12) for i in range(20 + 7 * e)]
    df = spark.createDataFrame(rows, "id string, era string, x double, z double, y double")
    return df.withColumn("y", F.when(F.col("id") != "03-003", F.col("y") + 2 * F.col("x")))


class Big:
    """Predicts x, and is as large as it is told."""

    def __init__(self, size):
        self.size = size

    def fit(self, x, y):
        self.ballast = np.random.default_rng(0).bytes(self.size)

    def predict(self, x):
        return x[:, 0]


def test_samples_equal_those_of_multiplied_rows(panel):
    sp = SP.cv_splits(panel, 3, 1, strict=False)
    train = sp.filter("role = 'train'").select("fold", "era")
    for cap in (7, 60, 10_000):
        want = SP.balanced_sample(panel.join(train, "era"), cap, by=["fold"])
        got = M.fold_samples(panel, train, cap, "id", SP._order)
        assert sorted((r.fold, r.id) for r in got.collect()) == sorted((r.fold, r.id) for r in want.collect())


def test_a_model_is_no_column_and_its_size_costs_nothing(spark, panel):
    sp, took = SP.cv_splits(panel, 3, 1, strict=False), {}
    many = panel.crossJoin(spark.range(30).withColumnRenamed("id", "copy"))
    for size in (1_000, 8_000_000):
        out = SP.out_of_fold(panel, sp, ["x", "z"], "y", estimator=Big(size), cap=40)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "model_" not in plan
        folder = shared_folder(spark, "models")
        M.write_models(M.fit_in_tasks(M.fold_samples(panel.select("era", "id", F.col("x").alias("x0_"), F.lit(0.0).alias("y_")), sp.filter("role = 'train'").select("fold", "era"), 40, "id", SP._order), ["x0_"], Big(size), ["id"]), folder)
        rows = M.predict_by_fold(many.join(sp.filter("role = 'validation'"), "era"), folder, [F.col("x")])
        rows.limit(1).collect()
        began = time.time()
        assert rows.filter("prediction <> x or prediction is null").count() == 0
        took[size] = time.time() - began
    assert took[8_000_000] < 3 * took[1_000] + 2, took


def test_out_of_fold_uses_each_folds_model(panel):
    class Mean:
        def fit(self, x, y):
            self.m = float(y.mean())

        def predict(self, x):
            return np.full(len(x), self.m)

    sp = SP.cv_splits(panel, 3, 1, strict=False)
    got = SP.out_of_fold(panel, sp, ["x"], "y", estimator=Mean()).toPandas()
    pdf, roles = panel.toPandas(), sp.toPandas()
    for fold, part in got.groupby("cv_fold"):
        eras = roles[(roles.fold == fold) & (roles.role == "train")].era
        assert np.allclose(part.prediction, pdf[pdf.era.isin(eras)].y.mean())
    assert len(got) == len(pdf[pdf.era.isin(roles[roles.role == "validation"].era)])


def test_ml_regressors_by_fold(spark, panel):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    sp = SP.cv_splits(panel, 3, 1, strict=False)
    want = {(r.id, r.cv_fold): r.prediction for r in SP.out_of_fold(panel, sp, ["x", "z"], "y").collect()}
    folder = shared_folder(spark, "ml")
    got = SP.ml_out_of_fold(panel, sp, ["x", "z"], "y", LinearRegression(solver="normal", featuresCol="other"), folder=folder)
    assert got.columns == [*panel.columns, "cv_fold", "prediction"]
    got = {(r.id, r.cv_fold): r.prediction for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    again = M.predict_ml_folds(panel, sp, ["x", "z"], M.load_ml_folds(spark, folder, sorted({k[1] for k in want})))
    assert all(abs(r.prediction - got[r.id, r.cv_fold]) < 1e-12 for r in again.collect())
    trees = SP.ml_out_of_fold(panel, sp, ["x", "z"], "y", DecisionTreeRegressor(maxDepth=2))
    assert trees.count() == len(want)


def test_a_fold_without_rows_and_repeated_keys_are_refused(panel):
    from pyspark.ml.regression import LinearRegression

    sp = SP.cv_splits(panel, 3, 1, strict=False)
    with pytest.raises(ContractError):
        SP.ml_out_of_fold(panel.withColumn("y", F.lit(None).cast("double")), sp, ["x"], "y", LinearRegression())
    with pytest.raises(ContractError):
        SP.ml_out_of_fold(panel.unionByName(panel.limit(1)), sp, ["x"], "y", LinearRegression())

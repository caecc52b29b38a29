"""Scores from value counts against the long form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from erascope.functions.normal import probit_values
from erascope.operators import discrete as D
from erascope.operators import scores as S
from erascope.operators.contracts import ContractError

FEATURES = [f"f{i}" for i in range(7)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(6):
        for i in range(1 if e == 5 else 60):  # the last era has one row
            x = [None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 5, 7)]
            x[0] = 2.0  # constant
            if e == 2:
                x[1] = None  # missing in an era
            if e == 3 and i % 7 == 0:
                x[2] = float("nan")
            t = [0.0, 0.25, 0.5, 0.75, 1.0, None, float("inf")][int(rng.integers(0, 7))] if e != 4 else 0.5  # a constant target
            rows.append((f"{e}-{i}", f"{e:04d}", *x, t, None if rng.random() < 0.05 else float(rng.normal(1e6, 3))))
    schema = "id string, era string, " + ", ".join(f"f{i} double" for i in range(7)) + ", target double, p double"
    return spark.createDataFrame(rows, schema).repartition(5)


def as_dict(df, name, value):
    return {(r["era"], r[name]): r[value] for r in df.collect()}


def same(got, want, most=1e-12):
    assert len(got) >= len(want)
    for k, v in got.items():
        w = want.get(k)
        assert (v is None) == (w is None), (k, v, w)
        assert v is None or abs(v - w) < most, (k, v, w)


def test_corr_equals_the_long_form(panel):
    got = as_dict(D.aligned_discrete_scores(panel, FEATURES, "target"), "signal", "corr")
    same(got, as_dict(S.aligned_feature_scores(panel, FEATURES, "target"), "signal", "corr"))
    assert len(got) == 6 * 7 and any(v is not None for v in got.values())


def test_exposures_equal_the_wide_form(panel):
    same(as_dict(D.discrete_exposures(panel, "p", FEATURES), "feature", "exposure"), as_dict(S.exposures(panel, "p", FEATURES), "feature", "exposure"), 1e-9)


def test_small_integers_and_little_memory(spark, panel, monkeypatch):
    bytes_ = panel.select("id", "era", "target", "p", *[F.when(~F.isnan(f), F.col(f)).cast("tinyint").alias(f) for f in FEATURES])
    want = as_dict(S.aligned_feature_scores(bytes_, FEATURES, "target"), "signal", "corr")
    monkeypatch.setattr(D, "HELD", 3000)  # one group at a time, passed on often
    same(as_dict(D.aligned_discrete_scores(bytes_, FEATURES, "target"), "signal", "corr"), want)


def test_plan_does_not_grow_with_the_features(spark, panel):
    def steps(n):
        df = panel.select("era", "target", *[F.lit(1).cast("tinyint").alias(f"g{i}") for i in range(n)])
        plan = D.discrete_scores(df, [f"g{i}" for i in range(n)], "target", levels=[0.0, 0.5, 1.0, 0.25, 0.75])._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan
        return plan.count("\n")

    assert steps(3) == steps(300)


def test_what_is_refused_and_empty(spark, panel):
    with pytest.raises(Exception, match="values other than"):
        D.discrete_scores(panel, FEATURES, "target", values=(0, 1, 2, 3)).collect()
    with pytest.raises(ContractError):
        D.levels_of(panel, "p", 5)
    with pytest.raises(ContractError):
        D.discrete_scores(panel, ["id"], "target")
    assert D.discrete_scores(panel.limit(0), FEATURES, "target").count() == 0


def test_probit_values():
    from statistics import NormalDist

    p = np.concatenate((np.linspace(1e-9, 1 - 1e-9, 2001), [0.0, 1.0, np.nan]))
    got = probit_values(p)
    assert max(abs(g - NormalDist().inv_cdf(x)) for g, x in zip(got[:-3], p[:-3], strict=True)) < 1e-8
    assert np.isnan(got[-3:]).all()

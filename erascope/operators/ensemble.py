"""Blends of signals by their ranks within eras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import first_rank, percent_rank
from ..sources.store import kept
from .large import Groups, has_large


def rank_blends(df: DataFrame, blends: dict[str, dict[str, float]], era: str = "era", rerank: bool = True, ranks: tuple[str, ...] = ()) -> DataFrame:
    """df with a column for each blend {name: {signal: weight}}: the weighted sum of percentile ranks by era, ranked again unless
    told otherwise; null where a signal of the blend is.

    The rows are dealt by era once; all ranks of the signals take one sort and those of the blends another one, whatever their
    number. Each row is there once a signal between, so select the columns that are needed first. Of the columns' types, maps
    are not allowed. Where an era is large, each signal of many values deals the rows once to ranges of its own, the sums are kept
    in a shared folder, and they deal the rows once more. Signals in ranks are percentile ranks already, which saves that.
    """
    signals = list(dict.fromkeys(s for b in blends.values() for s in b))
    if has_large(df, [era]):
        return _blends_of_large(df, blends, signals, era, rerank, ranks)
    rows = df.repartition(F.col(era)).withColumn("row_", F.monotonically_increasing_id())
    keep = rows.columns
    many = lambda names: F.explode(F.array(*[F.struct(F.lit(i).alias("s_"), F.col(n).cast("double").alias("v_")) for i, n in enumerate(names)]))
    ranked = lambda d, names: d.select(*keep, many(names).alias("p_")).select(*keep, "p_.s_", "p_.v_").withColumn("r_", percent_rank("v_", era, "s_")).groupBy(*keep)
    of = lambda i: F.when(F.col("s_") == i, F.col("r_"))
    # sums that differ by rounding alone are ties
    sums = [F.when(F.count(F.coalesce(*[of(signals.index(s)) for s in w])) == len(w), F.round(sum((F.lit(float(x)) * F.max(of(signals.index(s))) for s, x in w.items()), F.lit(0.0)), 12)).alias(f"b{i}_") for i, w in enumerate(blends.values())]
    out = ranked(rows, signals).agg(*sums)
    names = [f"b{i}_" for i in range(len(blends))]
    if rerank:
        out = ranked(out, names).agg(*[F.max(of(i)).alias(n) for i, n in enumerate(names)])
    return out.select(*df.columns, *[F.col(n).alias(b) for n, b in zip(names, blends, strict=True)])


def _blends_of_large(df: DataFrame, blends: dict[str, dict[str, float]], signals: list[str], era: str, rerank: bool, ranks: tuple[str, ...]) -> DataFrame:
    names = {s: f"v{i}_" for i, s in enumerate(signals)}
    rows = df.select(*df.columns, *[F.col(s).cast("double").alias(v) for s, v in names.items()])
    rows = _percent_ranks(rows, [v for s, v in names.items() if s not in ranks], era)
    # sums that differ by rounding alone are ties
    sums = {b: F.round(sum((F.lit(float(x)) * F.col(names[s]) for s, x in w.items()), F.lit(0.0)), 12) for b, w in blends.items()}
    rows = rows.select(*df.columns, *[x.alias(f"b{i}_") for i, x in enumerate(sums.values())])
    if rerank:
        rows = _percent_ranks(kept(rows, "blends"), [f"b{i}_" for i in range(len(blends))], era)
    return rows.select(*df.columns, *[F.col(f"b{i}_").alias(b) for i, b in enumerate(blends)])


def _percent_ranks(rows: DataFrame, columns: list[str], era: str) -> DataFrame:
    """rows with columns replaced by their percentile ranks."""
    groups = Groups(rows.select(era, *columns), columns, [era])
    for c in columns:
        rows = groups.ranked(rows, "rank_", "count_", c).withColumn(c, F.col("rank_") / F.col("count_")).drop("rank_", "count_")
    return rows


def rank_blend(df: DataFrame, weights: dict[str, float], name: str = "blend", era: str = "era", rerank: bool = True, ranks: tuple[str, ...] = ()) -> DataFrame:
    """One of rank_blends()."""
    return rank_blends(df, {name: weights}, era, rerank, ranks)


def two_signal_blends(df: DataFrame, a: str, b: str, weights: list[float], era: str = "era") -> DataFrame:
    """Columns w35 ... for each weight of a (b has the rest), ranked again."""
    return rank_blends(df, {f"w{round(100 * w)}": {a: w, b: 1 - w} for w in weights}, era)


def seed_ensemble(df: DataFrame, seeds: list[str], reference: str | None = None, weight: float = 0.5, name: str = "ensemble", era: str = "era") -> DataFrame:
    """Mean of the seeds' ranks, ranked again; then blended with a reference's rank, and ranked again."""
    share = 1.0 / len(seeds)
    large = has_large(df, [era])
    df = rank_blend(df, {s: share for s in seeds}, name, era)
    if reference is None:
        return df
    if large:
        df = kept(df, "seeds")  # read more than once
    return rank_blend(df, {name: weight, reference: 1 - weight}, "e_", era, ranks=(name,)).drop(name).withColumnRenamed("e_", name)


def mean_of_ranks(df: DataFrame, signals: list[str], name: str = "ensemble", era: str = "era") -> DataFrame:
    """Equal mean of percentile ranks, not ranked again."""
    return rank_blend(df, {s: 1.0 / len(signals) for s in signals}, name, era, rerank=False)


def target_ensemble(df: DataFrame, signals: list[str], key: str = "id", name: str = "ensemble", era: str = "era") -> DataFrame:
    """Mean of ranks, then a rank without ties, in order of key."""
    if has_large(df, [era]):
        df = kept(mean_of_ranks(df, signals, "m_", era), "ranks")
        placed = Groups(df.select(era, "m_"), ["m_"], [era]).ranked(df, "rank_", "count_", "m_", key)
        return placed.withColumn(name, F.col("rank_") / F.col("count_")).drop("m_", "rank_", "count_")
    df = mean_of_ranks(df, signals, "m_", era)
    return df.withColumn(name, first_rank("m_", key, era)).drop("m_")

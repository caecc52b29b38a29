"""Scores of hundreds of discrete features at once, from tables of value counts.

A feature with a handful of values has a handful of ranks in an era, and how often each value meets each level of the target
says all that a score needs. Each task counts its rows by (group, target level, value) for every feature as Arrow batches
pass, one bincount a feature; what is shuffled is one packed table for a task and group. No row is copied for a feature, no
rank is sorted, and the plan has the same steps for five features or five thousand. Ranks, normal quantiles and correlations
follow exactly from the summed counts.

A task holds tables of HELD bytes before it passes them on. With rows laid out by era (sources.panel.write_era_buckets) a task
sees few eras and passes on few tables; scattered rows cost a table for each era that a batch touches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructType

from ..functions.normal import probit_values
from ..functions.ranking import clean
from .contracts import ContractError, numbers_only

HELD = 1 << 26
#: Most distinct values of a target that is counted by level.
LEVELS = 64
VALUES = (0.0, 1.0, 2.0, 3.0, 4.0)


@dataclass(frozen=True)
class Made:
    """Features that a task makes from other columns of its rows, so that the rows pass to it without them: the numbers of the
    inputs and where any of these is missing go in, for each of names its values and where they are missing comes out."""

    names: list[str]
    inputs: list[str]
    make: Callable[[list[np.ndarray], np.ndarray], Iterable[tuple[np.ndarray, np.ndarray]]]


def names_of(features: list[str] | Made) -> list[str]:
    return features.names if isinstance(features, Made) else features


def numbers_and_missing(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Integers as they are, 0 where missing; all others as doubles, NaN where missing."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False), missing
    return column.to_numpy(zero_copy_only=False).astype(np.float64), missing


def levels_of(df: DataFrame, column: str, most: int = LEVELS) -> list[float]:
    """The distinct finite values of a column, in order; more than so many are an error."""
    got = df.select(clean(column).alias("v_")).filter("v_ is not null").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ContractError(f"{column} has more than {most} values")
    return sorted(r["v_"] for r in got)


def value_tables(df: DataFrame, features: list[str] | Made, by: list[str], values: tuple[float, ...] = VALUES, level: tuple[str, list[float]] | None = None, sums: list[str] | None = None) -> DataFrame:
    """Rows (by..., table_): packed tables of shape (1 + sums, features, levels, values) of the rows' numbers and of the sums of
    some columns; a group may have several. Rows whose level or any of whose summed columns is missing are left out, as are
    missing values in their feature. A value that is not among values is an error."""
    source = features.inputs if isinstance(features, Made) else features
    numbers_only(df, source)
    make, features = (features.make if isinstance(features, Made) else None), names_of(features)
    target, levels = level or (None, [0.0])
    more = sums or []
    rows = df.select(*by, *([F.col(target).alias("l_")] if target else []), *[F.col(c).alias(f"s{i}_") for i, c in enumerate(more)], *source)
    schema = StructType([rows.schema[b] for b in by]).add("table_", BinaryType())
    k, first, wanted, at_level = len(by), len(by) + bool(target) + len(more), np.array(values), np.array(levels)
    shape = (1 + len(more), len(features), len(levels), len(values))
    cells = len(levels) * (len(values) + 1)  # the last value is a missing one
    bytes_ = np.full(256, -1, np.int64)  # places of the values that a byte can have
    for i, v in enumerate(values):
        if v.is_integer() and -128 <= v < 128:
            bytes_[int(v) % 256] = i

    def coded(x: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The place of each value in ascending names; their number where it is missing; -1 where it is none of them."""
        at = np.searchsorted(names, x)
        right = names[np.minimum(at, len(names) - 1)] == x if len(names) else np.zeros(len(x), bool)
        return np.where(np.isfinite(x), np.where(right, at, -1), len(names))

    def numbers(column) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False).astype(np.float64)

    def placed(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        code = bytes_[x.view(np.uint8)] if x.dtype == np.int8 else coded(x.astype(np.float64), wanted)
        code[missing] = len(values)
        return code

    def numbered(b) -> tuple[np.ndarray, list[tuple]]:
        """The group of each row by number, and the groups."""
        if k == 1:
            one = b.column(0).dictionary_encode("encode")
            return one.indices.to_numpy(zero_copy_only=False).astype(np.int64), [(g,) for g in one.dictionary.to_pylist()]
        keys = list(zip(*(b.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * b.num_rows
        named: dict[tuple, int] = {}
        group = np.fromiter((named.setdefault(g, len(named)) for g in keys), np.int64, len(keys))
        return group, list(named)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types = None

        def flush():
            keys = list(zip(*held, strict=True)) or [()] * k
            packed = [zlib.compress(t.tobytes(), 1) for t in held.values()]
            out = pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(keys, types, strict=True)], pa.array(packed, pa.binary())], names=[*by, "table_"])
            held.clear()
            return out

        for b in batches:
            types = [b.schema.field(i).type for i in range(k)]
            group, names = numbered(b)
            known = np.ones(b.num_rows, bool)
            tier = np.zeros(b.num_rows, np.int64)
            if target:
                tier = coded(numbers(b.column(k)), at_level)
                if (tier < 0).any():
                    raise ContractError(f"{target} has values that are none of its levels")
                known &= tier < len(levels)
            weights = [numbers(b.column(k + bool(target) + i)) for i in range(len(more))]
            for w in weights:
                known &= np.isfinite(w)
            groups = np.unique(group[known])
            chunk = max(1, HELD // (8 * int(np.prod(shape))))
            for c in range(0, len(groups), chunk):
                mine = groups[c : c + chunk]
                pick = np.flatnonzero(known & (group >= mine[0]) & (group <= mine[-1]))
                here = (lambda x: x) if len(pick) == b.num_rows else (lambda x, pick=pick: x[pick])
                base = (np.searchsorted(mine, here(group)) * len(levels) + here(tier)) * (len(values) + 1)
                size = len(mine) * cells
                part = np.zeros((shape[0], len(features), size))
                w = [here(x) for x in weights]
                columns = (numbers_and_missing(b.column(first + i)) for i in range(len(source)))
                if make:
                    inputs = list(columns)
                    columns = make([here(x) for x, _ in inputs], here(np.any([m for _, m in inputs], 0)))
                else:
                    columns = ((here(x), here(m)) for x, m in columns)
                for i, (x, missing) in enumerate(columns):
                    code = placed(x, missing)
                    if len(code) and code.min() < 0:
                        raise ContractError(f"{features[i]} has values other than {values}")
                    at = base + code
                    part[0, i] = np.bincount(at, minlength=size)
                    for j, x in enumerate(w, 1):
                        part[j, i] = np.bincount(at, x, minlength=size)
                part = part.reshape(shape[0], len(features), len(mine), len(levels), len(values) + 1)[..., :-1]
                for g, name in enumerate(mine):
                    table = part[:, :, g]
                    if names[name] in held:
                        held[names[name]] += table
                    else:
                        held[names[name]] = table.copy()
                if len(held) * 8 * int(np.prod(shape)) > HELD:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def feature_rows(tables: DataFrame, by: list[str], features: list[str], shape: tuple[int, int, int], solve: Callable[[np.ndarray], np.ndarray], name: str, column: str) -> DataFrame:
    """Rows (by..., name, column), one for each group and feature: what solve makes of the groups' summed tables. shape is that
    of a table without its features: (1 + sums, levels, values). Tables are added one at a time."""
    schema = StructType([tables.schema[b] for b in by]).add(name, StringType()).add(column, DoubleType())
    k, full = len(by), (shape[0], len(features), *shape[1:])

    def run(batches):
        now, total = None, None

        def closed():
            out = solve(total)
            mine = [pa.array([x] * len(features), t) for x, t in zip(now, types, strict=True)]
            return pa.RecordBatch.from_arrays([*mine, pa.array(features, pa.string()), pa.array(out, pa.float64(), mask=~np.isfinite(out))], names=[*by, name, column])

        for b in batches:
            types = [b.schema.field(i).type for i in range(k)]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * b.num_rows
            for key, packed in zip(keys, b.column(k).to_pylist(), strict=True):
                if key != now:
                    if total is not None:
                        yield closed()
                    now, total = key, np.zeros(full)
                total += np.frombuffer(zlib.decompress(packed)).reshape(full)
        if total is not None:
            yield closed()

    return (tables.repartition(*by).sortWithinPartitions(*by) if by else tables.coalesce(1)).mapInArrow(run, schema)


def powered(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.abs(x) ** 1.5


def corr_of_counts(levels: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    """CORR of each feature from counts (1, features, levels, values): as scores.powered_correlation has it, null (NaN) where
    the feature or the target is constant."""
    level = np.array(levels)

    def solve(table: np.ndarray) -> np.ndarray:
        c = table[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            by_value, by_level, n = c.sum(1), c.sum(2), c.sum((1, 2))[:, None]
            share = (np.cumsum(by_value, 1) - by_value / 2) / n  # (average rank - 1/2) / n
            x = np.where(by_value > 0, powered(probit_values(share)), 0.0)
            y = powered(level - (by_level @ level)[:, None] / n)
            mx, my = (by_value * x).sum(1, keepdims=True) / n, (by_level * y).sum(1, keepdims=True) / n
            x, y = x - mx, y - my
            cov = np.einsum("ktv,kt,kv->k", c, y, x)
            spread = np.sqrt((by_value * x * x).sum(1) * (by_level * y * y).sum(1))
            varies = ((by_value > 0).sum(1) > 1) & ((by_level > 0).sum(1) > 1)
            return np.where(varies, cov / spread, np.nan)

    return solve


def exposure_of_sums(values: tuple[float, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Pearson of a signal with each feature from tables (numbers, sums of the signal, of its squares); null (NaN) where either
    is constant, up to rounding of the sums."""
    v = np.array(values)

    def solve(table: np.ndarray) -> np.ndarray:
        n_v, s_v, q_v = table[:, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            n, s, q = n_v.sum(1), s_v.sum(1), q_v.sum(1)
            mean, centre = s / n, v - (n_v @ v / n)[:, None]
            cov = (centre * (s_v - n_v * mean[:, None])).sum(1)
            spread_f, spread_s = (n_v * centre * centre).sum(1), q - s * mean
            varies = ((n_v > 0).sum(1) > 1) & (spread_s > 1e-13 * q)
            return np.where(varies, cov / np.sqrt(spread_f * spread_s), np.nan)

    return solve


def discrete_scores(df: DataFrame, features: list[str] | Made, target: str, era: str = "era", values: tuple[float, ...] = VALUES, levels: list[float] | None = None) -> DataFrame:
    """Rows (era, signal, corr): CORR of every feature by era, over the rows where feature and target are there. Equal to
    scores.powered_correlation over the long form. The target has at most LEVELS values, looked up unless given."""
    values, levels = tuple(sorted(map(float, values))), sorted(levels) if levels is not None else levels_of(df, target)
    tables = value_tables(df, features, [era], values, (target, levels))
    return feature_rows(tables, [era], names_of(features), (1, len(levels), len(values)), corr_of_counts(levels), "signal", "corr")


def aligned_discrete_scores(df: DataFrame, features: list[str] | Made, target: str, era: str = "era", values: tuple[float, ...] = VALUES, levels: list[float] | None = None) -> DataFrame:
    """discrete_scores times the sign of each feature's mean over the eras: a row an era and feature is all that is windowed."""
    per_era = discrete_scores(df, features, target, era, values, levels)
    return per_era.select(era, "signal", (F.col("corr") * F.signum(F.avg("corr").over(W.partitionBy("signal")))).alias("corr"))


def discrete_exposures(df: DataFrame, signal: str, features: list[str] | Made, era: str = "era", values: tuple[float, ...] = VALUES) -> DataFrame:
    """Rows (era, feature, exposure): Pearson of a signal with each feature by era. Equal to scores.exposures up to rounding.
    The signal is shifted by its overall mean first, which leaves the result and keeps digits."""
    values = tuple(sorted(map(float, values)))
    shift = df.agg(F.avg(clean(signal))).first()[0] or 0.0
    centred = clean(signal) - F.lit(shift)
    rows = df.select(era, centred.alias("p_"), (centred * centred).alias("q_"), *(features.inputs if isinstance(features, Made) else features))
    tables = value_tables(rows, features, [era], values, sums=["p_", "q_"])
    return feature_rows(tables, [era], names_of(features), (3, 1, len(values)), exposure_of_sums(values), "feature", "exposure")

"""Sums of products of many columns by group, as packed matrices.

Each task adds up one matrix for each of its groups as Arrow batches pass (Z'Z of the rows' vectors), so rows of a group are
never gathered, the plan does not grow with the number of columns, and what is shuffled is one matrix for a task and group.
The sums are added in a stream, one matrix at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructType

from ..functions.ranking import clean

#: Matrices that a task holds before it passes them on, in bytes.
HELD = 1 << 26
#: Up to so many columns, sums of products are expressions of Spark's own.
FEW = 8


class Sums:
    """What is known of a group: the products of its vectors (columns, constant, y), and the range of y."""

    def __init__(self, size: int):
        self.products, self.low, self.high = np.zeros((size, size)), np.inf, -np.inf

    def add(self, z: np.ndarray) -> None:
        self.products += z.T @ z
        self.low, self.high = min(self.low, z[:, -1].min()), max(self.high, z[:, -1].max())

    def as_bytes(self) -> bytes:
        upper = self.products[np.triu_indices(len(self.products))]
        return np.concatenate(([self.low, self.high], upper)).tobytes()

    def merge(self, a: np.ndarray) -> None:
        upper = np.triu_indices(len(self.products))
        self.low, self.high = min(self.low, a[0]), max(self.high, a[1])
        self.products[upper] += a[2:]
        self.products.T[upper] = self.products[upper]

    @property
    def varies(self) -> bool:
        return self.products[-2, -2] > 1 and self.low < self.high


def native_grams(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """What grams() says, as arrays, from one aggregation: rows stay in the JVM, and the plan grows with the square of the
    columns."""
    n = len(xs) + 2
    rows = df.select(*by, *[F.coalesce(clean(x), F.lit(0.0)).alias(f"z{i}_") for i, x in enumerate(xs)], F.lit(1.0).alias(f"z{n - 2}_"), clean(y).alias(f"z{n - 1}_")).filter(f"z{n - 1}_ is not null")
    sums = [F.sum(F.col(f"z{i}_") * F.col(f"z{j}_")) for i in range(n) for j in range(i, n)]
    return rows.groupBy(*by).agg(F.array(F.min(f"z{n - 1}_"), F.max(f"z{n - 1}_"), *sums).alias("sums_")).filter("sums_[0] is not null")


def grams(df: DataFrame, y: str, xs: list[str], by: list[str], native: bool | None = None) -> DataFrame:
    """Rows (by..., sums_): packed sums of the rows whose y is finite; values of xs that are not finite count as 0. A group
    may have several rows, which fitted() adds up. With native, or up to FEW columns unless told otherwise, native_grams()."""
    if native or native is None and len(xs) <= FEW:
        return native_grams(df, y, xs, by)
    rows = df.select(*by, *[clean(x).alias(f"x{i}_") for i, x in enumerate(xs)], clean(y).alias("y_"))
    schema = StructType([rows.schema[b] for b in by]).add("sums_", BinaryType())
    size, k = len(xs) + 2, len(by)

    def run(batches):
        held: dict[tuple, Sums] = {}

        def flush():
            keys = list(zip(*held, strict=True)) or [()] * k
            types = [b.schema.field(i).type for i in range(k)]
            out = pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(keys, types, strict=True)], pa.array([s.as_bytes() for s in held.values()], pa.binary())], names=[*by, "sums_"])
            held.clear()
            return out

        for b in batches:
            z = np.column_stack([np.nan_to_num(b.column(i).to_numpy(zero_copy_only=False)) for i in range(k, k + len(xs))] + [np.ones(b.num_rows), b.column(k + len(xs)).to_numpy(zero_copy_only=False)])
            named: dict[tuple, int] = {}
            keys = list(zip(*(b.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * b.num_rows
            code = np.fromiter((named.setdefault(g, len(named)) for g in keys), np.int64, len(keys))
            known = np.isfinite(z[:, -1])
            order = np.argsort(code[known], kind="stable")
            z, code = z[known][order], code[known][order]
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else []
            names = list(named)
            for a, e in zip(starts, [*starts[1:], len(code)], strict=True):
                held.setdefault(names[code[a]], Sums(size)).add(z[a:e])
            if len(held) * size * size * 8 > HELD:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def fitted(sums: DataFrame, by: list[str], columns: int, solve: Callable[[Sums], np.ndarray | None]) -> DataFrame:
    """Rows (by..., beta_): what solve says of the sums of each group, from rows of grams()."""
    schema = StructType([sums.schema[b] for b in by]).add("beta_", ArrayType(DoubleType()))
    k = len(by)

    def run(batches):
        now, total, done = None, None, []

        def rows(done):
            keys = list(zip(*(g for g, _ in done), strict=True)) or [()] * k
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(keys, types, strict=True)], pa.array([x for _, x in done], pa.list_(pa.float64()))], names=[*by, "beta_"])

        def close():
            beta = solve(total)
            done.append((now, None if beta is None else beta.tolist()))

        for b in batches:
            types = [b.schema.field(i).type for i in range(k)]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * b.num_rows
            for key, said in zip(keys, b.column(k), strict=True):
                if key != now:
                    if total is not None:
                        close()
                    now, total = key, Sums(columns + 2)
                total.merge(said.values.to_numpy() if pa.types.is_list(said.type) else np.frombuffer(said.as_buffer()))
            if done:
                yield rows(done)
                done = []
        if total is not None:
            close()
            yield rows(done)

    dealt = sums.select(*by, "sums_")
    return (dealt.repartition(*by).sortWithinPartitions(*by) if by else dealt.coalesce(1)).mapInArrow(run, schema)


def least_squares(constant: bool = True, ridge: float = 0.0, rcond: float = 1e-12, varying: bool = True) -> Callable[[Sums], np.ndarray | None]:
    """Coefficients of y on the columns (and a constant, the last one) by pseudo-inverse of the scaled products; with varying,
    none for a group whose y is constant."""

    def solve(s: Sums) -> np.ndarray | None:
        n = len(s.products) - (1 if constant else 2)
        if varying and not s.varies:
            return None
        g = s.products[:n, :n].copy()
        columns = range(len(s.products) - 2)
        g[columns, columns] += ridge
        scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        return np.linalg.pinv(g / np.outer(scale, scale), rcond=rcond, hermitian=True) @ (s.products[:n, -1] / scale) / scale

    return solve


def linear(beta: str, xs: list[str], constant: bool = True):
    """The linear form of a row of coefficients, as one expression over an array of the columns."""
    values = F.array(*[F.coalesce(clean(x), F.lit(0.0)) for x in xs], *([F.lit(1.0)] if constant else []))
    return F.when(F.col(beta).isNotNull(), F.aggregate(F.zip_with(F.col(beta), values, lambda b, x: b * x), F.lit(0.0), lambda a, x: a + x))


#: Partial matrices of a whole table meet in so many tasks before the last one.
MERGED = 64


def masked_products(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Z'Z over all rows for Z = (values, squares, masks) of the columns, where a value that is not finite counts as 0 and its
    mask says so: all sums over the rows that any two columns share. One packed matrix a task is shuffled; they are added in
    two steps, and one matrix, of the columns' number alone, comes back."""
    rows, size = df.select(*columns), 3 * len(columns)
    upper = np.triu_indices(size)

    def packed(total):
        return pa.RecordBatch.from_arrays([pa.array([total[upper].tobytes()], pa.binary())], names=["sums_"])

    def products(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            known = np.isfinite(x)
            x = np.where(known, x, 0.0)
            z = np.hstack((x, x * x, known))
            total += z.T @ z
        yield packed(total)

    def added(batches):
        total = np.zeros(len(upper[0]))
        for b in batches:
            for said in b.column(0):
                total += np.frombuffer(said.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums_"])

    each = rows.mapInArrow(products, "sums_ binary").withColumn("part_", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    some = each.repartition(MERGED, "part_").select("sums_").mapInArrow(added, "sums_ binary")
    got = some.coalesce(1).mapInArrow(added, "sums_ binary").first()
    out = np.zeros((size, size))
    out[upper] = np.frombuffer(got["sums_"])
    out.T[upper] = out[upper]
    return out


def pairwise_correlations(products: np.ndarray) -> np.ndarray:
    """Pearson of each two columns over the rows where both are there, from masked_products(); NaN where either is constant
    there, up to rounding of the sums, or there are no such rows."""
    k = len(products) // 3
    v, q, m = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    n, xy = products[m, m], products[v, v]
    sx, sxx = products[v, m], products[q, m]  # of the row's column, over the rows that the other one has too
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        varies = spread > 1e-13 * sxx
        return np.where(varies & varies.T, (xy - sx * sx.T / n) / np.sqrt(spread * spread.T), np.nan)

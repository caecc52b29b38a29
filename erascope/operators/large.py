"""Ranks within groups that may be too large for a window of one task.

A group of at most ROWS rows is ranked by a window. The values of a larger one are dealt to ranges, and a window holds a range;
what lies below a range comes from counts of ranges. A range of one value needs no window: its rows' rank is known from the
counts, and where all ranges are such, as with signals of few values, no row is moved. Ranges follow the quartiles of a
group, widening away from them, so memory follows the rows of a range and not those of a group; many rows of one value and
others very close to it are the exception. Each range of a group is a row that is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import average_rank, count_in
from ..sources.store import kept

#: Rows of a group that one window holds.
ROWS = 150_000
#: Ranges on either side of a group's median.
RANGES = 256
#: Rows that a task ranks, about.
TASK_ROWS = 400_000
#: One row in so many places the ranges.
PART = 32


class Groups:
    """What is known of the groups of df: means of some columns, and for those of more than about ROWS rows the ranges of the
    columns in xs, whose place and scale are a row a group on the driver. ranges is None where no group is large."""

    def __init__(self, df: DataFrame, xs: list[str], by: list[str], means: list[str] | None = None):
        self.by, self.xs, self.df, self.means, self.ranges = by, xs, df, means or [], None
        # quartiles only place the ranges, and an estimate of rows only says where they are used: any others give the same ranks
        part = df.filter(F.pmod(F.xxhash64(*xs), F.lit(PART)) == 0).groupBy(*by)
        quartiles = [F.percentile_approx(F.when(~F.isnan(x), F.col(x)), [0.25, 0.5, 0.75], 200).alias(f"q{i}") for i, x in enumerate(xs)]
        rows = part.agg((F.count("*") * PART).alias("n_"), *quartiles, *[F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(xs)]).collect()  # a row a group
        self.large = [r for r in rows if r["n_"] > ROWS and all(r[b] is not None for b in by)]
        if self.large:
            self.ranges = self._ranges()
            known = self.ranges.agg(F.sum(F.when(F.col("range_x_") == 0, F.col("range_rows_"))), *[F.sum(F.when((F.col("range_x_") == i) & F.col("range_one_"), F.col("range_rows_"))) for i in range(len(xs))]).first()
            self.all, self.known = known[0], [(k or 0) / known[0] for k in known[1:]]  # shares of rows whose rank the counts tell

    def _own(self, fields: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
        types = {f.name: f.dataType.simpleString() for f in self.df.schema}
        return self.df.sparkSession.createDataFrame(rows, ", ".join(f"`g{i}_` {types[b]}" for i, b in enumerate(self.by)) + "".join(f", {n} {t}" for n, t in fields))

    def _on(self, null_safe: bool = False) -> list[Column]:
        return [F.col(b).eqNullSafe(F.col(f"g{i}_")) if null_safe else F.col(b) == F.col(f"g{i}_") for i, b in enumerate(self.by)]

    def _keys(self) -> list[str]:
        return [f"g{i}_" for i in range(len(self.by))]

    def with_means(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the means of its group."""
        own = self.ranges.filter("range_x_ = 0").groupBy(*self._keys()).agg(*[(F.sum(f"range_s{i}_") / F.sum("range_rows_")).alias(n) for i, n in enumerate(names)])
        return df.join(F.broadcast(own), self._on(null_safe=True)).drop(*self._keys())  # a row a group

    def _places(self, at: int) -> DataFrame:
        def scale(r) -> tuple[float, float]:
            low, middle, high = r[f"q{at}"] or (0.0, 0.0, 0.0)
            finite = lambda v: v is not None and abs(v) < 1e300 and v > 0
            return (middle if abs(middle) < 1e300 else 0.0), next((v for v in ((high - low) / 2, r[f"d{at}"]) if finite(v)), 1.0)

        return self._own([("centre_", "double"), ("width_", "double")], [(*[r[b] for b in self.by], *scale(r)) for r in self.large])

    @staticmethod
    def _range(x: Column) -> Column:
        """The range of a value: rises with it, also in the last digit, since every step is one correctly rounded operation."""
        z = (x - F.col("centre_")) / F.col("width_")
        bent = lambda t: F.floor(F.lit(float(RANGES)) * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + t))).cast("int")
        return F.when(F.isnan(x), RANGES + 1).when(z >= 0, bent(z)).otherwise(-bent(-z) - 1)

    def _ranges(self) -> DataFrame:
        def of(i: int, x: str) -> DataFrame:
            placed = self.df.join(F.broadcast(self._places(i)), self._on(), "left").drop(*self._keys())  # a row a large group
            place = F.when(F.col(x).isNotNull() & F.col("centre_").isNotNull(), self._range(F.col(x)))
            return placed.select(*[F.col(b).alias(g) for b, g in zip(self.by, self._keys(), strict=True)], F.lit(i).alias("range_x_"), place.alias("range_of_"), F.col(x).cast("double").alias("v_"), *[F.col(m).alias(f"m{k}_") for k, m in enumerate(self.means)])

        rows = reduce(DataFrame.unionByName, [of(i, x) for i, x in enumerate(self.xs)]).groupBy(*self._keys(), "range_x_", "range_of_")
        placed = F.col("range_of_").isNotNull()
        rows = rows.agg(F.count("*").alias("range_rows_"), (placed & (F.min("v_") == F.max("v_"))).alias("range_one_"), *[F.sum(f"m{k}_").alias(f"range_s{k}_") for k in range(len(self.means))])
        w, inside = W.partitionBy(*self._keys(), "range_x_"), F.when(placed, F.col("range_rows_"))
        return kept(rows.withColumn("range_below_", F.sum(inside).over(w.orderBy("range_of_")) - F.col("range_rows_")).withColumn("range_all_", F.sum(inside).over(w)), "ranges")

    def ranked(self, df: DataFrame, rank: str, count: str, x: str, key: str | None = None) -> DataFrame:
        """df with the average rank of x in its group and the number of values there; with a key, with places instead of ranks,
        those of equal values in order of key. df has the rows that the groups were made of."""
        value, by = F.col(x), self.by
        place = lambda *at: F.when(value.isNotNull(), F.row_number().over(W.partitionBy(*at).orderBy(value.asc_nulls_last(), F.col(key)))) if key else average_rank(value, *at)
        if self.ranges is None:
            return df.withColumn(rank, place(*by)).withColumn(count, count_in(value, *by))
        at, columns = self.xs.index(x), df.columns
        mine = self.ranges.filter((F.col("range_x_") == at) & F.col("range_of_").isNotNull()).select(*self._keys(), "range_of_", "range_rows_", "range_one_", "range_below_", "range_all_")
        looked_up = lambda d: d.join(F.broadcast(mine), [*self._on(), F.col("range_") == F.col("range_of_")], "left").drop(*self._keys(), "range_of_")  # noqa: E731  a row a range
        rows = df.join(F.broadcast(self._places(at)), self._on(), "left").drop(*self._keys())  # a row a large group
        rows = rows.withColumn("range_", F.when(value.isNotNull() & F.col("centre_").isNotNull(), self._range(value))).drop("centre_", "width_")
        among = F.col("range_below_") + (F.col("range_rows_") + 1) / 2
        if not key and self.known[at] == 1:
            return looked_up(rows).withColumn(rank, F.when(value.isNotNull(), among)).withColumn(count, F.col("range_all_")).select(*columns, rank, count)
        number = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.all // TASK_ROWS + 1)
        parts = [*by, "range_"]
        moved = looked_up(rows.repartition(number, *[F.col(c) for c in parts]))
        return moved.withColumn(rank, F.coalesce(F.col("range_below_"), F.lit(0)) + place(*parts)).withColumn(count, F.coalesce(F.col("range_all_"), count_in(value, *parts))).select(*columns, rank, count)


def has_large(df: DataFrame, by: list[str]) -> bool:
    """Whether a group has more than ROWS rows."""
    return not df.groupBy(*by).agg(F.count("*").alias("n_")).filter(F.col("n_") > ROWS).isEmpty()

"""Mixing sources to target weights by entropy balancing.

Rates r = exp(f . lambda) over the documents, f being a document's group indicators, are the ones closest to 1 in relative
entropy (in words) that meet sum(size * r * f) = target for each group. The dual of that problem is convex; each Newton
iteration is an aggregation over classes of like documents on the executors. balance() takes several families of groups,
whose constraints are coupled through the Hessian; with one family, as in mix(), the Hessian is diagonal, so a step is a
division by group and nothing is gathered on the driver but one number, the largest error.

Rates are rounded into whole copies. Within a group, sizes are taken from large to small; the copies of a size keep the
running sum of words as near to the running target as the bounds floor(r) and ceil(r) of each document allow, so the error
of a group ends at about the size of its smallest documents. Which documents of a size get the extra copy is decided by
a hash of the id, and ranks are taken in hash buckets, so that no window holds a whole group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, table, written

WEIGHTS = (5, 2, 1)
CAP = 3.0
#: Texts of one source and size are ranked in so many windows.
RANK_BUCKETS = 1024
MOST_CONSTRAINTS = 2000
ITERATIONS = 60
TOLERANCE = 1e-9


def word_count(column) -> F.Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: DataFrame, group: str, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows (group, source_size, target) from one row (group, source_size) for each group, null last in code-point order.

    Targets share the sum of all sizes by the repeating weights; one above cap times its size stops there, and what is
    over goes to the rest by weight until none is above. The stopped groups are those with the largest weight to size
    ratios, so one ordered running sum over the groups finds the level. Groups, not documents, are ordered here.
    """
    by_name = W.orderBy(F.col(group).isNull(), F.col(group))
    per = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    upto = W.orderBy((F.col("source_size") / F.col("w_")).asc(), F.col(group).isNull(), F.col(group)).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.col("all_") - F.col("cap_size_")) / F.col("free_w_")
    return (
        sizes.withColumn("w_", per)
        .withColumn("all_", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_size_", F.coalesce(F.sum(F.col("source_size") * F.lit(float(cap))).over(upto), F.lit(0.0)))
        .withColumn("free_w_", F.sum("w_").over(everything) - F.coalesce(F.sum("w_").over(upto), F.lit(0.0)))
        # the first group that is below its cap when those before it have stopped has the highest level
        .withColumn("level_", F.when(level * F.col("w_") <= F.col("source_size") * F.lit(float(cap)), level))
        .withColumn("level_", F.max("level_").over(everything))
        .select(group, F.col("source_size").cast("bigint").alias("source_size"), F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.coalesce(F.col("level_") * F.col("w_"), F.lit(math.inf)), F.col("source_size") * F.lit(float(cap)))).alias("target"))
    )


def balanced_rates(classes: DataFrame, targets: DataFrame, group: str, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (group, source_size, target, rate): Newton on the dual for one family of constraints, over classes (group, size, n).

    The groups of one family are disjoint, so the Hessian is diagonal and its entries are the tilted sums themselves. Each
    iteration aggregates size * n * exp(lambda) over the classes by group and moves lambda by gradient over Hessian, at
    most one unit; the state is a table of one row for each group and never leaves Spark. Groups without words or with a
    target of 0 have rate 0. An error is raised if the constraints are not met after so many iterations.
    """
    mass = classes.select(F.col(group), (F.col("size") * F.col("n")).cast("double").alias("s_"))
    state = written(targets.select(group, "source_size", "target", F.lit(0.0).alias("lambda_"), F.lit(None).cast("double").alias("error_")))
    for _ in range(iterations):
        now = state.select(F.col(group).alias("g2_"), "lambda_")
        tilted = mass.join(now, mass[group].eqNullSafe(now["g2_"])).groupBy("g2_").agg(F.sum(F.col("s_") * F.exp("lambda_")).alias("tilted_"))
        bound = (F.col("tilted_") > 0) & (F.col("target") > 0)
        gradient = F.col("target") - F.col("tilted_")
        step = F.when(bound, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gradient / F.col("tilted_")))).otherwise(0.0)
        moved = state.join(tilted, state[group].eqNullSafe(tilted["g2_"]), "left").select(group, "source_size", "target", (F.col("lambda_") + step).alias("lambda_"), F.when(bound, F.abs(gradient) / F.col("target")).otherwise(0.0).alias("error_"))
        before, state = state, written(moved)
        release(before)
        error = state.select(F.max("error_")).first()[0]
        if error is None or error <= tolerance:
            break
    else:
        raise RuntimeError(f"the mix misses its targets by {error:.1e} after {iterations} iterations")
    return state.select(group, "source_size", "target", F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.exp("lambda_")).otherwise(0.0).alias("rate"))


def balance(docs: DataFrame, families: dict[str, dict], size: str = "size", iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with rate: the rates closest to 1 in relative entropy that meet several families of constraints at once.

    families: {column: {group: target words}}; the targets of each family share one total, and each names all groups with
    words. A rate is exp of the sum of its document's multipliers, one from each family. Documents are summed into classes
    of equal groups once; then each Newton iteration is one aggregation of the tilted classes by pairs of constraints,
    which is the Hessian (its diagonal is the gradient's sum), and one solve on the driver of at most MOST_CONSTRAINTS
    unknowns, with the step halved while the dual grows. Targets that no rates meet, or a group without one, are an error.

    A null group is a group (None); documents of size 0 or null get a rate and weigh nothing; repeated rows each count; a
    table without words has rate 1 throughout, an empty table gives an empty result; a column rate is replaced.
    """
    names, spark = list(families), docs.sparkSession
    index = {(f, g): i for i, (f, g) in enumerate((f, g) for f in names for g in families[f])}
    if len(index) > MOST_CONSTRAINTS:
        raise ValueError(f"{len(index)} constraints, more than {MOST_CONSTRAINTS}")
    target = np.array([float(families[f][g]) for f, g in index])
    totals = [sum(families[f].values()) for f in names]
    if max(totals) - min(totals) > 1e-9 * max(totals):
        raise ValueError(f"the families' targets have unlike totals: {totals}")
    known = spark.createDataFrame([(f, None if g is None else str(g), i) for (f, g), i in index.items()], "f_ string, g_ string, i_ int")
    placed = docs.select(F.struct(*[c for c in docs.columns if c != "rate"]).alias("doc_"))
    for k, f in enumerate(names):
        own = F.broadcast(known.filter(F.col("f_") == f).select(F.col("g_").alias(f"g{k}_"), F.col("i_").alias(f"i{k}_")))  # a row for each group of a family
        placed = placed.join(own, F.col("doc_")[f].cast("string").eqNullSafe(F.col(f"g{k}_")), "left").drop(f"g{k}_")
    at = [f"i{k}_" for k in range(len(names))]
    classes = written(placed.groupBy(*at).agg(F.sum(F.coalesce(F.col("doc_")[size], F.lit(0)).cast("double")).alias("s_")).filter("s_ > 0"))
    if classes.filter(" or ".join(f"{i} is null" for i in at)).limit(1).count():
        raise ValueError("a group with words has no target")
    pairs = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(at) for b in at[i:]]))

    def tilted(multipliers):
        """(dual, gradient, Hessian) at the multipliers, from one job over the classes."""
        of = F.array(*[F.lit(float(x)) for x in multipliers])
        w = F.col("s_") * F.exp(sum((F.get(of, F.col(i)) for i in at), F.lit(0.0)))
        got = classes.select(pairs.alias("p_"), w.alias("w_")).groupBy("p_.a", "p_.b").agg(F.sum("w_").alias("w_")).collect()  # at most a row for each pair of constraints
        h = np.zeros((len(index), len(index)))
        for r in got:
            h[r["a"], r["b"]] = h[r["b"], r["a"]] = r["w_"]
        mass = np.diag(h).copy()
        first = sum(mass[i] for (f, _), i in index.items() if f == names[0])
        return first - target @ multipliers, target - mass, h

    if classes.isEmpty():
        return docs.withColumn("rate", F.lit(1.0))
    multipliers = np.zeros(len(index))
    dual, gradient, hessian = tilted(multipliers)
    for _ in range(iterations):
        if np.all(np.abs(gradient) <= tolerance * np.maximum(target, 1.0)):
            break
        step = np.linalg.pinv(hessian, rcond=1e-12, hermitian=True) @ gradient  # singular: the families share a total
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        while True:
            dual_, gradient_, hessian_ = tilted(multipliers + step)
            if dual_ <= dual + 1e-9 * abs(dual) or np.abs(step).max() < 1e-12:
                break
            step /= 2
        multipliers, dual, gradient, hessian = multipliers + step, dual_, gradient_, hessian_
    else:
        raise RuntimeError(f"the mix misses its targets by {np.abs(gradient).max():.1e} words after {iterations} iterations")
    release(classes)
    of = F.array(*[F.lit(float(x)) for x in multipliers])
    return placed.withColumn("rate", F.exp(sum((F.coalesce(F.get(of, F.col(i)), F.lit(0.0)) for i in at), F.lit(0.0)))).select("doc_.*", "rate")


def _copies_of_sizes(pdf):
    """The copies of each size of one group, large sizes first; pdf has one row for each distinct size."""
    pdf = pdf.sort_values("size", ascending=False)
    copies, due, had = [], 0.0, 0.0
    for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
        near = round(rate)
        low = near if abs(rate - near) < 1e-6 else math.floor(rate)
        high = near if abs(rate - near) < 1e-6 else low + 1
        due += rate * n * size
        c = max(low * n, min(high * n, math.floor((due - had) / size + 0.5))) if size else n
        had += c * size
        copies.append(int(c))
    pdf["copies_"] = copies
    return pdf


def copies_of(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sized (doc_ any, key_ any, g_ string, size bigint) with source_size, target, rate and copies."""
    bucket = F.pmod(F.xxhash64(F.col("key_").cast("string"), F.lit(7)), F.lit(RANK_BUCKETS)).cast("int")
    sized = sized.select("doc_", "key_", F.coalesce(F.concat(F.lit("s"), F.col("g_")), F.lit("n")).alias("gk_"), "g_", "size", bucket.alias("b_"))
    # counts of (group, size, bucket): every later sum and rank starts from here
    cells = written(sized.groupBy("gk_", "g_", "size", "b_").agg(F.count("*").alias("n")))
    classes = written(cells.groupBy("gk_", "g_", "size").agg(F.sum("n").alias("n")))
    totals = classes.groupBy("g_").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rates = written(balanced_rates(classes, capped_targets(totals, "g_", weights, cap), "g_"))
    rates = rates.select(F.coalesce(F.concat(F.lit("s"), F.col("g_")), F.lit("n")).alias("gk_"), "source_size", "target", "rate")
    # one group's distinct sizes are at most as many as the words of its longest document
    planned = classes.select("gk_", "size", "n").join(rates, "gk_").groupBy("gk_").applyInPandas(_copies_of_sizes, "gk_ string, size bigint, n bigint, source_size bigint, target double, rate double, copies_ bigint")
    # documents of a (group, size) are ranked by bucket, then by hash inside it; the first (copies mod n) get one more
    before = F.coalesce(F.sum("n").over(W.partitionBy("gk_", "size").orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = cells.select("gk_", "size", "b_", before.alias("before_")).join(planned.withColumnRenamed("n", "k_"), ["gk_", "size"])
    rank = F.row_number().over(W.partitionBy("gk_", "size", "b_").orderBy(F.xxhash64(F.col("key_").cast("string")), F.col("key_")))
    copies = F.floor(F.col("copies_") / F.col("k_")) + (F.col("before_") + F.col("rank_") <= F.col("copies_") % F.col("k_")).cast("bigint")
    return sized.withColumn("rank_", rank).join(plan, ["gk_", "size", "b_"]).select("doc_", "size", "source_size", "target", "rate", copies.cast("bigint").alias("copies"))


def mix(docs: DataFrame, group: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document, whole).

    Null texts have size 0 and are taken once at no cost. A null group is a group of its own, the last. A null key is
    hashed like any other value; repeated rows are documents of their own. Very long texts are counted whole. An empty
    table gives an empty result. Columns of docs by the names of the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    sized = docs.select(F.struct(*keep).alias("doc_"), F.col(key).alias("key_"), F.col(group).cast("string").alias("g_"), word_count(F.col(text)).alias("size"))
    return copies_of(sized, weights, cap).select("doc_.*", "size", "source_size", "target", "rate", "copies")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    # the texts are read once, for their sizes; ranks and copies need no more
    sized = written(docs.select(F.struct("doc_id").alias("doc_"), F.col("doc_id").alias("key_"), F.col("source").alias("g_"), word_count(F.col("text")).alias("size")))
    return copies_of(sized).select("doc_.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")

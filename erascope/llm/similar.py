"""Near-duplicate documents by word-shingle similarity: the SimHash grid first, then an exact prefix join for the rest.

Links of a few bits find copies that hardly differ: the grid join of simhash.links() names them over the fingerprints of
distinct shingles. A resemblance of SIMILARITY on shingles of five words shows as up to 13 of 64 bits, which no choice of
agreeing segments reaches, so the pairs across the components so far come from a prefix join, which misses none. Each set
of n shingles is put in one order for all documents, rare shingles first, and entered under its first
n - SIMILARITY * n + 1; two sets that resemble by SIMILARITY share an entry, and at their first common one each has enough
shingles left for the overlap that they need. Pairs that have not are dropped in the cell. The order comes from counts in a
sample of the documents, and from counts over the whole table: a shingle that the sample does not know but CROWD
documents of unlike groups have is moved behind all rarer ones, and the documents that it leads are entered once more. So a family that resembles too little for
a link is led by what tells its members apart, however small its share of the corpus, and names few pairs. The order decides
how many pairs are named, never which links are found.

The prefix join runs twice. First each document of a cell outside the cell's largest group meets one document of that group,
which joins most families; then all pairs that are still apart meet. All named pairs are verified exactly on their whole
texts' shingle sets, so the links connect what brute force connects, and no pair below SIMILARITY is linked (but for
collisions of 64-bit shingle hashes). Only equal sets merge unseen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import byte_texts, per_batch, release, written
from .fingerprints import Sketcher
from .simhash import components

WORDS = 5
SIMILARITY = 0.8
#: Cells of more rows are dealt out in parts.
CELL = 16384
#: Shingles of about so many documents are counted for the order of the prefix join; the most frequent are told apart.
SAMPLE = 1 << 14
FREQUENT = 200_000
#: Documents of unlike groups from which a shingle is moved behind rarer ones.
CROWD = 32
#: Ids up to this many are sent to every task; beyond, they are joined.
FEW_IDS = 1_000_000
#: Pairs that a task holds before it hands them on.
PAIRS = 100_000


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles; of none, zero."""
    return simhash.majority(hashes) if len(hashes) else 0


def _set_name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set, as two signed numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8").tolist()
    return a, b


def prefix_length(n: int, similarity: float) -> int:
    """How many of n ordered shingles a set enters: one more than it can lack of an overlap that any link needs."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _across(batches, similarity: float, whole: bool = True):
    """Pairs of ids of unlike groups within the cells of rows sorted by cell, if enough of both sets is left after it.

    The rows outside a cell's largest group meet all others or, unless whole, one of that group. rest is the number of a
    set's ordered shingles from the cell's on.
    """
    share = similarity / (1 + similarity)
    kept = None

    def handed_on(left, right):
        x, y = np.concatenate(left), np.concatenate(right)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def pairs(cell, id_, group, n, rest):
        starts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
        size = np.diff(starts)
        left, right, held = [], [], 0

        def linkable(i, j):
            return (group[i] != group[j]) & (np.minimum(rest[i], rest[j]) >= share * (n[i] + n[j]) - 1e-6)

        for s in np.unique(size[(size > 1) & (size <= 4)]):
            base = starts[:-1][size == s]
            for i in range(s):
                for j in range(i + 1, s):
                    ok = linkable(base + i, base + j)
                    left.append(id_[base[ok] + i])
                    right.append(id_[base[ok] + j])
        for k in np.flatnonzero(size > 4):
            at = np.arange(starts[k], starts[k + 1])
            names, of, count = np.unique(group[at], return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            outside, top = at[of != count.argmax()], at[of == count.argmax()]
            for i in outside:
                j = at[linkable(np.full(1, i), at)] if whole else top[linkable(np.full(1, i), top)][:1]
                left.append(np.full(len(j), id_[i]))
                right.append(id_[j])
                held += len(j)
                if held > PAIRS:
                    yield handed_on(left, right)
                    left, right, held = [], [], 0
        if left:
            yield handed_on(left, right)

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "id", "group", "n", "rest")]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        kept = [x[cut:] for x in cols]
        if cut:
            yield from pairs(*(x[:cut] for x in cols))
    if kept is not None:
        yield from pairs(*kept)


def _frequent(docs: DataFrame, text: str, key: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles of most documents in a sample, by hash; at most FREQUENT."""
    step = max(1, docs.count() // SAMPLE)

    def run(batches):
        sketcher = Sketcher(words)
        for b in batches:
            sets = [np.unique(sketcher.shingles(t)) for t in byte_texts(b, text)]
            yield {"s": np.concatenate(sets).view(np.int64) if sets else []}

    some = docs.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(text)
    counts = written(per_batch(some, run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"))
    least, held = 2, 0
    for n, m in sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True):
        held += m
        if held > FREQUENT:
            least = n + 1
            break
    got = counts.filter(F.col("n") >= least).toPandas()  # at most FREQUENT rows
    hashes, n = got["s"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float, crowded: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set by count in the sample, then hash; crowded ones, in order, come behind those that the
    sample does not know and before those that it does, whose counts are 2 or more."""
    names, counts = frequent
    count = np.zeros(len(hashes), np.int64)
    if crowded is not None and len(crowded):
        at = np.minimum(np.searchsorted(crowded, hashes), len(crowded) - 1)
        count = (crowded[at] == hashes).astype(np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        count = np.where(names[at] == hashes, counts[at], count)
    return hashes[np.argsort(count, kind="stable")[: prefix_length(len(hashes), similarity)]].view(np.int64)


def _chosen(docs: DataFrame, ids: DataFrame, key: str, keep: bool) -> DataFrame:
    """docs whose key is (not) among ids, a table of distinct keys that are not null: by broadcast if these are few."""
    side = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return docs.join(side, key, "left_semi" if keep else "left_anti")


def _some(df: DataFrame, cell: int) -> tuple[DataFrame, int]:
    """(the rows of one id in so many, that number): enough to estimate the rows of a cell of that size."""
    step = max(1, cell // 1024)
    return df.filter(F.pmod(F.xxhash64("id", F.lit("some")), F.lit(step)) == 0), step


def across_cells(grouped: DataFrame, cell: int = CELL) -> DataFrame:
    """grouped with the rows of large cells dealt to cells of their parts, such that all pairs of unlike groups still meet.

    The rows of the group that has most of a cell are dealt to parts, the others to parts of theirs; every part of the
    one meets every part of the other, and the others' parts meet two by two.
    """
    some, step = _some(grouped, cell)
    half = max(1, cell // 2)
    by = some.groupBy("cell", "group").agg((F.count("*") * step).alias("m_")).groupBy("cell").agg(F.sum("m_").alias("m_"), F.max(F.struct("m_", "group")).alias("top_"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    large = written(by.filter(F.col("m_") > cell).select("cell", F.col("top_.group").alias("top_"), parts(F.col("top_.m_")).alias("p_"), parts(F.col("m_") - F.col("top_.m_")).alias("q_")))
    if large.isEmpty():
        return grouped
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    top = F.transform(all_("q_"), lambda o: F.xxhash64("cell", F.lit("top"), mine("p_"), o))
    rest = F.concat(
        F.transform(all_("p_"), lambda o: F.xxhash64("cell", F.lit("top"), o, mine("q_"))),
        F.transform(F.filter(all_("q_"), lambda o: o != mine("q_")), lambda o: F.xxhash64("cell", F.lit("rest"), F.least(o, mine("q_")), F.greatest(o, mine("q_")))),
    )
    to = F.when(F.col("p_").isNull(), F.array("cell")).when(F.col("group") == F.col("top_"), top).otherwise(rest)
    return grouped.join(F.broadcast(large), "cell", "left").withColumn("to_", to).select(F.explode("to_").alias("cell"), "id", "group", "n", "rest")


def _uncrowded(firsts: DataFrame, parts: DataFrame, docs: DataFrame, text: str, key: str, frequent, words: int, similarity: float, crowd: int) -> DataFrame:
    """firsts (key, n_, prefix_) with new prefixes for the rows that crowded shingles lead. Crowded are those that lead so many
    documents of unlike groups (of each group its first counts), and those that so many of these documents hold. In one order
    for all: a row that no crowded shingle leads keeps its prefix, since these only move back."""

    def unknown(counted: DataFrame) -> DataFrame:
        def run(batches):
            names = frequent.value[0]
            for b in batches:
                c = b.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(names, c.view(np.uint64)), max(0, len(names) - 1))
                yield {"cell": c[names[at] != c.view(np.uint64)] if len(names) else c}

        return written(per_batch(counted.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= crowd).select("cell"), run, "cell bigint"))

    def led_by(rows: DataFrame, cells: DataFrame) -> DataFrame:
        side = F.broadcast(cells) if cells.count() <= FEW_IDS else cells
        return written(rows.select(key, F.explode("prefix_").alias("cell")).join(side, "cell", "left_semi").select(key).distinct())

    def each(batches):
        sketcher = Sketcher(words)
        for b in batches:
            sets = [np.unique(sketcher.shingles(t)).view(np.int64) for t in byte_texts(b, text)]
            yield {"cell": np.concatenate(sets) if sets else []}

    heads = _chosen(firsts, parts.filter("id <> group").select(F.col("id").alias(key)), key, False)
    leading = unknown(heads.select(F.explode("prefix_").alias("cell")))
    if leading.isEmpty():
        return firsts
    leaders = led_by(heads, leading)
    held = unknown(per_batch(_chosen(docs.select(key, text), leaders, key, True), each, "cell bigint"))
    crowded = written(leading.unionByName(held).distinct())
    many, led = crowded.count(), led_by(firsts, crowded)
    release(leading, leaders, held)
    mine = _chosen(docs.select(key, text), led, key, True)
    if many <= FEW_IDS:
        known = firsts.sparkSession.sparkContext.broadcast(np.sort(crowded.toPandas()["cell"].to_numpy(np.int64).view(np.uint64)))  # at most FEW_IDS

        def again(batches):
            sketcher = Sketcher(words)
            for b in batches:
                sets = [np.unique(sketcher.shingles(t)) for t in byte_texts(b, text)]
                yield {key: b.column(key), "n_": [len(s) for s in sets], "prefix_": [_prefix(s, frequent.value, similarity, known.value) for s in sets]}

        new = per_batch(mine, again, f"`{key}` bigint, n_ bigint, prefix_ array<bigint>")
    else:  # each document meets its own crowded shingles in a join

        def sets(batches):
            sketcher = Sketcher(words)
            for b in batches:
                yield {key: b.column(key), "s": [np.unique(sketcher.shingles(t)).view(np.int64) for t in byte_texts(b, text)]}

        def placed(batches):
            for b in batches:
                yield {key: b.column(key), "n_": [len(s) for s in b.column("s").to_pylist()], "prefix_": [_prefix(np.array(s, np.int64).view(np.uint64), frequent.value, similarity, np.sort(np.array(c, np.int64).view(np.uint64))) for s, c in zip(b.column("s").to_pylist(), b.column("c").to_pylist(), strict=True)]}

        whole = written(per_batch(mine, sets, f"`{key}` bigint, s array<bigint>").withColumn("row_", F.monotonically_increasing_id()))
        own = whole.select("row_", F.explode("s").alias("cell")).join(crowded, "cell").groupBy("row_").agg(F.collect_list("cell").alias("c"))  # at most a document's shingles
        both = whole.join(own, "row_", "left").select(key, "s", F.coalesce("c", F.expr("cast(array() as array<bigint>)")).alias("c"))
        new = per_batch(both, placed, f"`{key}` bigint, n_ bigint, prefix_ array<bigint>")
    return written(_chosen(firsts, led, key, False).select(key, "n_", "prefix_").unionByName(new))


def _named(firsts: DataFrame, parts: DataFrame, key: str, similarity: float, cell: int, whole: bool) -> DataFrame:
    """Distinct pairs (a, b) of unlike groups that share an entry and may be links; see _across()."""
    entries = firsts.select(F.col(key).alias("id"), F.col("n_").alias("n"), F.posexplode("prefix_").alias("at", "cell")).select("cell", "id", "n", (F.col("n") - F.col("at")).alias("rest"))
    grouped = entries.join(parts, "id", "left").select("cell", "id", F.coalesce("group", "id").alias("group"), "n", "rest")
    dealt = across_cells(grouped, cell).repartition("cell").sortWithinPartitions("cell", "id")

    def across(batches):
        yield from _across(batches, similarity, whole)

    return dealt.mapInArrow(across, "a bigint, b bigint").distinct()


def similar_links(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(representatives (key, least): each document with the smallest key of its shingle set; verified links (a, b) among
    those smallest keys, enough to connect all that are linked). Rows with a null key are left out."""
    docs = docs.filter(F.col(key).isNotNull())
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, key, words))

    def prints(batches):
        sketcher = Sketcher(words)
        for b in batches:
            sets = [np.unique(sketcher.shingles(t)) for t in byte_texts(b, text)]
            names = [_set_name(s) for s in sets]
            yield {key: b.column(key), "fp": [fingerprint_of(s) for s in sets], "sa": [x for x, _ in names], "sb": [x for _, x in names], "n_": [len(s) for s in sets], "prefix_": [_prefix(s, frequent.value, similarity) for s in sets]}
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    found = written(per_batch(docs.select(key, text), prints, f"`{key}` bigint, fp bigint, sa bigint, sb bigint, n_ bigint, prefix_ array<bigint>"))
    distinct = written(found.groupBy("sa", "sb").agg(F.min(key).alias("id"), F.first("fp").alias("fp")))
    least = found.join(distinct.select("sa", "sb", F.col("id").alias("least")), ["sa", "sb"]).select(key, "least")

    # the grid: fingerprints at a few bits, and unlike sets of one fingerprint
    heads = written(distinct.groupBy("fp").agg(F.min("id").alias("head")))
    near = simhash.links(heads.select("fp"), cell=cell)
    of = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}h"))
    pairs = near.join(of("a"), "a").join(of("b"), "b").select(F.least("ah", "bh").alias("a"), F.greatest("ah", "bh").alias("b"))
    pairs = written(pairs.unionByName(distinct.join(heads, "fp").filter(F.col("id") != F.col("head")).select(F.col("head").alias("a"), F.col("id").alias("b"))))
    once = found.select(key).distinct().count() == found.count()

    def sets(batches):
        sketcher = Sketcher(words)
        for b in batches:
            yield {"id": b.column(key), "s": [np.unique(sketcher.shingles(t)).view(np.int64) for t in byte_texts(b, text)]}
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
        rows = per_batch(_chosen(docs.select(key, text), ids, key, True), sets, "id bigint, s array<bigint>")
        # of repeated rows one; texts that share a key each count
        out = written(rows if once else rows.groupBy("id", F.xxhash64("s")).agg(F.first("s").alias("s")).select("id", "s"))
        release(ids)
        return out

    common = F.size(F.array_intersect("sa", "sb"))

    def verified(some: DataFrame, shingles: DataFrame) -> DataFrame:
        x, y = shingles.select(F.col("id").alias("a"), F.col("s").alias("sa")), shingles.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = some.join(x, "a").join(y, "b").select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
        return written(both.filter(F.col("c") >= F.lit(similarity) * (F.col("n") - F.col("c"))).select("a", "b").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        # each document's pair with the least other first; then only pairs that would join what these links have not joined
        shingles, tried = sets_of(pairs), written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        first = verified(tried, shingles)
        parts = written(components(first))
        of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}c"))
        apart = written(pairs.join(tried, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b"))
        second = verified(apart, shingles)
        out = written(first.unionByName(second))
        release(shingles, tried, first, parts, apart, second)
        return out

    joined = linked(pairs)
    release(heads, pairs)
    named = None

    # what these links leave apart, by the prefix join: by one document of each cell's largest group, then by all
    firsts = written(_chosen(found.select(key, "n_", "prefix_"), distinct.select(F.col("id").alias(key)).distinct(), key, True))
    groups = lambda: written(components(joined)).select(F.col("node").alias("id"), F.col("component").alias("group"))
    parts = groups()
    firsts = _uncrowded(firsts, parts, docs, text, key, frequent, words, similarity, CROWD)
    for whole in (False, True):
        parts = groups() if whole else parts
        pairs = _named(firsts, parts, key, similarity, cell, whole)
        named = written(pairs if named is None else pairs.join(named, ["a", "b"], "left_anti"))
        joined = written(joined.unionByName(linked(named)))
    release(firsts)
    return least, joined


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, that of the smallest key, left of each group of near copies; all columns stay.

    Null and empty texts are equal to each other. Rows of equal keys stay or go together; rows with a null key stay. An
    empty table gives an empty result.
    """
    least, links = similar_links(docs, text, key, words, similarity)
    parts = components(links).withColumnRenamed("node", "least")
    gone = written(least.join(parts, "least", "left").filter(F.coalesce("component", "least") < F.col(key)).select(key).distinct())
    return _chosen(docs, gone, key, False).select(*docs.columns)

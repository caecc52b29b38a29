"""SimHash near-duplicates, found by a grid join on segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and the bit counts of its segments are its place in a grid.
The Manhattan distance between two places never exceeds the Hamming distance of the fingerprints, so links at RADIUS bits
or fewer lie among the places at most RADIUS apart. The range join uses that: the segments are dealt to BLOCKS blocks,
and two places at most RADIUS apart agree in at least BLOCKS - RADIUS whole blocks, so each fingerprint is entered under
the cells of every choice of that many blocks, and only fingerprints of one cell meet. Their Manhattan distance is tested
first, then their Hamming distance.

Wider segments bound less tightly: at eight bits the cells of real texts hold so many fingerprints that candidates grow
with the square of the input; at two bits a cell of three blocks in seven holds about one in a million.

Only distinct fingerprints enter the join, so exact copies cost nothing. A cell's fingerprints are searched breadth-first
from the not yet reached, which gives a spanning forest of the cell's links and never all its pairs. The forests of all
cells have the same connected components as all links.

A cell of more than CELL fingerprints is cut by the same rule once more: the segments are dealt to FINE further blocks, of
which links agree in FINE - RADIUS, so each of its fingerprints goes to 70 smaller cells. Fingerprints that still share one
agree in some 45 bits and are at most 2 ** 19; such a cell is dealt out as all pairs of its parts of CELL / 2. So a task
holds CELL fingerprints at most, and what a fingerprint is entered under does not grow with the table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, per_batch, release, table, written

RADIUS = 4
BLOCKS = 7
FINE = 8
CELL = 16384
SEED = 42
_ODD = 0x5555555555555555


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of the word shingles of a UTF-8 text, as a signed 64-bit number; of no words, zero."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest, seed = xxhash.xxh64_intdigest, SEED
        h = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64, len(w) - words + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4) -> DataFrame:
    """Rows (key, fp), one for each row of docs; null texts are empty."""

    def run(batches):
        for b in batches:
            yield {key: b.column(key), "fp": [fingerprint(t, words) for t in byte_texts(b, text)]}

    return per_batch(docs.select(key, text), run, f"`{key}` bigint, fp bigint")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Signed masks over the fingerprint's segments, one for each choice of blocks that must agree."""
    return _masks([sum(3 << (2 * s) for s in range(32) if s * blocks // 32 == b) for b in range(blocks)], radius)


def fine_masks(blocks: int = FINE, radius: int = RADIUS) -> list[int]:
    """The same for blocks that take every so manieth segment, so that they cut those of block_masks."""
    return _masks([sum(3 << (2 * s) for s in range(32) if s % blocks == b) for b in range(blocks)], radius)


def _masks(dealt: list[int], radius: int) -> list[int]:
    masks = [sum(c) for c in combinations(dealt, len(dealt) - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the 32 segments of the difference of bit counts, from packed counts (two bits for each segment).

    A difference of two-bit counts is 0, 1 or 2; both are turned to the unary codes 0, 1, 11, whose Hamming distance it is.
    """
    odd = np.uint64(_ODD)
    high = lambda c: (c >> np.uint64(1)) & odd  # noqa: E731  count is 2
    some = lambda c: (c | (c >> np.uint64(1))) & odd  # noqa: E731  count is 1 or 2
    return np.bitwise_count(high(a) ^ high(b)).astype(np.int64) + np.bitwise_count(some(a) ^ some(b))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed in the same places."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(_ODD))


def _close(a, b, ca, cb, radius):
    """Which pairs are links: first the bound, then the exact distance."""
    out = manhattan(ca, cb) <= radius
    at, a = np.flatnonzero(out), np.broadcast_to(a, b.shape)
    out[at] = np.bitwise_count(a[at] ^ b[at]) <= radius
    return out


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    counts = segment_counts(fps)
    left = np.arange(len(fps))
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = _close(fps[u], fps[left], counts[u], counts[left], radius)
            if hit.any():
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), u))
                b.append(found)
                queue.extend(found.tolist())
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _search(batches, radius):
    """Edges within the runs of equal (t, cell, part) in sorted batches; a run may go on in the next batch."""
    kept: tuple | None = None

    def edges(t, cell, part, fp):
        new = np.flatnonzero((t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate(([0], new, [len(t)]))
        size = np.diff(starts)
        u = fp.view(np.uint64)
        out_a, out_b = [], []
        for s in np.unique(size[(size > 1) & (size <= 8)]):  # many small cells at once
            base = starts[:-1][size == s]
            for i in range(s):
                for j in range(i + 1, s):
                    a, b = u[base + i], u[base + j]
                    ok = _close(a, b, segment_counts(a), segment_counts(b), radius)
                    out_a.append(a[ok])
                    out_b.append(b[ok])
        for k in np.flatnonzero(size > 8):
            own = np.unique(u[starts[k] : starts[k + 1]])
            a, b = forest(own, radius)
            out_a.append(own[a])
            out_b.append(own[b])
        if out_a:
            a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([low, high], axis=1), axis=0)
            return {"a": pairs[:, 0], "b": pairs[:, 1]}
        return None

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("t", "cell", "part", "fp")]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        t, cell, part, _ = cols
        last = np.flatnonzero((t != t[-1]) | (cell != cell[-1]) | (part != part[-1]))
        cut = last[-1] + 1 if len(last) else 0
        kept = tuple(x[cut:] for x in cols)
        if cut:
            yield edges(*(x[:cut] for x in cols))
    if kept is not None and len(kept[0]):
        yield edges(*kept)


def _apart(entered: DataFrame, cell: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of cells of at most so many, rows of larger ones with the number p_ of their parts; None if there are none)."""
    half = max(1, cell // 2)
    large = entered.groupBy("t", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
    large = written(large.select("t", "cell", F.ceil(F.col("n") / half).cast("int").alias("p_")))
    if large.isEmpty():
        return entered, None
    joined = entered.join(large, ["t", "cell"], "left")
    return joined.filter(F.col("p_").isNull()), joined.filter(F.col("p_").isNotNull())


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Links (a, b), a < b, with the connected components of all links among the distinct fingerprints (fp) given."""
    half = F.shiftrightunsigned("fp", 1)
    counts = F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(F.lit(_ODD)), 1).bitwiseOR(F.col("fp").bitwiseXOR(half).bitwiseAND(F.lit(_ODD)))
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, radius)])
    entered = written(distinct.select("fp", counts.alias("c_"), F.posexplode(masks).alias("t", "m_")).select("fp", F.col("t").cast("int"), F.col("c_").bitwiseAND(F.col("m_")).alias("cell")))
    small, large = _apart(entered, cell)
    dealt = small.select("t", "cell", F.lit(0).alias("part"), "fp")
    if large is not None:
        fine = F.array(*[F.lit(m) for m in fine_masks(radius=radius)])
        finer = written(large.withColumn("c_", counts).select("fp", "t", "cell", "c_", F.posexplode(fine).alias("f_", "m_")).select("fp", F.col("t"), F.xxhash64("t", "cell", "f_", F.col("c_").bitwiseAND(F.col("m_"))).alias("cell")))
        small, large = _apart(finer, cell)
        dealt = dealt.unionByName(small.select("t", "cell", F.lit(0).alias("part"), "fp"))
        if large is not None:  # parts of half the size meet two by two
            mine = F.pmod(F.xxhash64("fp"), F.col("p_")).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), F.col("p_") - 1), lambda o: F.least(o, F.col("mine_")) * F.col("p_") + F.greatest(o, F.col("mine_")))
            dealt = dealt.unionByName(large.withColumn("mine_", mine).select("t", "cell", F.explode(pairs).alias("part"), "fp"))
    dealt = dealt.repartition("t", "cell", "part").sortWithinPartitions("t", "cell", "part")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for out in _search(batches, radius):
            if out is not None and len(out["a"]):
                yield pa.RecordBatch.from_arrays([pa.array(out["a"]), pa.array(out["b"])], schema=schema)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), v < u, are stars: no node with an edge to a smaller one has any other edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up_")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up_")))
    return ends.groupBy("node").agg(F.sum("up_").alias("up_"), F.count("*").alias("n_")).filter("up_ > 0 and n_ > 1").count() == 0


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for all nodes of the edges (a, b).

    Large-star and small-star in turn until the edges are stars around the least nodes, O(log^2) rounds; each is an aggregation to the smallest
    neighbour and a join back on the node, in which Spark can split a node of very many neighbours. Each round is written,
    which cuts the lineage. Edges that have not settled after max_rounds are an error, never a partial result.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    rounds = 0
    while not _settled(edges):
        if rounds == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each larger neighbour of u is joined to u's least
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        # each smaller neighbour of u, and u, are joined to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, edges = edges, written(small)
        release(before, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, radius: int = RADIUS) -> DataFrame:
    """Rows (key, fp, component_id), one for each row of docs; component_id is the smallest key reachable.

    Null and empty texts have fingerprint
    zero and link like any other; repeated rows and equal texts share a fingerprint and so a component. A null key is
    never the smallest; a component of null keys alone has a null id. An empty table gives an empty result. Other columns
    of docs are not read.
    """
    prints = written(fingerprints(docs, text, key, words))
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least_")))
    found = written(links(distinct.select("fp"), radius))
    parts = written(components(found))
    of = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least_", F.coalesce("component", "fp").alias("c_"))
    # components are many and small as a rule; one that is not is summed on the map side first
    ids = of.groupBy("c_").agg(F.min("least_").alias("component_id"))
    of = of.join(ids, "c_").select("fp", "component_id")
    return prints.join(of, "fp").select(key, "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id that its links reach."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

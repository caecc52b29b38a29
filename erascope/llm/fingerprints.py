"""Document fingerprints: every shingle hash below a fixed fraction of the hash space.

The sketch of a text holds the hashes of its word shingles (35 bits) that are below 1/FRACTION of all, and no others, so
sketches of any two texts can be merged or compared by sets alone: the share of one in the other estimates containment,
however unequal the texts. A text with shingles but none below the threshold is held by its least hash, marked as such;
merging drops that mark when the other sketch has hashes.
"""

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, small_batches, table

SHINGLE = 5
FRACTION = 8
BITS = 32 + FRACTION.bit_length() - 1
MEMO = 400_000
#: A bucket of the order holds about so many documents, unless there would be more than BUCKETS of them.
BUCKET_ROWS = 4096
BUCKETS = 20_000


class Sketcher:
    """Sketches texts; word hashes are remembered, up to MEMO of them."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.words = shingle, {}
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(shingle)]

    def _word(self, w: bytes) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            h = self.words[w] = xxhash.xxh64_intdigest(w, 0)
        return h

    def shingles(self, text: bytes) -> np.ndarray:
        """64-bit hashes of the shingles of a UTF-8 text in order; fewer words than a shingle are one."""
        w = text.translate(LOWER).split()
        if not w:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self._word, w), np.uint64, len(w))
        k = min(self.shingle, len(h))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            x = np.full(n, k, np.uint64)
            for i in range(k):
                x += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(31))) * self.powers[i]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        return x

    def hashes(self, text: str) -> np.ndarray:
        """Distinct hashes of the text's shingles, of BITS bits, ascending."""
        return np.unique(self.shingles(text.encode("utf-8", "surrogatepass")) >> np.uint64(64 - BITS))

    def sketch(self, text: str) -> np.ndarray:
        """Hashes below the threshold; where there is none, the least one, which is above."""
        h = self.hashes(text)
        low = h[: np.searchsorted(h, np.uint64(1 << 32))]
        return low if len(low) or not len(h) else h[:1]


def as_text(sketch: np.ndarray) -> str:
    """Eight hex digits for each hash, or a mark and the least hash."""
    if len(sketch) == 1 and sketch[0] >= 1 << 32:
        return f"m{int(sketch[0]):x}"
    return sketch.astype(">u4").tobytes().hex()


def from_text(said: str) -> np.ndarray:
    if said.startswith("m"):
        return np.array([int(said[1:], 16)], np.uint64)
    return np.frombuffer(bytes.fromhex(said), ">u4").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of the shingles of two texts."""
    both = np.union1d(a, b)
    low = both[both < 1 << 32]
    return low if len(low) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance: common hashes over all; 1 for two texts without words."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def with_next(docs: DataFrame, fn, schema: str, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """fn over an iterator of (key, text, next text), documents in descending order of key, the first following the last.

    Documents are dealt once, to buckets between quantiles of the key, a task each; the head of each bucket, one row, is
    sent to the bucket before it as well. Rows of equal keys go by a hash of the text, then the text; null keys come last.
    A key of several buckets' rows, and null keys, are dealt to parts by ranges of that hash; equal texts of a key stay together.
    """
    spark = docs.sparkSession
    hash_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    ids = docs.select(F.col(key).cast("bigint").alias("k_"))
    total, known = ids.agg(F.count("*"), F.count("k_")).first()
    n = buckets or min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS)))
    cuts = ids.approxQuantile("k_", [i / n for i in range(1, n)], max(0.2 / n, 1e-4)) if n > 1 else []
    cuts = [min(math.floor(x), (1 << 63) - 1) for x in cuts]
    often = {k: m for k, m in Counter(cuts).items() if m > 1 and k > -(1 << 63)}  # these get a bucket of their own
    splits = sorted({*cuts, *(k - 1 for k in often)})
    parts = [1] * (len(splits) + 1) + [max(1, -(-(total - known) * n // max(1, total)))]
    for k, m in often.items():
        parts[len(splits) - bisect_left(splits, k)] = m + 1
    firsts, dealt_on = list(accumulate(parts, initial=0)), max(parts) > 1
    # how many splits are below the key, from every so manieth one first
    step = max(1, math.isqrt(len(splits)))
    below = lambda some: F.size(F.filter(some, lambda s: s < F.col("k_")))
    literal = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")
    coarse = F.greatest((below(literal(splits[::step])) - 1) * step, F.lit(0))
    place = F.lit(len(splits)) - (coarse + below(F.slice(literal(splits), coarse + 1, F.lit(step))))
    bucket = F.when(F.col("k_").isNull(), len(splits) + 1).otherwise(place).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        """rows (k_, h_, ...) with the number b_ of their bucket."""
        rows = rows.withColumn("b_", bucket)
        if not dealt_on:
            return rows
        part = F.shiftright((F.shiftright("h_", 32) + F.lit(1 << 31)) * F.element_at(literal(parts), F.col("b_") + 1), 32)
        return rows.withColumn("b_", (F.element_at(literal(firsts), F.col("b_") + 1) + part).cast("int"))

    keys = docs.select(F.col(key).cast("bigint").alias("k_"), (hash_ if dealt_on else F.lit(None).cast("bigint")).alias("h_"))
    dealt = placed(docs.select(F.col(key).cast("bigint").alias("k_"), hash_.alias("h_"), F.coalesce(F.col(text), F.lit("")).alias("t_")))
    heads = {r["b_"]: (r["m_"], r["h_"]) for r in placed(keys).groupBy("b_").agg(F.max("k_").alias("m_"), F.min("h_").alias("h_")).collect()}  # one row for each bucket
    order = sorted(heads)
    of_a_part = {f + i for f, m in zip(firsts, parts) if m > 1 for i in range(m)}  # noqa: B905  firsts ends with their number
    before = [(heads[b][0], heads[b][1] if b in of_a_part else None, b, order[i - 1]) for i, b in enumerate(order)]  # the head of the first bucket follows the last
    named = F.broadcast(spark.createDataFrame(before, "head_ bigint, least_ bigint, own_ int, to_ int"))  # one row for each bucket
    first = F.min(F.struct("h_", F.col("t_").alias("t"))).alias("f_")
    leads = (F.col("b_") == F.col("own_")) & F.col("k_").eqNullSafe(F.col("head_")) & (F.col("least_").isNull() | (F.col("h_") == F.col("least_")))
    ghosts = dealt.join(named, leads).groupBy("k_", F.col("to_").alias("b_")).agg(first)
    ghosts = ghosts.select("k_", F.col("f_.h_").alias("h_"), F.col("f_.t").alias("t_"), "b_", F.lit(1).alias("g_"))
    rows = dealt.withColumn("g_", F.lit(0)).unionByName(ghosts).repartitionById(firsts[-1], "b_").sortWithinPartitions(F.col("b_"), F.col("g_"), F.col("k_").desc_nulls_last(), F.col("h_"), F.col("t_"))

    def run(batches):
        def pairs_of():
            now = None
            for b in small_batches(batches):
                for k, t, bucket_, g in zip(*(b.column(c).to_pylist() for c in ("k_", "t_", "b_", "g_")), strict=True):
                    if now is not None and now[2] == bucket_:
                        yield now[0], now[1], t
                    now = None if g else (k, t, bucket_)

        yield from fn(pairs_of())

    return rows.mapInArrow(run, schema)


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double"


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(triples):
    sketcher, kinds = Sketcher(), [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
    rows, last = [], (None, None)
    for key, text, following in triples:
        own = last[1] if last[0] is text else sketcher.sketch(text)
        other = edited(text, following)
        changed, nxt = sketcher.sketch(other), sketcher.sketch(following)
        last = (following, nxt)
        rows.append((key, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, nxt), containment(own, changed)))
        if len(rows) == 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in EDITED.split(", ")])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in EDITED.split(", ")])


def compare_with_edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document (EDITED), one row for each row.

    Null texts are empty; texts without words have an empty fingerprint and are like each other. Repeated rows and equal keys
    are documents that follow one another; those of a null key follow last. A lone document follows itself. Whole texts are
    read; other columns are not; an empty table gives an empty result.
    """
    return with_next(docs, _compare, EDITED, text, key)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document."""
    return compare_with_edited(table(spark, sf_dir, "documents"))

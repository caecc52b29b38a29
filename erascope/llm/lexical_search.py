r"""Ranked lexical search by a scan of the documents with an Aho-Corasick automaton of all the items' terms.

Terms are runs of ASCII letters and digits and of all characters from U+0080 on; A-Z are lower-cased and every other character
becomes a space. The automaton holds each distinct term with a space on both sides, so that it finds whole terms only, and
reports a term's number; a table from numbers to items turns what it found in a text into scores. There is no index of the
documents: one pass counts documents, terms and the documents that hold each of the items' terms, a second one scores. Each
task keeps the K best rows an item; those of tasks are merged in two steps.

Items are worked on in blocks of about BLOCK_CHARS characters; a block's automaton goes to every task. Items do not depend on
each other, so more blocks are more passes, and memory stays bounded. One item is never divided.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_texts, per_batch, table

K = 10
#: Weight of a document's length, in hundredths.
LENGTH_WEIGHT = 90
BLOCK_CHARS = 4_000_000
#: Tasks whose best rows are merged together before the last step.
MERGED = 500
#: Bytes of terms, A-Z lower-cased; all others become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[str]:
    return text.translate(TERM_BYTES).decode("utf-8").split(" ")


def postings(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, items, at): the distinct terms of some item texts; items[at[t]:at[t + 1]] are the numbers of those that hold term t."""
    number: dict[str, int] = {}
    pairs = [(number.setdefault(w, len(number)), i) for i, t in enumerate(texts) for w in dict.fromkeys(terms_of(t)) if w]
    held = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return list(number), held[:, 1].copy(), np.searchsorted(held[:, 0], np.arange(len(number) + 1))


def item_blocks(items: DataFrame, key: str, text: str, most: int):
    """(ids, postings) of blocks of about so many characters of items, one at a time on the driver. Null and empty texts, which
    have no terms, are left out."""
    sized = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    total = sized.agg(F.sum(F.length("t").cast("bigint"))).first()[0] or 0
    n = -(-total // most)
    for b in range(n):
        part = sized if n == 1 else sized.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
        rows = sorted(((r.k, r.t.encode()) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0], r[1]))
        yield [k for k, _ in rows], postings([t for _, t in rows])


def automaton(terms: list[str]):
    """Each term between spaces, with its number."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, w in enumerate(terms):
        a.add_word(f" {w} ", i)
    a.make_automaton()
    return a


def scanned(a, text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and how often each of the automaton's occurs, by number."""
    text = text.translate(TERM_BYTES)
    return len(text.split()), Counter(map(itemgetter(1), a.iter(f" {text.decode('utf-8')} "))) if len(a) else Counter()


def statistics(docs: DataFrame, text: str, shared) -> tuple[int, int, dict[int, int]]:
    """N, L and df: documents with a term, all their terms, and how many documents hold each term of a block."""

    def run(batches):
        a, df, n, total = automaton(shared.value[0]), Counter(), 0, 0
        for b in batches:
            for t in byte_texts(b, text):
                terms, hits = scanned(a, t)
                n, total = n + (terms > 0), total + terms
                df.update(hits.keys())
        yield {"term": [-2, -1, *df], "n": [n, total, *df.values()]}

    sums = {r.term: r.n for r in per_batch(docs.select(text), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}  # a row for each term of the block
    return sums.pop(-2, 0), sums.pop(-1, 0), sums


class Best:
    """The k best (score, key) of each item: higher scores first, of equal ones lower keys, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.held, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, key: int | None, scores: np.ndarray) -> None:
        order = -math.inf if key is None else -key
        for i in np.flatnonzero(scores >= self.least).tolist():
            held, row = self.held[i], (int(scores[i]), order)
            if len(held) < self.k:
                heapq.heappush(held, row)
            else:
                heapq.heappushpop(held, row)
            if len(held) == self.k:
                self.least[i] = held[0][0]

    def rows(self) -> dict[str, list]:
        flat = [(i, None if o == -math.inf else -o, s) for i, held in enumerate(self.held) for s, o in held]
        return dict(zip(("i", "key", "score"), map(list, zip(*flat, strict=True)), strict=True)) if flat else {"i": []}


def ranked(docs: DataFrame, text: str, key: str, shared, n: int, total: int, df: dict[int, int], k: int) -> DataFrame:
    """Rows (i, key, score, part): each task's k best documents of each item of a block."""
    weights = np.zeros(len(shared.value[0]), np.int64)
    for t, d in df.items():
        weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))
    shared_weights = docs.sparkSession.sparkContext.broadcast(weights)  # a number for each term of the block

    def run(batches):
        terms, items, at = shared.value
        w, a = shared_weights.value, automaton(terms)
        many = int(items.max()) + 1 if len(items) else 0
        best, starts, lengths = Best(many, k), at[:-1], np.diff(at)
        for b in batches:
            for doc, t in zip(b.column(key).to_pylist(), byte_texts(b, text), strict=True):
                words, hits = scanned(a, t)
                if not hits:
                    continue
                m = 100 - LENGTH_WEIGHT + LENGTH_WEIGHT * words * n // total
                at_, tf = np.fromiter(hits.keys(), np.int64, len(hits)), np.fromiter(hits.values(), np.int64, len(hits))
                gain = w[at_] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                size = lengths[at_]
                place = np.repeat(starts[at_] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                scores = np.zeros(many, np.int64)
                np.add.at(scores, items[place], np.repeat(gain, size))
                best.add(doc, scores)
        yield best.rows()

    return per_batch(docs.select(F.col(key).cast("bigint").alias(key), text), run, "i bigint, key bigint, score bigint").withColumn("part", F.floor(F.spark_partition_id() / MERGED))


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (item, rank, key, score): the k best documents of each item with a score above 0, equal scores by ascending key.

    With N documents that have a term, L terms in them and n in one of them, a term that df documents hold weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), and a document that has it tf times gains w * (10^9 tf div (1000 tf + 8m)),
    m = 10 + 90nN div L, for each distinct term of the item, in 64-bit integers. Null and empty texts have no terms: such
    documents and items give no rows. Repeated rows are documents or items of their own, a null key goes after others of
    its score; whole texts are scanned; an empty table gives an empty result; other columns are not read.
    """
    spark, out = docs.sparkSession, None
    ids = StructType([StructField("i", LongType()), StructField(item, items.schema[item].dataType)])
    for names, block in item_blocks(items, item, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)  # of about block_chars characters, or one item
        n, total, df = statistics(docs, text, shared)
        rows = ranked(docs, text, key, shared, n, total, df, k)
        for by in (["i", "part"], ["i"]):
            rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key")))).filter(F.col("rank") <= k)
        named = F.broadcast(spark.createDataFrame(list(enumerate(names)), ids))  # a row for each item of the block
        rows = rows.join(named, "i").select(item, "rank", F.col("key").alias(key), "score")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], StructType([ids[1]])).selectExpr(f"`{item}`", "0 as rank", f"0L as `{key}`", "0L as score")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, len, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
g AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len * (SELECT n FROM s)) // (SELECT l FROM s)))))::BIGINT AS score FROM t JOIN tf USING (term) JOIN df USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

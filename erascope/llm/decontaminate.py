"""Benchmark decontamination with an FM-index of each shard of documents.

A shard is a run of documents of one task, at most SHARD words. Its index is over words that the benchmark has; a word that
it has not ends a run, runs too short for any phrase are left out, and each run ends with a mark of its own. From the suffix array come the
Burrows-Wheeler transform, kept as a wavelet matrix with rank counts, and every SAMPLE-th suffix position. All test
phrases are searched backwards at once; occurrences are located by stepping to the next sampled position; the words they
cover are merged into removal spans.

Shards never leave their task, so nothing is shuffled. The phrases go to every task, in blocks of about BLOCK_CHARS
characters of benchmark text. A benchmark of more blocks takes one pass over the documents for each, one after the other, so
that one block is in memory at a time; the rows are numbered and written first, and the passes are merged by number.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import byte_texts, release, small_batches, table, written

WINDOW = 10
SHARD = 1 << 16
#: Documents that are cut into words at a time.
ROWS = 128
SAMPLE = 8
BLOCK_CHARS = 8_000_000
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F], A-Z lower-cased; all others become spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows_of(items: list[tuple[object, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """Each distinct window with the items that have it; an item of fewer words is one window, of none has none."""
    out: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out[tuple(w[i : i + window])].add(item)
    return out


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again. The last code is the smallest."""
    n = len(codes)
    order = np.argsort(codes)
    sorted_codes = codes[order]
    new = np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1]))
    rank = np.empty(n + 1, np.int64)
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a suffix's rank is the first place of its group
    rank[order], rank[n] = heads, -1
    alone = new & np.concatenate((new[1:], [True]))
    tied = np.flatnonzero(~alone)  # places in order
    h = 1
    while len(tied):
        suffix = order[tied]
        key = (rank[suffix] << 32) | (rank[np.minimum(suffix + h, n)] + 1)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix  # groups are runs of places, and keys sort by group first
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[suffix] = tied[first]
        alone = new & np.concatenate((new[1:], [True]))
        tied = tied[~alone]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row with running counts for each bit of a symbol."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.n, self.bits, self.rows, self.zeros = len(codes), bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (codes >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view("<u8")
            sums = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.rows.append((packed, sums))
            self.zeros.append(self.n - int(bit.sum()))
            codes = np.concatenate((codes[bit == 0], codes[bit == 1]))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, sums = self.rows[level]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return sums[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the first at places."""
        start = np.zeros(len(at), np.int64)
        end = at.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1
            a, b = self.ones(level, start), self.ones(level, end)
            start = np.where(one, self.zeros[level] + a, start - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and their ranks there."""
        symbol = np.zeros(len(at), np.int64)
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            packed, _ = self.rows[level]
            one = ((packed[end >> 6] >> (end & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            a, b = self.ones(level, start), self.ones(level, end)
            start = np.where(one, self.zeros[level] + a, start - a)
            end = np.where(one, self.zeros[level] + b, end - b)
            symbol = symbol << 1 | one
        return symbol, end - start


class FMIndex:
    """Backward search over a sequence of codes; code 0 only ends the sequence."""

    def __init__(self, codes: np.ndarray, sample: int = SAMPLE, order_by: np.ndarray | None = None, keep: np.ndarray | None = None, symbols: int | None = None):
        """order_by: codes that refine the order of equal codes (here: the end marks), for sorting alone. keep: positions to
        sample besides, which must be those after refined codes, as no step goes back over one. symbols: the number of codes, of which the sequence may lack some."""
        order = suffix_array(codes if order_by is None else order_by)
        self.n, self.sample = len(codes), sample
        symbols = max(symbols or 0, int(codes.max()) + 1)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))))
        last = codes[order - 1]  # the code before each suffix
        self.tree = WaveletMatrix(last, max(1, (symbols - 1).bit_length()))
        kept = order % sample == 0
        if keep is not None:
            also = np.zeros(self.n, bool)
            also[keep] = True
            kept |= also[order]
        self.kept = WaveletMatrix(kept.astype(np.int64), 1)
        self.positions = order[kept]
        self.is_kept = kept

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given as rows of codes aligned at their ends."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(width):
            at = np.flatnonzero((lengths > k) & (low < high))
            if not len(at):
                break
            c = phrases[at, width - 1 - k]
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((low[at], high[at])))
            low[at], high[at] = self.first[c] + both[: len(at)], self.first[c] + both[len(at) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in rows, by at most sample - 1 steps to one whose position is kept."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            here = self.is_kept[row]
            at = todo[here]
            out[at] = self.positions[self.kept.ones(0, row[here])] + steps[at]
            todo, row = todo[~here], row[~here]
            symbol, rank = self.tree.access(row)
            row = self.first[symbol] + rank
            steps[todo] += 1
        return out


class Phrases(NamedTuple):
    """The windows of a benchmark as codes: 0 ends the shard, 1 a run of words, then the benchmark's words."""

    vocabulary: dict[bytes, int]
    items: list[list[str]]
    lengths: np.ndarray
    codes: np.ndarray


def phrases_of(items, window: int) -> Phrases:
    found = windows_of(items, window)
    vocabulary = {w: i + 2 for i, w in enumerate(sorted({w for p in found for w in p}))}
    codes = np.zeros((len(found), window), np.int64)
    for i, p in enumerate(found):
        codes[i, window - len(p) :] = [vocabulary[w] for w in p]
    return Phrases(vocabulary, [sorted(map(str, owners)) for owners in found.values()], np.array([len(p) for p in found], np.int64), codes)


def _runs(codes: np.ndarray, shortest: int, longest: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of benchmark words (codes over 1) that can hold a phrase; a run longer than a shard is cut
    into pieces that overlap by one word less than the longest phrase."""
    inside = np.concatenate(([False], codes > 1, [False]))
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    long_enough = end - start >= shortest
    start, end = start[long_enough], end[long_enough]
    if len(start) and (end - start).max() > shard:
        cut = [(s, min(e, s + shard)) for a, e in zip(start.tolist(), end.tolist(), strict=True) for s in range(a, max(a + 1, e - longest + 1), max(1, shard - longest + 1))]
        start, end = np.array(cut, np.int64).T
    return start, end


def search_documents(docs: list[list[bytes]], phrases: Phrases, shard: int = SHARD, sample: int = SAMPLE):
    """For each document (its hit spans as word ranges, its items). A phrase can only occur in a run of words that are all
    the benchmark's and no fewer than the shortest phrase, so the index holds those runs, each with an end mark."""
    out = [([], set()) for _ in docs]
    get, longest = phrases.vocabulary.get, phrases.codes.shape[1]
    begin = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
    codes = np.ones(begin[-1], np.int64)
    for d, words in enumerate(docs):
        codes[begin[d] : begin[d] + len(words)] = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
    start, end = _runs(codes, int(phrases.lengths.min()), longest, shard)
    done = 0
    while done < len(start):
        upto = max(done + 1, done + int(np.searchsorted(np.cumsum(end[done:] - start[done:] + 1), shard, side="right")))
        s, n = start[done:upto], (end - start)[done:upto]
        done = upto
        offset = np.concatenate(([0], np.cumsum(n + 1)))  # of runs in the shard
        text = np.zeros(offset[-1] + 1, np.int64)
        text[:-1] = codes[np.repeat(s - offset[:-1], n + 1) + np.arange(offset[-1])]
        marks = offset[1:] - 1
        text[marks] = 1
        order_by = text + len(marks)  # the end marks are ordered among themselves, so that ties end with a run
        order_by[marks] = np.arange(1, len(marks) + 1)
        order_by[-1] = 0
        index = FMIndex(text, sample, order_by, offset[:-1], len(phrases.vocabulary) + 2)
        low, high = index.search(phrases.codes, phrases.lengths)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        k = (high - low)[hit]
        rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        which = np.repeat(hit, k)
        at = index.locate(rows)
        run = np.searchsorted(offset, at, side="right") - 1
        at = at - offset[run] + s[run]
        doc = np.searchsorted(begin, at, side="right") - 1
        by = np.lexsort((at, doc))
        doc, at, which = doc[by], (at - begin[doc])[by], which[by]
        heads = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            d = int(doc[a])
            out[d][0].extend(zip(at[a:b].tolist(), (at[a:b] + phrases.lengths[which[a:b]]).tolist(), strict=True))
            for w in np.unique(which[a:b]).tolist():
                out[d][1].update(phrases.items[w])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _block_count(benchmark: DataFrame, text: str, block_chars: int) -> int:
    return max(1, -(-(benchmark.select(F.sum(F.length(text))).first()[0] or 0) // block_chars))


def _blocks(benchmark: DataFrame, item: str, text: str, n: int):
    """The benchmark in n blocks, one after the other on the driver."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null")
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"].encode()) for r in part.collect()]  # a block of bounded size


def _find(docs: DataFrame, phrases: Phrases, shard: int, sample: int):
    """Rows of docs (doc_ any, text_) as (doc_, n_words, starts, ends (merged word spans), items)."""
    schema = docs.select("doc_").schema
    for name, kind in (("n_words", LongType()), ("starts", ArrayType(LongType())), ("ends", ArrayType(LongType())), ("items", ArrayType(StringType()))):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(phrases))  # built-in types and arrays alone: workers have no copy of this code

    def run(batches):
        phrases = Phrases(*shared.value)

        def flush(held):
            found = search_documents([w for _, ws in held for w in ws], phrases, shard, sample) if len(phrases.lengths) else None
            k = 0
            for b, ws in held:
                mine = found[k : k + len(ws)] if found is not None else [([], set())] * len(ws)
                k += len(ws)
                spans = [merged(s) for s, _ in mine]
                add = [pa.array([len(w) for w in ws], pa.int64()), pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())), pa.array([[e for _, e in s] for s in spans], pa.list_(pa.int64())), pa.array([sorted(map(str, i)) for _, i in mine], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_"), *add], names=["doc_", "n_words", "starts", "ends", "items"])

        held, size = [], 0
        for b in small_batches(batches, ROWS):
            ws = [words_of(t) for t in byte_texts(b, "text_")]
            n = sum(map(len, ws))
            if held and size + n > shard:
                yield from flush(held)
                held, size = [], 0
            held.append((b.select(["doc_"]), ws))
            size += n
        if held:
            yield from flush(held)

    return docs.select("doc_", "text_").mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD, sample: int = SAMPLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (key, n_words, starts, ends, items), one for each row of docs.

    starts and ends are merged spans of word numbers that occur in the benchmark, items the items with an occurring window,
    sorted as strings. Null texts have no words; null item texts have no windows; an empty benchmark hits nothing. Texts
    of any length are indexed whole, in overlapping pieces beyond a shard. Repeated rows and rows of a null key each give
    a row, whatever the size of the benchmark. An empty table gives an empty result; other columns are not read.
    """
    n = _block_count(benchmark, item_text, block_chars)
    docs = docs.select(F.col(key).alias("doc_"), F.col(text).alias("text_"))
    if n == 1:
        (block,) = _blocks(benchmark, item, item_text, 1)
        return _find(docs, phrases_of(block, window), shard, sample).withColumnRenamed("doc_", key)
    docs = written(docs.select(F.struct("doc_", F.monotonically_increasing_id().alias("row_")).alias("doc_"), "text_"))
    passes = [written(_find(docs, phrases_of(b, window), shard, sample)) for b in _blocks(benchmark, item, item_text, n)]
    release(docs)
    every, *rest = passes
    for r in rest:
        every = every.unionByName(r)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))  # one list for each block of the benchmark
    grown = every.groupBy("doc_.row_").agg(F.first("doc_.doc_").alias(key), F.first("n_words").alias("n_words"), spans.alias("s_"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = F.aggregate(
        "s_",
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["starts"] <= F.element_at(acc, -1)["ends"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return grown.withColumn("m_", join).select(key, "n_words", F.col("m_.starts").alias("starts"), F.col("m_.ends").alias("ends"), "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without those that hold any window of the benchmark; all columns stay, whatever their names. No shuffle; each
    further block of the benchmark is a pass over what the blocks before left.

    Null and empty texts hold no window and stay, as do all documents beside an empty benchmark. Repeated rows stay or go
    together. An empty table gives an empty result.
    """
    n = _block_count(benchmark, item_text, block_chars)
    kept = docs.select(F.struct(*docs.columns).alias("doc_"))
    for i, b in enumerate(_blocks(benchmark, item, item_text, n)):
        found = _find(kept.select("doc_", F.col("doc_")[text].alias("text_")), phrases_of(b, window), SHARD, SAMPLE).filter(F.size("starts") == 0).select("doc_")
        kept = found if i == n - 1 else written(found)
    return kept.select("doc_.*")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS said FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM v),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN v ON dw.said = v.said AND dw.n = v.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS g(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(said, ',' ORDER BY said) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS said FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those hit by the benchmark, and the items with occurring windows."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

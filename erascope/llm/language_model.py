"""Language-model scores by context-tree weighting of bytes.

The model gives probabilities to a text's tokens written as bytes: each word and a space, then one end byte. A byte is
eight binary decisions; each decision, given the last 0 to DEPTH bytes, has a Krichevsky-Trofimov estimate from the counts
of the training texts, and the estimates of all depths are mixed by the weights of a context tree: a node of the tree holds
half its own estimate and half the product of its children, summed up from the deepest contexts. Where a context was never
seen, the mixture ends at the deepest one that was. So the code length of a byte is exact and sums to one over all bytes.

The corpus is read twice. The first pass counts words and grams (DEPTH context bytes and the next byte) of all texts; Spark
sums them. The tree is built by groups of grams that share their last three context bytes, which hold whole subtrees; Spark
sums what they say into the nodes of two bytes, and those into the levels above, at most 256 * 255 nodes. It gives one log
probability for each gram that any text has. The second pass adds those up. Grams and words are looked up in tables of the most frequent ones, at most HEAVY_GRAMS and HEAVY_WORDS
entries, which every task gets; what a text has beyond them is joined by key. The split changes no result.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, per_batch, same_remainder, slices, table, written

DEPTH = 5
HEAVY_GRAMS = 1 << 21
HEAVY_WORDS = 1 << 19
SMOOTHING = 0.1
#: Bytes that no UTF-8 text has: the end, which also fills the context before a text.
END = 0xFF
KEPT_WORDS, KEPT_GRAMS = 200_000, 500_000
#: Bytes of text that are worked on together.
SLICE = 1_000_000
CHUNK = 400_000
#: The depth of the groups in which the tree is built, and into how many parts grams of two equal last bytes are dealt.
GROUP = 3
SALTS = 8
_EMPTY = np.uint64((1 << 64) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def grams_of(docs: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the grams of some texts, one after the other, with the start and length of each text's own."""
    pad, end = bytes([END]) * depth, bytes([END])
    lines = [b" ".join([*w, end]) for w in docs]
    a = np.frombuffer(b"".join(x for line in lines for x in (pad, line)), np.uint8)
    lengths = np.array([len(x) for x in lines], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + depth)[:-1])).astype(np.int64)
    n = max(0, len(a) - depth)
    codes = np.zeros(n, np.uint64)
    for j in range(depth + 1):
        codes <<= np.uint64(8)
        codes |= a[j : j + n]
    return codes, starts, lengths


def _own(codes, starts, lengths):
    """The codes without those that run from one text into the next."""
    step = np.zeros(len(codes) + 1, np.int8)
    step[starts] += 1
    step[starts + lengths] -= 1
    return codes[np.cumsum(step[:-1], dtype=np.int8) > 0]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and sums of the values."""
    if not len(keys):
        return keys, *values
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], *(np.add.reduceat(v[by], at) for v in values)


COUNTS = "kind int, word binary, gram bigint, n bigint, m bigint"


def count_corpus(docs: DataFrame, text: str, held: str, depth: int = DEPTH) -> DataFrame:
    """Rows of words (kind 1; n: count in training texts, the end as a word of one END byte) and grams (kind 2; m: in all)."""

    def rows_of_words(words: Counter):
        k = len(words)
        return {"kind": np.full(k, 1, np.int32), "word": pa.array(list(words), pa.binary()), "gram": np.zeros(k, np.int64), "n": np.fromiter(words.values(), np.int64, k), "m": np.zeros(k, np.int64)}

    def rows_of_grams(grams):
        k = len(grams[0])
        return {"kind": np.full(k, 2, np.int32), "word": pa.nulls(k, pa.binary()), "gram": grams[0].view(np.int64), "n": grams[1], "m": grams[2]}

    def run(batches):
        words: Counter = Counter()
        grams: list[tuple] = []
        for b in batches:
            whole, out = byte_texts(b, text), b.column(held).to_pylist()
            for part in slices([len(t) for t in whole], SLICE):
                split = [words_of(t) for t in whole[part]]
                for w, h in zip(split, out[part], strict=True):
                    if not h:
                        words.update(w)
                        words[bytes([END])] += 1
                for learned in (True, False):
                    some = [w for w, h in zip(split, out[part], strict=True) if h != learned]
                    if some:
                        codes, count = np.unique(_own(*grams_of(some, depth)), return_counts=True)
                        grams.append((codes, count if learned else np.zeros_like(count), count))
                if sum(len(g[0]) for g in grams) > 2 * KEPT_GRAMS:
                    grams = [_summed(*(np.concatenate(x) for x in zip(*grams, strict=True)))]
                    if len(grams[0][0]) > KEPT_GRAMS:
                        yield rows_of_grams(grams.pop())
                if len(words) > KEPT_WORDS:
                    yield rows_of_words(words)
                    words = Counter()
        if grams:
            yield rows_of_grams(_summed(*(np.concatenate(x) for x in zip(*grams, strict=True))))
        if words:
            yield rows_of_words(words)

    parts = per_batch(docs.select(text, held), run, COUNTS)
    return written(parts.groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), by="kind")


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: Stirling's series after moving x up to 8 or more."""
    shift, y = np.zeros_like(x), x.astype(float)
    while (small := y < 8).any():
        shift[small] += np.log(y[small])
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _bit_nodes(codes: np.ndarray, n: np.ndarray):
    """Nodes (context << 8 | binary prefix, from 1) with counts of zeros and ones, from distinct (context, byte) codes."""
    byte, context = codes & np.uint64(255), codes & ~np.uint64(255)
    keys, ones = [], []
    for k in range(8):
        keys.append(context | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
        ones.append(n * ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64))
    nodes, one, total = _summed(np.concatenate(keys), np.concatenate(ones), np.tile(n, 8))
    return nodes, total - one, one


def _weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of half own plus half below, the share of own in it)."""
    both = np.logaddexp(own, below)
    return both - math.log(2), np.exp(own - both)


def subtrees(grams: np.ndarray, n: np.ndarray, depth: int = DEPTH, top: int = GROUP) -> dict[int, tuple]:
    """{d: (nodes, zeros, ones, log weighted probability, weight of the own estimate)} for d from depth to top, from the
    training counts of grams that hold whole subtrees below depth top."""
    seen = n > 0
    grams, n = grams[seen], n[seen]
    out: dict[int, tuple] = {}
    for d in range(depth, top - 1, -1):
        codes, count = _summed(grams & np.uint64((1 << 8 * (d + 1)) - 1), n)
        nodes, zeros, ones = _bit_nodes(codes, count)
        own = log_kt(zeros, ones)
        if d == depth:
            out[d] = nodes, zeros, ones, own, np.ones(len(nodes))
            continue
        deeper, _, _, log_below, _ = out[d + 1]
        parent = (deeper & np.uint64((1 << 8 * (d + 1)) - 1))
        below = np.bincount(np.searchsorted(nodes, parent), weights=log_below, minlength=len(nodes))
        out[d] = nodes, zeros, ones, *_weighted(own, below)
    return out


def log_probabilities(grams: np.ndarray, levels: dict[int, tuple]) -> np.ndarray:
    """Natural log of the model's probability of each gram's last byte after its context."""
    total = np.zeros(len(grams))
    byte = grams & np.uint64(255)
    for k in range(8):
        prefix = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        p, mixed = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for d in sorted(levels, reverse=True):
            nodes, zeros, ones, _, share = levels[d]
            if not len(nodes):
                continue
            key = (grams & np.uint64((1 << 8 * (d + 1)) - 1) & ~np.uint64(255)) | prefix
            at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
            seen = nodes[at] == key
            kt = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            p = np.where(seen, np.where(mixed, share[at] * kt + (1 - share[at]) * p, kt), p)
            mixed |= seen
        total += np.log(p)
    return total


def _groups(batches, columns: tuple[str, ...], chunk: int):
    """Arrays of the columns, the first of which numbers groups, for runs of whole groups of about chunk rows or one group;
    from rows sorted by group."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        cols = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in columns)
        if size >= chunk:
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if cut == 0 and held[-1][0][-1] != cols[0][0]:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
            elif cut:
                held.append(tuple(x[:cut] for x in cols))
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size, cols = [], 0, tuple(x[cut:] for x in cols)
        held.append(cols)
        size += len(cols[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


UPPER = "node bigint, zeros bigint, ones bigint, below double"


def gram_table(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (gram, m, logp) from (gram, n, m); depth is GROUP or more.

    A group of grams with the same last three context bytes holds the subtrees below those; it grows with the distinct
    grams of the corpus, not with its texts. Nodes of two context bytes are summed and weighted by Spark, and meet the
    grams again beside the groups that need them.
    """
    if depth < GROUP:
        raise ValueError(f"contexts have {GROUP} bytes or more")
    spark = grams.sparkSession
    byte = lambda k: F.shiftrightunsigned("gram", 8 * k).bitwiseAND(F.lit(0xFF))
    bottom = grams.select(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("g_"), "gram", "n").filter("n > 0").repartition("g_").sortWithinPartitions("g_")

    def tops(batches):
        for _, gram, n in _groups(batches, ("g_", "gram", "n"), CHUNK):
            nodes, zeros, ones, below, _ = subtrees(gram.view(np.uint64), n, depth)[GROUP]
            node, zeros, ones, below = _summed(nodes & np.uint64(0xFFFFFF), zeros, ones, below)
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], names=["node", "zeros", "ones", "below"])

    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]

    def weigh(batches):
        for b in batches:
            node, zeros, ones, below = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "zeros", "ones", "below"))
            log_p, share = _weighted(log_kt(zeros, ones), below)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zeros, ones, log_p, share)], names=["node", "zeros", "ones", "below", "share"])

    second = written(bottom.mapInArrow(tops, UPPER).groupBy("node").agg(*sums).mapInArrow(weigh, UPPER + ", share double"))
    upper = second.groupBy(F.col("node").bitwiseAND(F.lit(0xFFFF)).alias("node")).agg(*sums).orderBy("node").toPandas()  # at most 256 * 255 rows
    nodes, zeros, ones = upper["node"].to_numpy(np.uint64), upper["zeros"].to_numpy(np.int64), upper["ones"].to_numpy(np.int64)
    first = nodes, zeros, ones, *_weighted(log_kt(zeros, ones), upper["below"].to_numpy(float))
    root, z, o, below = _summed(nodes & np.uint64(255), zeros, ones, first[3])
    shared = spark.sparkContext.broadcast({1: first, 0: (root, z, o, *_weighted(log_kt(z, o), below))})

    # groups of a part in a run, behind the nodes of their two last bytes (in group -1 of the part)
    part = lambda pair, salt: pair * F.lit(SALTS) + salt
    rows = grams.select(part(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF)), byte(3) % SALTS).alias("p_"), byte(3).alias("t_"), "gram", "n", "m", F.lit(0.0).alias("share"))
    above = second.select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_"), "*").select(part(F.shiftrightunsigned("node", 8), F.col("s_")).alias("p_"), F.lit(-1).cast("bigint").alias("t_"), F.col("node").alias("gram"), F.col("zeros").alias("n"), F.col("ones").alias("m"), "share")
    dealt = rows.unionByName(above).withColumn("g_", F.col("p_") * 257 + F.col("t_") + 1).repartition("p_").sortWithinPartitions("g_", "gram")

    def fill(batches):
        level = [np.zeros(0, np.int64)] * 5
        for g, gram, n, m, share in _groups(batches, ("g_", "gram", "n", "m", "share"), CHUNK):
            own = g % 257 == 0
            # the nodes of the last part of the rows before still count
            level = [np.concatenate((a[level[0] // 257 == g[0] // 257], b[own])) for a, b in zip(level, (g, gram, n, m, share), strict=True)]
            if own.all():
                continue
            nodes, at = np.unique(level[1], return_index=True)
            second = nodes.view(np.uint64), level[2][at], level[3][at], None, level[4][at]
            gram, n, m = gram[~own], n[~own], m[~own]
            levels = subtrees(gram.view(np.uint64), n, depth) | {2: second} | shared.value
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(m), pa.array(log_probabilities(gram.view(np.uint64), levels))], names=["gram", "m", "logp"])

    return dealt.mapInArrow(fill, "gram bigint, m bigint, logp double")


class HashTable:
    """Values of 64-bit keys, with linear probing over arrays; over the slots of another table, which can be sent as arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, filled: bool = False):
        if filled:
            self.keys, self.values, self.bits = keys, values, len(keys).bit_length() - 1
            return
        self.bits = max(4, (3 * len(keys) // 2).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, _EMPTY, np.uint64), np.zeros(size)
        slot, at = self.slots(keys), np.arange(len(keys))
        while len(at):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[at[free]]  # of several for a slot one wins
            won = self.keys[slot] == keys[at]
            self.values[slot[won]] = values[at[won]]
            at, slot = at[~won], (slot[~won] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that are not there."""
        slot = self.slots(keys)
        out = self.values[slot]
        todo = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[todo]
        while len(todo):
            gone = self.keys[slot] == _EMPTY
            out[todo[gone]] = np.nan
            todo, slot = todo[~gone], (slot[~gone] + 1) & (len(self.keys) - 1)
            here = self.keys[slot] == keys[todo]
            out[todo[here]] = self.values[slot[here]]
            todo, slot = todo[~here], slot[~here]
        return out


def heaviest(rows: DataFrame, count: str, most: int) -> tuple[DataFrame, bool]:
    """(rows of the largest counts, at most so many; whether these are all). The least count is a power of two."""
    sizes = dict(rows.select(F.floor(F.log2(F.greatest(F.col(count), F.lit(1)))).cast("int").alias("e")).groupBy("e").count().collect())  # 64 rows at most
    total, least = 0, None
    for e in sorted(sizes, reverse=True):
        if total + sizes[e] > most:
            break
        total, least = total + sizes[e], e
    if total == sum(sizes.values()):
        return rows, True
    return rows.filter(F.col(count) >= F.lit(1 << (64 if least is None else least)).cast("decimal(20,0)")), False


PARTS = "kind int, key bigint, doc_id bigint, held_out boolean, word binary, gram bigint, n bigint, n_tokens bigint, n_bytes bigint, n_known bigint, base double, score double"


def score(docs: DataFrame, held: str, text: str = "text", key: str = "doc_id", depth: int = DEPTH, heavy_grams: int = HEAVY_GRAMS, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one for each row of docs.

    score is the log10 probability of the whole text, bits_per_byte its code length over n_bytes, the bytes coded.

    Texts with a true held column are scored and not learned from. Null and empty texts are an end alone. Whole texts are
    learned and scored; repeated rows each count and each give a row; a null key stays null; other columns are not read.
    If nothing can be learned every bit has probability one half. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held_out"))
    counts = count_corpus(docs, "text", "held_out", depth)
    words = counts.filter("kind = 1").select("word", "n")
    grams = written(gram_table(counts.filter("kind = 2").select("gram", "n", "m"), depth))
    n_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.filter(F.col("word") == F.lit(bytes([END]))).select("n").first()
    log_all = math.log10(n_all + SMOOTHING * (distinct + 1))
    top_words, all_words = heaviest(words, "n", heavy_words)
    top_grams, all_grams = heaviest(grams, "m", heavy_grams)
    picked = top_words.select("word", "n").toArrow()  # at most heavy_words rows
    known = dict(zip(picked.column("word").to_pylist(), picked.column("n").to_pylist(), strict=True))
    picked = top_grams.select("gram", "logp").toArrow()  # at most heavy_grams rows
    lookup = HashTable(picked.column("gram").to_numpy().view(np.uint64), picked.column("logp").to_numpy())
    # built-in types and arrays alone: workers have no copy of this code
    model = spark.sparkContext.broadcast((known, lookup.keys, lookup.values, ends[0] if ends else 0))
    del known, lookup, picked

    def run(batches):
        known, keys, values, n_end = model.value
        lookup = HashTable(keys, values, filled=True)
        first, done = TaskContext.get().partitionId() << 33, 0
        end_score = math.log10(n_end + SMOOTHING) - log_all
        for split, ids, out in ((([words_of(t) for t in whole[p]]), b.column("doc_id")[p.start : p.stop], b.column("held_out")[p.start : p.stop]) for b in batches for whole in (byte_texts(b),) for p in slices([len(t) for t in whole], SLICE)):
            codes, starts, lengths = grams_of(split, depth)
            logp = lookup.get(codes)
            lost = np.isnan(logp)
            logp[lost] = 0
            score_of = np.add.reduceat(np.append(logp, 0.0), np.stack([starts, starts + lengths], axis=1).ravel())[::2] / math.log(10)
            rows = {n: [] for n in ("n_tokens", "n_known", "base")}
            light_words: list[tuple] = []
            for i, w in enumerate(split):
                c = np.fromiter(map(known.get, w, repeat(-1)), np.int64, len(w))
                unknown = c < 0
                if unknown.any():
                    if all_words:
                        c[unknown] = 0
                    else:
                        light_words += [(first + done + i, x, n) for x, n in Counter(w[j] for j in np.flatnonzero(unknown)).items()]
                        c = c[~unknown]
                rows["n_tokens"].append(len(w) + 1)
                rows["n_known"].append(int((c > 0).sum()) + (n_end > 0))
                rows["base"].append(float((np.log10(c + SMOOTHING) - log_all).sum()) + end_score)
            k = len(split)
            nothing = {"word": pa.nulls(k, pa.binary()), "gram": np.zeros(k, np.int64), "n": np.zeros(k, np.int64)}
            yield {"kind": np.zeros(k, np.int32), "key": first + done + np.arange(k), "doc_id": ids, "held_out": out, "score": score_of, "n_bytes": lengths, **rows, **nothing}
            if light_words:
                keys, said, n = zip(*light_words, strict=True)
                yield _light(1, keys, said, None, n)
            if not all_grams and lost.any():
                at = np.flatnonzero(lost)
                doc = np.searchsorted(starts, at, side="right") - 1
                at, doc = at[own := at < (starts + lengths)[doc]], doc[own]
                if len(at):
                    by = np.lexsort((codes[at], doc))
                    at, doc = at[by], doc[by]
                    heads = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (codes[at][1:] != codes[at][:-1]))))
                    yield _light(2, first + done + doc[heads], None, codes[at[heads]].view(np.int64), np.diff(np.append(heads, len(at))))
            done += k

    parts = written(per_batch(docs, run, PARTS), by="kind")
    own = parts.filter("kind = 0").select("key", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score")
    if not (all_words and all_grams):
        zero = F.lit(0.0)
        c = F.coalesce(words["n"], F.lit(0))
        light_w = parts.filter("kind = 1").select("key", F.col("word").alias("w_"), F.col("n").alias("k_"))
        add_w = light_w.join(words, light_w["w_"] == words["word"], "left").select("key", (F.col("k_") * F.when(c > 0, 1).otherwise(0)).alias("known_"), (F.col("k_") * (F.log10(c + F.lit(SMOOTHING)) - F.lit(log_all))).alias("base_"), zero.alias("score_"))
        light_g = parts.filter("kind = 2").select("key", F.col("gram").alias("g_"), F.col("n").alias("k_"))
        add_g = light_g.join(grams, light_g["g_"] == grams["gram"]).select("key", F.lit(0).cast("bigint").alias("known_"), zero.alias("base_"), (F.col("k_") * F.col("logp") / F.lit(math.log(10))).alias("score_"))
        adds = add_w.unionByName(add_g).groupBy("key").agg(*[F.sum(x).alias(x) for x in ("known_", "base_", "score_")])
        own = own.join(adds, "key", "left").select(
            "doc_id", "held_out", "n_tokens", "n_bytes", *[(F.col(x) + F.coalesce(F.col(f"{y}_"), F.lit(0))).alias(x) for x, y in (("n_known", "known"), ("base", "base"), ("score", "score"))]
        )
    return own.select(F.col("doc_id").alias(key), "held_out", "n_tokens", F.col("n_known").cast("bigint").alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes", (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def _light(kind, keys, words, grams, n):
    k = len(keys)
    none = lambda t: pa.nulls(k, t)
    return {
        "kind": np.full(k, kind, np.int32), "key": np.asarray(keys, np.int64), "doc_id": none(pa.int64()), "held_out": none(pa.bool_()),
        "word": none(pa.binary()) if words is None else pa.array(words, pa.binary()), "gram": none(pa.int64()) if grams is None else grams, "n": np.asarray(n, np.int64),
        "n_tokens": none(pa.int64()), "n_bytes": none(pa.int64()), "n_known": none(pa.int64()), "base": none(pa.float64()), "score": none(pa.float64()),
    }


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those outside the held-out tenth."""
    docs = table(spark, sf_dir, "documents").withColumn("held_", same_remainder(10, 0))
    return score(docs, "held_")

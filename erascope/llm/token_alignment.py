"""Alignment of two tokenizers' tokens by the bytes that they cover.

Each text is encoded by a byte-level BPE (A, after a space) and by a sentencepiece BPE (B, which adds the space); both cover
the same bytes. pandas.merge_asof, once in each direction and keyed by document, finds for each token's start the other
side's token that covers it. Two tokens overlap just if one's start lies in the other, so the union of both directions is
all links, and offsets where a token of both ends cut the tokens into groups.

How many documents hold a pair of ids linked is summed in the tasks first, then by Spark. The counts of the most frequent
pairs, at most FREQUENT, go to every task; those of others are joined.

Where the JSON's merges have the order of its ids and its words are the usual pattern's, its ranks are given to tiktoken,
which then returns the same ids four times as fast; else the tokenizers library reads it.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, per_batch, release, slices, table, texts, written

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the word pattern of byte-level BPE.
WORDS_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
#: Pairs whose counts every task has.
FREQUENT = 1 << 19
#: Distinct pairs that a task counts before it passes them on.
HELD = 1 << 20
#: Bytes of texts that are aligned together.
SLICE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: itself, or the next unused one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: ids of a text, and each id's bytes."""

    def __init__(self, file: bytes):
        said = json.loads(file)
        of = byte_alphabet()
        special = {t["id"] for t in said.get("added_tokens", ())}
        vocabulary = {i: bytes(map(of.__getitem__, w)) for w, i in said["model"]["vocab"].items() if i not in special}
        self.size = max([*vocabulary, *special]) + 1
        self.bytes = [vocabulary.get(i, b"") for i in range(self.size)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        before = said.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and said.get("normalizer") is None
        if plain and all(said["model"]["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            self.encode = tiktoken.Encoding("a", pat_str=WORDS_A, mergeable_ranks={w: i for i, w in vocabulary.items()}, special_tokens={}).encode_to_numpy
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(file.decode())
            slow.encode_special_tokens = True
            self.encode = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """B: the same."""

    def __init__(self, file: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.size, self.encode = m.get_piece_size(), m.encode
        pieces = [m.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]


class Slice:
    """Some texts' tokens, links and groups: ids a and b with the number of their document, the same for links (la, lb are
    places in a and b), and each token's group."""

    def __init__(self, encoders, rows: list[str]):
        one, two = encoders
        a, b, total = [], [], []
        for t in rows:
            said = b" " + t.encode()
            x, y, z = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            if t:
                p, q = one.encode(" " + t), two.encode(t)
                if b"".join(map(two.bytes.__getitem__, q)) == said and b"".join(map(one.bytes.__getitem__, p.tolist())) == said:
                    x, y, z = p, np.array(q, np.int64), len(said)
            a.append(x)
            b.append(y)
            total.append(z)
        self.rows, before = len(rows), np.concatenate(([0], np.cumsum(total)))
        self.a, self.b = (np.concatenate(s).astype(np.int64) if s else np.zeros(0, np.int64) for s in (a, b))
        self.n_a, self.n_b = (np.array([len(x) for x in s], np.int64) for s in (a, b))
        self.doc_a, self.doc_b = (np.repeat(np.arange(self.rows), n) for n in (self.n_a, self.n_b))
        end_a, end_b = (np.cumsum(lengths[ids]) if len(ids) else ids for ids, lengths in ((self.a, one.lengths), (self.b, two.lengths)))
        start_a, start_b = end_a - one.lengths[self.a], end_b - two.lengths[self.b]
        left, right = (pd.DataFrame({"at": s, "doc": d, "token": np.arange(len(s))}) for s, d in ((start_a, self.doc_a), (start_b, self.doc_b)))
        covering_b = pd.merge_asof(left[["at", "doc"]], right, on="at", by="doc")["token"].to_numpy(np.int64)
        covering_a = pd.merge_asof(right[["at", "doc"]], left, on="at", by="doc")["token"].to_numpy(np.int64)
        once = start_a[covering_a] != start_b  # a pair of equal starts is found in both directions
        self.la = np.concatenate((np.arange(len(self.a)), covering_a[once]))
        self.lb = np.concatenate((covering_b, np.flatnonzero(once)))
        self.doc_l = self.doc_a[self.la] if len(self.la) else self.la
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, start_a, "right"), np.searchsorted(cuts, start_b, "right")
        self.n_groups = np.diff(np.searchsorted(cuts, before, "right"))

    def n_links(self) -> np.ndarray:
        return np.bincount(self.doc_l, minlength=self.rows)

    def pairs(self, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, pairs, times): each document's distinct linked ids, as a * sizes[1] + b, by document and pair."""
        span = sizes[0] * sizes[1]
        code, times = np.unique(self.doc_l * span + self.a[self.la] * sizes[1] + self.b[self.lb], return_counts=True)
        return code // span, code % span, times

    def digests(self, names: np.ndarray, sizes: tuple[int, int]) -> list[str]:
        """sha256 of the groups' text of each document; names: those of A's ids with a comma, with a bar, then B's with a
        comma, with a semicolon."""
        last = lambda g: np.concatenate((g[1:] != g[:-1], np.ones(min(1, len(g)), bool)))
        code_a = self.a + sizes[0] * last(self.group_a)
        code_b = self.b + 2 * sizes[0] + sizes[1] * last(self.group_b)
        out = np.empty(len(self.a) + len(self.b), np.int64)  # A's tokens of a group, then B's
        out[np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a)] = code_a
        out[np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")] = code_b
        said, at = names[out].tolist(), np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return [hashlib.sha256("".join(said[i:j])[:-1].encode()).hexdigest() if i < j else "" for i, j in zip(at, at[1:], strict=False)]


class _Encoders(tuple):
    """The two encoders, built once a worker from the files' bytes."""

    @classmethod
    def of(cls, files: dict):
        if "built" not in files:
            both = cls((ByteLevel(files["a"]), Pieces(files["b"])))
            for e in both:
                e.lengths = np.array([len(b) for b in e.bytes], np.int64)
            files["built"] = both
        return files["built"]

    @property
    def sizes(self) -> tuple[int, int]:
        return self[0].size, self[1].size


def _files(spark: SparkSession, a: str, b: str):
    """Both files' bytes, a few megabytes, for every task: executors need no copy of them."""
    with open(a, "rb") as x, open(b, "rb") as y:
        return spark.sparkContext.broadcast({"a": x.read(), "b": y.read()})


def token_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """Rows (key, a_ids, b_ids, a_groups, b_groups, a_linked, b_linked), one for each row of docs: both sides' ids, the number
    of each token's group from 0, and the links as places in a_ids and b_ids.

    A text that is null, empty or not given back byte for byte by both tokenizers has empty arrays. Repeated rows each give
    a row, a null key stays null, other columns are not read; an empty table gives an empty result. Whole texts are aligned:
    a task holds the tokens of one text, or of several of SLICE bytes together.
    """
    files = _files(docs.sparkSession, a, b)

    def run(batches):
        encoders = _Encoders.of(files.value)
        for batch in batches:
            sizes = [len(t) for t in byte_texts(batch, text)]
            rows, keys = texts(batch, text), batch.column(key)
            for at in slices(sizes, SLICE):
                s = Slice(encoders, rows[at])
                order = np.lexsort((s.lb, s.la))
                la, lb = s.la[order], s.lb[order]
                first = lambda n: np.concatenate(([0], np.cumsum(n)))
                cut = lambda values, n: [x.tolist() for x in np.split(values, first(n)[1:-1])]
                group0 = first(s.n_groups)[:-1]
                yield {
                    key: keys[at.start : at.stop], "a_ids": cut(s.a, s.n_a), "b_ids": cut(s.b, s.n_b),
                    "a_groups": cut(s.group_a - group0[s.doc_a], s.n_a), "b_groups": cut(s.group_b - group0[s.doc_b], s.n_b),
                    "a_linked": cut(la - first(s.n_a)[s.doc_a[la]], s.n_links()), "b_linked": cut(lb - first(s.n_b)[s.doc_b[lb]], s.n_links()),
                }

    return per_batch(docs.select(F.col(key).cast("bigint").alias(key), text), run, f"`{key}` bigint, " + ", ".join(f"{n} array<int>" for n in ("a_ids", "b_ids", "a_groups", "b_groups", "a_linked", "b_linked")))


def _aligned(docs: DataFrame, text: str, key: str, files) -> DataFrame:
    """Rows of kind 0, one for each document, with its distinct pairs; rows of kind 1, some for a task, with the number of its
    documents that hold each pair."""
    columns = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        encoders = _Encoders.of(files.value)
        sizes = encoders.sizes
        names = files.value.setdefault("names", np.array([f"{i}{c}" for n, ends in zip(sizes, (",|", ",;"), strict=True) for c in ends for i in range(n)], object))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted(kind, keys, numbers, digests, cuts, pairs, times):
            cuts = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs // sizes[1], pairs % sizes[1], times)]
            return {"kind": [kind] * (len(cuts) - 1), key: keys, **numbers, "groups_sha256": digests, **dict(zip(("a", "b", "times"), lists, strict=True))}

        def summed():
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            return [(codes[new], np.add.reduceat(n, new))]

        def passed_on():
            codes, n = held[0]
            return counted(1, [None], {c: [0] for c in columns}, [""], [0, len(codes)], codes, n)

        for batch in batches:
            rows, keys = texts(batch, text), batch.column(key)
            for at in slices([len(t) for t in byte_texts(batch, text)], SLICE):
                s = Slice(encoders, rows[at])
                doc, pairs, times = s.pairs(sizes)
                numbers = dict(zip(columns, (s.n_a, s.n_b, s.n_groups, s.n_links()), strict=True))
                yield counted(0, keys[at.start : at.stop], numbers, s.digests(names, sizes), np.searchsorted(doc, np.arange(s.rows + 1)), pairs, times)
                if len(pairs):
                    held.append(np.unique(pairs, return_counts=True))
                if sum(len(c) for c, _ in held) > HELD:
                    held = summed()
                    if len(held[0][0]) > HELD // 2:
                        yield passed_on()
                        held = []
        if held:
            held = summed()
            yield passed_on()

    schema = f"kind int, `{key}` bigint, " + ", ".join(f"{c} bigint" for c in columns) + ", groups_sha256 string, a array<int>, b array<int>, times array<int>"
    return per_batch(docs.select(F.col(key).cast("bigint").alias(key), text), run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (a, b, n, best): how many documents hold a pair linked, and whether no pair of its A id is in more."""
    each = aligned.filter("kind = 1").select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("p.a", "p.b", "p.times")
    counts = written(each.groupBy("a", "b").agg(F.sum(F.col("times").cast("bigint")).alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("m"))
    out = written(counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("m")).alias("best")))  # a row for each id of A's vocabulary
    release(counts)
    return out


def _most_frequent(counts: DataFrame, most: int) -> tuple[int, dict]:
    """(least count, arrays of the pairs with that count or more): as many of the highest counts as stay within most rows."""
    scale = F.floor(F.log2("n") * 16).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(scale.alias("s")).agg(F.count("*").alias("m"), F.min("n").alias("n")).collect(), key=lambda r: -r.s):  # some hundreds of rows
        held += r.m
        if held > most:
            break
        least = r.n
    if least is None:
        least = 1 << 62
    got = counts.filter(F.col("n") >= least).orderBy("a", "b").toPandas()  # at most `most` rows
    return least, {c: got[c].to_numpy(t) for c, t in (("a", np.int64), ("b", np.int64), ("n", np.int64), ("best", bool))}


def cross_alignment(docs: DataFrame, text: str = "text", key: str = "doc_id", a: str = TOKENIZER_A, b: str = TOKENIZER_B, frequent: int = FREQUENT) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of docs.

    A link is an overlapping pair of token occurrences; the count of its ids is the number of documents that hold that pair
    linked. n_best are the links whose count no other pair of their A id exceeds, count_sum is the sum of counts over links,
    groups_sha256 the digest of `a,a|b;a|b,b`. Texts without tokens (see token_groups) have zeros and an empty digest.
    Repeated rows each count as a document, a null key stays null, other columns are not read, whole texts are aligned; an
    empty table gives an empty result.
    """
    files = _files(docs.sparkSession, a, b)
    aligned = written(_aligned(docs, text, key, files), by="kind")
    counts = pair_counts(aligned)
    least, known = _most_frequent(counts, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most `frequent` pairs
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        k = shared.value
        names = k.setdefault("codes", k["a"] << 32 | k["b"])
        for batch in batches:
            cuts = batch.column("a").offsets.to_numpy().astype(np.int64)
            x, y, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            cuts, doc = cuts - cuts[0], np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            code = x << 32 | y
            at = np.minimum(np.searchsorted(names, code), max(0, len(names) - 1))
            there = names[at] == code if len(names) else np.zeros(len(code), bool)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best, doc[there], (times * k["best"][at] if len(names) else times)[there])
            np.add.at(total, doc[there], (times * k["n"][at] if len(names) else times)[there])
            left = np.concatenate(([0], np.cumsum(~there)))[cuts]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~there].astype(np.int32))) for v in (x, y, times)]
            yield {**{c: batch.column(c) for c in (key, *numbers, "groups_sha256")}, "n_best": best, "count_sum": total, **dict(zip(("a", "b", "times"), rest, strict=True))}

    schema = f"`{key}` bigint, " + ", ".join(f"{c} bigint" for c in numbers) + ", groups_sha256 string, n_best bigint, count_sum bigint, a array<int>, b array<int>, times array<int>"
    out = per_batch(aligned.filter("kind = 0").select(key, *numbers, "groups_sha256", "a", "b", "times"), run, schema)
    columns = [key, *numbers, "n_best", "count_sum", "groups_sha256"]
    if counts.filter(F.col("n") < least).isEmpty():
        return out.select(*columns)
    out = written(out.withColumn("row_", F.monotonically_increasing_id()))
    rest = out.select("row_", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row_", "p.a", "p.b", "p.times")
    sums = rest.join(counts.filter(F.col("n") < least), ["a", "b"]).groupBy("row_").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("best_"), F.sum(F.col("times") * F.col("n")).alias("sum_"))
    both = out.join(sums, "row_", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("best_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_", F.lit(0))}).select(*columns)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two public tokenizers, aligned."""
    return cross_alignment(table(spark, sf_dir, "documents"))

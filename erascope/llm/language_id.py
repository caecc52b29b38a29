"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier for each bit says which half of the languages a text belongs
to, from hashed byte n-grams. Decoding adds a logistic loss over the bits for each codeword and takes the language of the
least loss, so a wrong bit or two is corrected by the others; a small gap between the two best flags ambiguity.

The classifiers are log-odds of n-gram frequencies. They need only the n-gram counts of each language, which every task
sums over its labelled texts and Spark adds up: all labelled texts are learned from, and what reaches the driver is
BUCKETS numbers for each language.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, per_batch, same_remainder, small_batches, table, texts

BUCKETS = 1 << 13
#: A text counts as at most so many n-grams of its language.
WEIGHT_OF_TEXT = 4000
SMOOTHING = 0.5
EXHAUSTIVE = 7
AMBIGUOUS = 0.6
SEED = 20
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(LOWER[c] if c >= 128 or 97 <= LOWER[c] <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L* is in it; digits, numerals such as Ⅷ or ½ and signs are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of a text's byte pairs and triples by hash bucket; A-Z are lower-cased, ASCII that is no letter is a space."""
    b = b" " + text.encode("utf-8", "replace").translate(_KEEP) + b" "
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    two = (a[:-1] << np.uint32(8)) | a[1:]
    three = (two[:-1] << np.uint32(8)) | a[2:]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    h2 = ((two + np.uint32(0x01000000)) * np.uint32(2654435761)) >> shift
    h3 = (three * np.uint32(2246822519)) >> shift
    return np.bincount(h2, minlength=BUCKETS) + np.bincount(h3, minlength=BUCKETS)


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1: all splits of the languages while there are few, else the best of some random dense codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        return np.array([(1, *s) for s in itertools.product((1, -1), repeat=k - 1)][1:]).T
    rng, length = np.random.default_rng(SEED), math.ceil(10 * math.log2(k))
    draws = (rng.choice((-1, 1), size=(k, length)) for _ in range(50))
    apart = lambda m: ((length - m @ m.T) / 2 + np.eye(k) * length).min()
    return max(draws, key=apart)


def learn(labelled: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights by bucket and bit) from all rows whose text and label are not null.

    Empty texts are learned as such, repeated rows each count, very long texts weigh as WEIGHT_OF_TEXT n-grams do. A table
    without such rows gives no languages.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, l in zip(texts(b, text), b.column(label).to_pylist(), strict=True):
                c = ngram_counts(t)
                s = sums.setdefault(l, np.zeros(BUCKETS))
                s += c * min(1.0, WEIGHT_OF_TEXT / max(1, c.sum()))
        for l, s in sums.items():
            at = np.flatnonzero(s)
            yield {"lang": [l] * len(at), "bucket": at.astype(np.int32), "n": s[at]}

    rows = labelled.select(text, label).filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    counts = per_batch(rows, run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most BUCKETS rows for each language
    languages = sorted(got["lang"].unique())
    dense = np.zeros((len(languages), BUCKETS))
    dense[got["lang"].map({l: i for i, l in enumerate(languages)}).to_numpy(dtype=int), got["bucket"].to_numpy(dtype=int)] = got["n"].round(6)
    share = (dense + SMOOTHING) / (dense + SMOOTHING).sum(axis=1, keepdims=True) if languages else dense
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1] if len(languages) else 1))
    for j in range(weights.shape[1] if len(languages) > 1 else 0):
        weights[:, j] = np.log(share[code[:, j] > 0].mean(axis=0)) - np.log(share[code[:, j] < 0].mean(axis=0))
    return languages, code, weights


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[int, float]:
    """(index of the language, score) by the least sum of logistic losses; the score is its share of exp(-loss)."""
    loss = np.logaddexp(0, -code * margins).sum(axis=1)
    like = np.exp(loss.min() - loss)
    best = int(loss.argmin())
    return best, float(like[best] / like.sum())


def identify(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, lang_pred, score, ambiguous), one for each row of docs, from the text alone.

    A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned. Texts are read
    whole. Repeated rows each give a row, a null key stays null, ties of loss go to the first language by name; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each bit

    def run(batches):
        languages, code, weights = shared.value
        for b in batches:
            said, score = [], []
            for t in texts(b, text):
                if not languages or not has_letter(t):
                    said.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                c = ngram_counts(t)
                i, s = decode(c @ weights / math.sqrt(c.sum()), code)
                said.append(languages[i])
                score.append(s)
            yield {key: b.column(key), "lang_pred": said, "score": score, "ambiguous": [s < AMBIGUOUS for s in score]}

    return per_batch(docs.select(key, text), run, f"`{key}` bigint, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model, text: str = "text", label: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """docs without those whose language is undetermined: null texts, texts that have no letter, and texts decoded as `und`
    where that was learned as a label; with languages given, also those decoded clearly as another one. A label that is null
    becomes the decoded language unless that is ambiguous. All columns stay.

    With nothing learned there is nothing to decode, and only null and letterless texts go. A text of no clear language
    stays, as does its label; repeated rows stay or go together; whole texts are read; an empty table gives an empty result.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    named = docs.columns.index(label) if label in docs.columns else None

    def run(batches):
        known, code, weights = shared.value
        for b in small_batches(batches):
            keep, said = [], b.column(named).to_pylist() if named is not None else None
            for k, t in enumerate(x or "" for x in b.column(at).to_pylist()):
                ok = has_letter(t)
                if ok and known:
                    c = ngram_counts(t)
                    i, score = decode(c @ weights / math.sqrt(c.sum()), code)
                    clear = score >= AMBIGUOUS
                    ok = known[i] != UNDETERMINED and (languages is None or not clear or known[i] in languages)
                    if said is not None and said[k] is None and clear:
                        said[k] = known[i]
                keep.append(ok)
            if said is not None:
                b = b.set_column(named, b.schema.field(named), pa.array(said, b.schema.field(named).type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~same_remainder(4, 2)))
    return identify(docs, model).select("doc_id", same_remainder(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")

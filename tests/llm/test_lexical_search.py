"""Ranked lexical search against a plain double loop."""

import math
import re
from collections import Counter

import pytest

from erascope.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    said = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in said if c), sum(sum(c.values()) for _, c in said)
    out = []
    for item, text in items:
        scored = []
        for doc, c in said:
            score = 0
            for t in set(terms(text)) & set(c):
                df = sum(1 for _, d in said if t in d)
                m = 10 + 90 * sum(c.values()) * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat, the CAT and the dog."),
    (2, "the cat the cat and the dog"),  # ties with the first
    (3, "ÄPFEL äpfel Äpfel x2 X2"),
    (4, None),
    (5, ""),
    (6, "... --- ..."),
    (7, "catalog dogcat cat's\x00cat_dog cat 🐈cat"),
    (8, "word " * 30_000 + "cat"),
    (None, "the cat"),
    (1, "the cat, the cat and the dog."),
    (9, "▁cat a  b\n\ncat\ttab"),
    *[(100 + i, "dog the copy") for i in range(30)],
]
ITEMS = [(1, "cat DOG"), (2, "äpfel x2 Äpfel"), (3, None), (4, ""), (5, "?!"), (6, "nothing of it"), (7, "the the the dog copy"), (8, "🐈cat cat's word")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, score string").repartition(7)


@pytest.mark.parametrize("block_chars", [10, 4_000_000])
def test_against_brute_force(spark, docs, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search(docs, items, block_chars=block_chars).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_empty_and_repeated(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert search(docs, none).count() == 0
    items = spark.createDataFrame([("a", "cat"), ("a", "cat")], "item_id string, text string")
    assert search(docs.limit(0), items).count() == 0
    twice = search(docs, items, k=2).collect()
    assert sorted((r.item_id, r["rank"]) for r in twice) == [("a", 1), ("a", 1), ("a", 2), ("a", 2)]

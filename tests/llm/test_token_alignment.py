"""Cross-tokenizer alignment against all pairs of tokens, with the libraries' own encoders."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from erascope.llm import token_alignment as ta

TEXTS = [
    "Hello world", "hello  world \n\n x", "", None, "a", " ", "   lead", "naïve café 🐈 ★ 日本語 ελληνικά", "</s><s>[INST] <|endoftext|> <unk> <0x41> ok",
    "with ▁ in it", "a▁ b", "\x00\x01 nul", "tab\tsep\r\nend ", "é ﬁ  　x", "Hello world", "1234567890 3.14", "x" * 3000, "word " * 500 + " " * 300 + "end", "don't we'll they've", "́ ‍​",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(ta.TOKENIZER_A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=ta.TOKENIZER_B)


def tokens(libraries, text):
    """([(id, start, end)] of A, of B) or two empty lists."""
    one, two = libraries
    if not text:
        return [], []
    of, out = ta.byte_alphabet(), []
    a = [(i, bytes(of[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in two.encode(text):
        p = two.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
    for side in (a, b):
        if b"".join(w for _, w in side) != b" " + text.encode():
            return [], []
        ends = np.cumsum([len(w) for _, w in side]).tolist()
        out.append([(i, e - len(w), e) for (i, w), e in zip(side, ends, strict=True)])
    return tuple(out)


def brute(libraries, texts):
    each, df = [], Counter()
    for t in texts:
        a, b = tokens(libraries, t)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 1500 else near(a, b)
        df.update(set(links))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x[0]) for x in a if low <= x[1] < c) + "|" + ",".join(str(y[0]) for y in b if low <= y[1] < c))
            low = c
        each.append((a, b, links, groups))
    top = Counter()
    for (x, _), n in df.items():
        top[x] = max(top[x], n)
    return [(len(a), len(b), len(g), len(l), sum(df[p] == top[p[0]] for p in l), sum(df[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, l, g in each]


def near(a, b):
    return [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]


def rows(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("frequent", [ta.FREQUENT, 40, 0])
def test_against_all_pairs(spark, libraries, frequent):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string").repartition(5)
    assert rows(ta.cross_alignment(docs, frequent=frequent)) == brute(libraries, TEXTS)


def test_small_counting_space(spark, libraries, monkeypatch):
    monkeypatch.setattr(ta, "HELD", 20)
    monkeypatch.setattr(ta, "SLICE", 40)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert rows(ta.cross_alignment(docs)) == brute(libraries, TEXTS)


def test_encoders_equal_the_libraries(spark, libraries):
    with open(ta.TOKENIZER_A, "rb") as a, open(ta.TOKENIZER_B, "rb") as b:
        one, two = ta.ByteLevel(a.read()), ta.Pieces(b.read())
    assert one.encode.__name__ == "encode_to_numpy"
    texts = [t for t in TEXTS if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("text").isNotNull()).select("text").collect()]
    for t in texts:
        assert one.encode(" " + t).tolist() == libraries[0].encode(" " + t, add_special_tokens=False).ids
        assert two.encode(t) == libraries[1].encode(t)


def test_real_outputs(spark, libraries):
    docs = spark.createDataFrame([(7, "naïve café 🐈"), (None, "naïve café 🐈"), (8, None)], "doc_id long, text string")
    got = ta.token_groups(docs).collect()
    a, b = tokens(libraries, "naïve café 🐈")
    for r in got[:2]:
        assert r.a_ids == [x[0] for x in a] and r.b_ids == [y[0] for y in b]
        want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert list(zip(r.a_linked, r.b_linked, strict=True)) == want
        assert r.a_groups[0] == 0 and max(r.a_groups) == max(r.b_groups)
    assert got[2].a_ids == got[2].b_linked == []
    assert ta.cross_alignment(docs.limit(0)).count() == 0

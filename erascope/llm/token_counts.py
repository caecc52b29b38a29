"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

Each task keeps the distinct pre-tokens it has met in a trie. A node holds the best forward score of its prefix and the
number of tokens on that best path, so a prefix that many pre-tokens share is scored once; a pre-token's count is read at
its terminal node. The trie is emptied when it reaches MAX_NODES nodes: results stay the same, memory stays bounded.
Pre-tokens longer than LONG characters are scored by the same recursion in a rolling window and not kept.

The vocabulary is any (piece, log-probability) list. The public vocabulary files hold no unigram probabilities; with
those, the r-th piece gets the Zipf score -ln(r + 2), which is a fixed rule and not trained. Characters in no piece cost
one token per UTF-8 byte (byte fallback), each at FALLBACK.

Ties between equally probable segmentations go to the one with the longest last token.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .common import per_batch, table, texts

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
FALLBACK = -20.0
MAX_NODES = 1_000_000
LONG = 200
META = "▁"


def zipf_vocabulary(path: str = TOKENIZER) -> dict[str, float]:
    """Pieces of a public sentencepiece file with scores by rank; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


def pre_tokens(text: str) -> list[str]:
    """Words between white space, each marked by a leading META."""
    return [META + w for w in text.split()]


class ForwardTrie:
    """Distinct pre-tokens with forward scores and counts at their prefixes. Edges are kept in one dict by (node, character)."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        self.pieces, self.longest, self.max_nodes = pieces, max(map(len, pieces), default=1), max_nodes
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            lengths.setdefault(p[-3:], set()).add(len(p))
        #: lengths of the pieces that end in some three characters (short pieces: in themselves), ascending
        self.lengths = {tail: sorted(n) for tail, n in lengths.items()}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        if len(word) > LONG:
            return self.roll(word)
        if len(self.score) >= self.max_nodes:
            self.clear()
        return self.insert(word)

    def best(self, word: str, end: int, score: list[float], tokens: list[int]) -> tuple[float, int]:
        """Forward score and count at word[:end]; score[k] and tokens[k] are those of word[:end - len(score) + k]."""
        c = word[end - 1]
        n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        top, count = score[-1] + n * FALLBACK, tokens[-1] + n
        get, lengths, held = self.pieces.get, self.lengths.get, len(score)
        for tail in (c, word[end - 2 : end] if end > 1 else "", word[end - 3 : end] if end > 2 else ""):
            for k in lengths(tail, ()):
                if k > held:
                    break
                p = get(word[end - k : end])
                if p is not None and score[-k] + p >= top:
                    top, count = score[-k] + p, tokens[-k] + 1
        return top, count

    def insert(self, word: str) -> int:
        node, path_score, path_tokens, edges = 0, [0.0], [0], self.edges
        for end, c in enumerate(word, 1):
            edge = node << 21 | ord(c)
            nxt = edges.get(edge)
            if nxt is None:
                s, t = self.best(word, end, path_score, path_tokens)
                nxt = edges[edge] = len(self.score)
                self.score.append(s)
                self.tokens.append(t)
            node = nxt
            path_score.append(self.score[node])
            path_tokens.append(self.tokens[node])
        return path_tokens[-1]

    def roll(self, word: str) -> int:
        score, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            s, t = self.best(word, end, score, tokens)
            score, tokens = [*score[-self.longest :], s], [*tokens[-self.longest :], t]
        return tokens[-1]


class _Memo(dict):
    def __init__(self, trie: ForwardTrie):
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_NODES // 2:
            self.clear()
        n = self[word] = self.trie.count(META + word)
        return n


def count_tokens(docs: DataFrame, pieces: Iterable[tuple[str, float]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_pretokens, n_tokens), one for each row of docs.

    Null and empty texts count 0. Texts of any length are read whole. Repeated rows each give a row; a null key stays
    null; other columns of docs are not read. An empty table gives an empty result. No shuffle: each task counts its rows.
    """
    vocabulary = dict(pieces) if pieces is not None else zipf_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a tokenizer's vocabulary: of fixed size

    def run(batches):
        counts = _Memo(ForwardTrie(shared.value))
        for b in batches:
            words = [t.split() for t in texts(b, text)]
            yield {key: b.column(key), "n_pretokens": [len(w) for w in words], "n_tokens": [sum(map(counts.__getitem__, w)) for w in words]}

    return per_batch(docs.select(key, text), run, f"`{key}` bigint, n_pretokens bigint, n_tokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))

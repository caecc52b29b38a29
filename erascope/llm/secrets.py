"""Secret scans, with weak candidates linked across the parts of a credential.

Three patterns are reported wherever they match. Beside them a credential may come in parts: an access identifier, a
secret of high entropy and an endpoint, none of which is telling on its own; access keys serve as identifiers too, and
assigned secrets and long hex as secrets. The parts of a text are intervals in its
scopes, and an interval join within a scope pairs each secret with its identifiers and endpoints. A scope is a paragraph
between blank lines; another pattern may end scopes (BLANK_LINE is the default), or none, so that a file with a setting a
paragraph is one. With a reach, only parts at most so many characters away are partners; without one, all of the scope are.
A weak secret is reported only if complementary
parts co-occur: an identifier and an endpoint, or an identifier of a telling form. All its partners are reported with it.

The parts of a text all come from one row, so the interval join is a merge of sorted starts inside the task: no shuffle,
no pairs, linear in the parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, small_batches, table, texts

MIN_ENTROPY = 3.5
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
_WEAK_ID = re.compile(r"""(?ai:(?<![a-z0-9])(?<!secret_)(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)\b)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.A)
_ENDPOINT = re.compile(r"(?ai:\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://)[A-Za-z0-9._~:/?#@!$&'*+,;=%-]{3,}", re.A)
#: What ends a scope.
BLANK_LINE = r"\n[ \t]*\n"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """The patterns that need no partner; offsets in code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [Span("hex", *m.span()) for m in _HEX_LONG.finditer(text)]
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def weak_parts(text: str, strong: bool = False) -> list[Span]:
    """Identifiers, secrets and endpoints that say nothing alone; none if there is no secret, these or a strong one."""
    parts = [Span("weak_secret", *m.span()) for m in _WEAK_SECRET.finditer(text) if entropy(m[0]) >= MIN_ENTROPY]
    if not parts and not strong:
        return []
    if ":" in text or "=" in text:
        parts += [Span("weak_id", *m.span(1)) for m in _WEAK_ID.finditer(text)]
    if "://" in text:
        parts += [Span("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return parts


def linked(text: str, base: list[Span], reach: int | None = None, scope: str | None = BLANK_LINE) -> list[Span]:
    """Weak parts whose complements co-occur in their scope, within reach characters if it is given. Parts inside a base span are
    no parts."""
    parts = weak_parts(text, any(s.kind != "access" for s in base))
    if not parts:
        return []
    held = sorted((s.start, s.end) for s in base)
    starts = [s for s, _ in held]

    def covered(p: Span) -> bool:
        i = bisect_right(starts, p.start) - 1
        return i >= 0 and held[i][1] > p.start or bisect_left(starts, p.end) > bisect_left(starts, p.start)

    parts = [p for p in parts if not covered(p)] + [Span("strong_id" if s.kind == "access" else "strong_secret", s.start, s.end) for s in base]
    cuts = [m.start() for m in re.finditer(scope, text)] if scope is not None else []
    reach = len(text) if reach is None else reach
    by: dict[tuple[int, str], list[Span]] = {}
    for p in sorted(parts, key=lambda p: (p.start, p.end)):
        by.setdefault((bisect_right(cuts, p.start), p.kind), []).append(p)
    out: set[Span] = set()
    for (place, kind), secrets in by.items():
        if kind not in ("weak_secret", "strong_secret"):
            continue
        others = {k: by.get((place, k), []) for k in ("weak_id", "endpoint", "strong_id")}
        at = {k: [p.start for p in v] for k, v in others.items()}
        edges = {k: [0] * (len(v) + 1) for k, v in others.items()}  # 1 where a linked secret's partners begin, -1 past them
        for s in secrets:
            near = {k: (bisect_left(at[k], s.start - reach), bisect_right(at[k], s.end + reach)) for k in others}
            has = {k: b > a for k, (a, b) in near.items()}
            if has["strong_id"] or has["weak_id"] and has["endpoint"]:
                if kind == "weak_secret":
                    out.add(s)
                for k in ("weak_id", "endpoint"):
                    a, b = near[k]
                    edges[k][a] += 1
                    edges[k][b] -= 1
        for k in ("weak_id", "endpoint"):
            out.update(p for p, n in zip(others[k], accumulate(edges[k])) if n > 0)
    return sorted(out, key=lambda p: (p.start, KINDS.index(p.kind)))


def scan(text: str, reach: int | None = None, scope: str | None = BLANK_LINE) -> list[Span]:
    """All spans of a text, by start, then kind as listed in KINDS."""
    base = base_spans(text)
    return sorted(base + linked(text, base, reach, scope), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int | None = None, scope: str | None = BLANK_LINE) -> DataFrame:
    """Rows (key, kinds, starts, ends), one for each row of docs; arrays in order of start. reach and scope: see linked().

    Null and empty texts have no spans. Very long texts are scanned whole. Repeated rows each give a row, a null key stays
    null, other columns are not read, an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            found = [scan(t, reach, scope) for t in texts(b, text)]
            yield {key: b.column(key), "kinds": [[s.kind for s in f] for f in found], "starts": [[s.start for s in f] for f in found], "ends": [[s.end for s in f] for f in found]}

    return per_batch(docs.select(key, text), run, f"`{key}` bigint, kinds array<string>, starts array<bigint>, ends array<bigint>")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", reach: int | None = None, scope: str | None = BLANK_LINE) -> DataFrame:
    """docs with every found span replaced by the mask; overlapping spans are replaced once. All columns stay. reach and scope:
    see linked().

    Null and empty texts stay as they are, very long texts are scanned whole, repeated rows each stay, whatever their keys; an empty table gives an empty result.
    """
    cols = docs.columns
    at = cols.index(text)

    def run(batches):
        for b in small_batches(batches):
            new = []
            for t in b.column(at).to_pylist():
                spans = scan(t, reach, scope) if t else []
                if spans:
                    parts, end = [], 0
                    for s in spans:
                        if s.end <= end:
                            continue
                        if s.start >= end:
                            parts += [t[end : s.start], mask]
                        end = s.end
                    t = "".join([*parts, t[end:]])
                new.append(t)
            arrays = list(b.columns)
            arrays[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document, base and linked."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("said")))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")
    return found.withColumn("spans_", spans).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(F.filter("spans_", lambda s: s["kind"].isin(*BASE)), lambda s: s["said"])), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans_", lambda s: s["said"])).alias("spans"),
        F.size(F.filter("kinds", lambda k: ~k.isin(*BASE))).cast("bigint").alias("n_linked"),
    )

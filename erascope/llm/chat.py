"""Chat formatting with typed content parts.

A visitor flattens a turn's parts in order: runs of adjacent texts are joined and escaped as one, so that no control string
forms across them; images, audio and documents become numbered placeholders whose references and expanded token counts are
recorded. The template marks turns with control strings; each begins with a
pattern that escaping breaks up inside texts and roles, so a formatted turn reads back exactly, and the loss mask is a span
of code points that never touches the template.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import small_batches, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED_ROLE = "assistant"
#: Strings that some tokenizer takes for control: none may stand in a text as they are.
_CONTROL = re.compile(r"(<)(\||/?s>|/?<?/?SYS>|unk>|pad>|start_of_turn>|end_of_turn>)|(\[)(/?INST\])")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|unknown):(\d+)\|>")
_TURN = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.S)


class Attachment(NamedTuple):
    ordinal: int
    kind: str
    reference: str | None
    tokens: int


def escape(text: str) -> str:
    """The text with backslashes doubled and one put inside each control string."""
    return _CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


class Flattener:
    """Visits the parts of one turn in order; a method for each kind of part. Any other kind leaves a placeholder of kind
    unknown and an attachment that says which kind it was, of one token."""

    KINDS = ("image", "audio", "document")

    def __init__(self, image_patch: int = 28, audio_rate: float = 12.5, chars_per_token: float = 4.0):
        self.image_patch, self.audio_rate, self.chars_per_token = image_patch, audio_rate, chars_per_token

    def visit(self, parts) -> tuple[str, list[Attachment]]:
        out, attached, said = [], [], []
        for p in parts or ():
            if p is None:
                continue
            kind = p.get("kind") or "text"
            got = getattr(self, f"visit_{kind}", self.visit_unknown)(p, len(attached))
            if isinstance(got, Attachment):
                attached.append(got)
                out += [escape("".join(said)), f"<|{got.kind if got.kind in self.KINDS else 'unknown'}:{got.ordinal}|>"]
                said = []
            else:
                said.append(got)
        return "".join([*out, escape("".join(said))]), attached

    def visit_text(self, p, _) -> str:
        return p.get("text") or ""

    def visit_image(self, p, ordinal) -> Attachment:
        tiles = lambda x: max(1, math.ceil((x or 0) / self.image_patch))
        return Attachment(ordinal, "image", p.get("ref"), tiles(p.get("width")) * tiles(p.get("height")))

    def visit_audio(self, p, ordinal) -> Attachment:
        return Attachment(ordinal, "audio", p.get("ref"), max(1, math.ceil((p.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, p, ordinal) -> Attachment:
        return Attachment(ordinal, "document", p.get("ref"), max(1, math.ceil((p.get("chars") or 0) / self.chars_per_token)))


    def visit_unknown(self, p, ordinal) -> Attachment:
        return Attachment(ordinal, p["kind"], p.get("ref"), 1)


def format_turn(role: str | None, parts, flattener: Flattener | None = None) -> tuple[str, int, int, list[Attachment]]:
    """(formatted turn, start and end of its content, attachments)."""
    content, attached = (flattener or Flattener()).visit(parts)
    head = f"{TURN}{escape(role or '')}{SAYS}"
    return f"{head}{content}{END}\n", len(head), len(head) + len(content), attached


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """(role, parts) of a formatted turn; a part is ('text', text) or (kind, ordinal)."""
    m = _TURN.match(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    parts, at = [], 0
    for p in _PLACEHOLDER.finditer(m[2]):
        parts += [("text", unescape(m[2][at : p.start()])), (p[1], p[2])]
        at = p.end()
    parts.append(("text", unescape(m[2][at:])))
    return unescape(m[1]), [p for p in parts if p != ("text", "")]


PARTS = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,chars:bigint>>"
ATTACHMENTS = pa.list_(pa.struct([("ordinal", pa.int64()), ("kind", pa.string()), ("reference", pa.string()), ("tokens", pa.int64())]))


def _typed(turns: DataFrame) -> bool:
    """Whether a column parts holds typed parts; a column of that name and another type is no part of a turn."""
    kind = turns.schema["parts"].dataType if "parts" in turns.columns else None
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "kind" in kind.elementType.names


def _by_name(turns: DataFrame):
    """The column parts with the fields of PARTS, taken by their names: those that it lacks are null, others are left out."""
    have = turns.schema["parts"].dataType.elementType.names
    wanted = StructType.fromDDL(f"p {PARTS}")["p"].dataType.elementType.fields
    return F.transform("parts", lambda p: F.when(p.isNotNull(), F.struct(*[(p[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]))).alias("parts")


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted row for each turn.

    turns: conv_id, turn, role and parts (an array of structs with a field kind; fields of PARTS are taken by name, those that are
    missing are null, others are not read), or text where there are no such parts. A part without a kind is a text; one of a
    kind that no visitor knows leaves a placeholder of kind unknown. The result has conv_id, turn, formatted, the
    loss mask as a span of code points of formatted (loss_start, loss_end; empty where the role is not learned),
    attachments and expanded_tokens, their sum. Null texts, parts and roles are empty; repeated and tied turns each give
    a row; ids and turns that are null stay null; texts of any length are formatted whole; an empty table gives an empty
    result; other columns are not read. No shuffle.
    """
    own = _typed(turns)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", ATTACHMENTS), ("expanded_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in small_batches(batches):
            rows = [format_turn(r, p if own else ({"kind": "text", "text": p},)) for r, p in zip(b.column("role").to_pylist(), b.column("parts" if own else "text").to_pylist(), strict=True)]
            learned = [r == LEARNED_ROLE for r in b.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("conv_id"),
                    b.column("turn"),
                    pa.array([f for f, *_ in rows], pa.string()),
                    pa.array([s for _, s, _, _ in rows], pa.int64()),
                    pa.array([e if y else s for (_, s, e, _), y in zip(rows, learned, strict=True)], pa.int64()),
                    pa.array([[a._asdict() for a in at] for *_, at in rows], ATTACHMENTS),
                    pa.array([sum(a.tokens for a in at) for *_, at in rows], pa.int64()),
                ],
                schema=schema,
            )

    picked = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), _by_name(turns) if own else F.col("text").cast("string"))
    return picked.mapInArrow(run, "conv_id bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint, attachments array<struct<ordinal:bigint,kind:string,reference:string,tokens:bigint>>, expanded_tokens bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from formatted turns alone: turns, digests of its texts and of the learned text.

    Turns are sorted inside their partition and digested as they pass, so a conversation of any length takes the memory
    of one batch. Turns with equal numbers go by their formatted text; a null number goes first; turns of a null
    conversation are one conversation. Repeated turns each count. An empty table gives an empty result.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, expanded_tokens bigint"

    def run(batches):
        now, state = None, None
        done: list[tuple] = []

        def close():
            if state is not None:
                n, turns, chars, loss, size, tokens = state
                done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in schema.split(", ")])
            done.clear()
            return out

        for b in small_batches(batches):
            for conv, text, start, end, tokens in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "expanded_tokens")), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, parts = read_turn(text)
                said = "".join(p for k, p in parts if k == "text")
                learned = unescape(_PLACEHOLDER.sub("", text[start:end]))
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += tokens
            if done:
                yield batch()
        close()
        if done:
            yield batch()

    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end", "expanded_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, schema)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_turns(turns.unionByName(probe)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|/?<?/?SYS>|unk>|pad>|start_of_turn>|end_of_turn>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + length(role) + 8 + 8 + 7 + 1)::BIGINT AS formatted_chars,
  0::BIGINT AS expanded_tokens
FROM f GROUP BY conv_id
"""

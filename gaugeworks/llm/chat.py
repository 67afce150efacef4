"""Chat formatting with a grammar round trip.

A turn is rendered, parsed again and compared with its source; where they differ, its text is escaped until they agree. Turns of system, user and assistant have markers of their own, other roles are named in theirs:

    <s>[SYS] text [/SYS]      <s>[INST] text [/INST]      <space>text </s>      <s>[ROLE] name [/ROLE] text </s>
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, with_fields

OPEN = {"system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": " "}
CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": " </s>"}
OTHER_OPEN, OTHER_NAME, OTHER_CLOSE = "<s>[ROLE] ", " [/ROLE] ", " </s>"
#: A control string with any number of backslashes after its first character; escaping adds one, reading takes one away. So no escaped text holds a control string, and texts that look escaped survive too.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\])")
BARE = re.compile(r"[<\[](?:/?s>|/?(?:SYS|INST|ROLE)\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?(?:SYS|INST|ROLE)\])")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class Parser:
    """Deterministic parser of rendered text, fed piece by piece; it holds the unfinished turn only.

    `feed` yields (role, text, start, end): both unescaped, and where the text stands in all that was fed."""

    def __init__(self) -> None:
        self.rest, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        self.rest += piece
        pos = 0
        while pos < len(self.rest) and (turn := self._turn(pos)):
            role, start, end, after = turn
            yield unescape(role), unescape(self.rest[start:end]), self.at + start, self.at + end
            pos = after
        self.rest, self.at = self.rest[pos:], self.at + pos

    def _turn(self, pos: int) -> tuple[str, int, int, int] | None:
        s = self.rest
        for role in ("system", "user"):
            if s.startswith(OPEN[role], pos):
                start, close = pos + len(OPEN[role]), CLOSE[role]
                break
        else:
            if s.startswith(OTHER_OPEN, pos):
                named = s.find(OTHER_NAME, pos)
                if named < 0:
                    return None
                role, start, close = s[pos + len(OTHER_OPEN) : named], named + len(OTHER_NAME), OTHER_CLOSE
            elif s.startswith(OPEN["assistant"], pos):
                role, start, close = "assistant", pos + 1, CLOSE["assistant"]
            else:
                return None
        end = s.find(close, start)
        return None if end < 0 else (role, start, end, end + len(close))


def _piece(role: str, name: str, text: str) -> tuple[str, int]:
    head = OPEN.get(role) or OTHER_OPEN + name + OTHER_NAME
    return head + text + (CLOSE.get(role) or OTHER_CLOSE), len(head)


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(piece, start, end of the text in it), such that parsing the piece gives exactly this turn and no control string stands within its text or name."""
    role, text = role or "", text or ""
    name, inner = role, text
    while True:
        piece, start = _piece(role, name, inner)
        parser = Parser()
        agrees = [(r, t) for r, t, _, _ in parser.feed(piece)] == [(role, text)] and not parser.rest
        if agrees and not BARE.search(inner) and not BARE.search(name):
            return piece, start, start + len(inner)
        if (name, inner) != (role, text):
            raise ValueError("escaping did not make the turn readable")
        name, inner = escape(role), escape(text)


def render(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with piece (its part of the formatted conversation), loss_start and loss_end (code points in the piece under the loss mask; both 0 but for the assistant). Row by row, no shuffle; a conversation's formatted text is its pieces in order of turn. Null roles and texts count as empty."""
    names = fresh(turns, "piece", "loss_start", "loss_end")
    schema = with_fields(turns, *zip(names, ("string", "integer", "integer"), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (role_col, text_col))
            rows = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            spoken = [r == "assistant" for r in roles]
            for name, values, kind in zip(names, ([p for p, _, _ in rows], [s * m for (_, s, _), m in zip(rows, spoken, strict=True)], [e * m for (_, _, e), m in zip(rows, spoken, strict=True)]), (pa.string(), pa.int32(), pa.int32()), strict=True):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    return turns.mapInArrow(run, schema)


class _Reader:
    """Reads one conversation's pieces back and sums it up; texts are hashed as they come, not kept."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.parser, self.turns, self.chars, self.loss, self.same = conv, Parser(), 0, 0, 0, True
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str | None, text: str | None, piece: str, start: int, end: int) -> None:
        found = list(self.parser.feed(piece))
        self.same &= [(r, t) for r, t, _, _ in found] == [(role or "", text or "")]
        for r, t, _, _ in found:
            self.turns += 1
            self.turn_hash.update(f"{r}\n{t}\n".encode())
        learned = unescape(piece[start:end])
        self.loss += len(learned)
        self.loss_hash.update(learned.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.same and not self.parser.rest


READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, round_trip boolean"


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, from the pieces of render(): the parsed turns, the text under the mask, and whether the turns are those of the source.

    Pieces are dealt by conversation, sorted on disk if need be and read one after another, so that a conversation of any length takes the memory of its longest turn. Equal turn numbers are ordered by role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("round_trip", pa.bool_())])
        reader: _Reader | None = None
        for batch in batches:
            done = []
            for conv, role, text, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "piece", "loss_start", "loss_end")), strict=True):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.add(role, text, piece, start, end)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(reader.row(), schema.types, strict=True)], schema=schema)

    columns = rendered.select("conv_id", "turn", "role", "text", "piece", "loss_start", "loss_end")
    return columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, READ_SCHEMA)


def conversations_text(rendered: DataFrame) -> DataFrame:
    """conv_id and the whole formatted conversation as one string, for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("formatted"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 that says control strings, formatted and read back.

    Null texts and roles: empty. Null conv_id: one conversation of its own. Null turn: first. Repeated rows are turns of their own. No rows: conversation -1 alone."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    return read_back(render(turns.unionByName(own)))


#: DuckDB: what is read back equals the source; formatted_chars follows from the template. Texts of the given tables hold control strings in conversation -1 only, where each has one backslash more.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, regexp_matches(text, '[<\[]\\*(/?s>|/?(SYS|INST|ROLE)\])') AS tricky,
  length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\])', '\1\\\2\3', 'g')) AS escaped FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN tricky THEN escaped ELSE length(text) END + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 23 + length(role) END)::BIGINT AS formatted_chars,
  true AS round_trip
FROM p GROUP BY conv_id
"""

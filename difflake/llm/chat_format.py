"""Chat formatting by a finite-state machine over roles: text segments with loss flags from a declarative template, and their reader."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take

#: Characters of segments that are held before they are handed on.
_FLUSH = 4_000_000


@dataclass(frozen=True)
class Template:
    """What a conversation looks like and which orders of turns it may have.

    heads: what opens a turn of each role; other: what opens the turn of any other role, which follows as JSON;
    tail: what closes a turn, from a line of its own; trained: roles whose texts are learnt.
    moves: state -> role -> next state, from `start`; accept: states in which a conversation may end.
    """

    heads: dict[str, str]
    other: str
    tail: str
    trained: frozenset[str]
    moves: dict[str, dict[str, str]]
    accept: frozenset[str]
    start: str = "start"

    def controls(self) -> list[str]:
        return [*(h.strip() for h in self.heads.values()), self.other, self.tail.strip()]


CHAT = Template(
    heads={"system": "### System:\n", "user": "### User:\n", "assistant": "### Assistant:\n"},
    other="### Role ",
    tail="\n</turn>\n",
    trained=frozenset({"assistant"}),
    moves={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    accept=frozenset({"assistant"}),
)


class Escapes:
    """Control strings inside texts get one more backslash than they have; real ones have none, since a tail follows a line end."""

    def __init__(self, template: Template):
        any_control = "|".join(map(re.escape, template.controls()))
        self._bare, self._marked = re.compile(rf"(\\*(?:{any_control}))"), re.compile(rf"\\(\\*(?:{any_control}))")

    def add(self, text: str) -> str:
        return self._bare.sub(r"\\\1", text)

    def remove(self, text: str) -> str:
        return self._marked.sub(r"\1", text)


class _Writer:
    """The machine: takes the turns of one conversation in order and gives their segments."""

    def __init__(self, template: Template, escapes: Escapes):
        self.template, self.escapes, self.state = template, escapes, template.start

    def turn(self, role: str, text: str) -> list[tuple[str, bool, str | None]]:
        t = self.template
        after = t.moves.get(self.state, {}).get(role)
        problem = None if after else f"{role or 'no role'} after {self.state}"
        self.state = after or (role if role in t.moves else self.state)
        head = t.heads.get(role) or f"{t.other}{json.dumps(role, ensure_ascii=False)}:\n"
        return [(head, False, problem), (self.escapes.add(text), role in t.trained, None), (t.tail, False, None)]

    def end(self) -> tuple[str, bool, str | None]:
        return "", False, None if self.state in self.template.accept else f"ends after {self.state}"


class _Reader:
    """Turns and learnt text of one conversation, read from its output bit by bit: no more than a turn is held."""

    def __init__(self, template: Template, escapes: Escapes):
        self.template, self.escapes = template, escapes
        known = "|".join(re.escape(h) for h in template.heads.values())
        self.head = re.compile(rf'({known})|{re.escape(template.other)}("(?:[^"\\]|\\.)*"):\n')
        self.roles = {h: r for r, h in template.heads.items()}
        self.role, self.rest, self.at, self.learnt = None, "", 0, []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.n_loss = self.n_chars = 0

    def feed(self, text: str, loss: bool) -> None:
        self.n_chars += len(text)
        if loss:
            self.learnt.append(text)
        elif self.learnt:
            self._learn()
        self.rest += text
        while True:
            if self.role is None:
                head = self.head.match(self.rest)
                if not head:
                    return
                self.role = self.roles[head[1]] if head[1] else json.loads(head[2])
                self.rest, self.at = self.rest[head.end() :], 0
            tail = self.template.tail
            end = self.rest.find(tail, self.at)
            if end < 0:
                self.at = max(0, len(self.rest) - len(tail) + 1)
                return
            self.turns.update(f"{self.role}\n{self.escapes.remove(self.rest[:end])}\n".encode())
            self.n_turns += 1
            self.role, self.rest = None, self.rest[end + len(tail) :]

    def _learn(self) -> None:
        plain = self.escapes.remove("".join(self.learnt))
        self.learnt.clear()
        self.n_loss += len(plain)
        self.loss.update(plain.encode())

    def done(self) -> tuple[int, str, int, str, int]:
        if self.learnt:
            self._learn()
        if self.role is not None or self.rest:
            raise ValueError("the output ends inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.n_chars


def chat_segments(conversations: DataFrame, template: Template = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of all conversations: id, segment (from 0), text, loss, problem, last.

    The texts of a conversation's segments, joined, are its formatted text. Every turn is formatted, whatever the
    machine says: `problem` on its first segment tells that its role may not follow, and the machine goes on from that
    role; an unknown role does not move it. The last segment is empty and tells whether the conversation may end there.
    Rows are ordered by turn (null first), ties by role and text; repeated rows are turns of their own. A null text or
    role is empty. Rows with a null id are one conversation. An empty table has no segments.

    Conversations are shuffled once and sorted on disk; turns then pass through one by one, so memory is bounded by
    a turn, however long a conversation is. Its segments are in one partition, in order. Since digests run from its
    first turn to its last, one conversation is one task's work.
    """
    slim = take(conversations, id_col, turn_col, role_col, text_col).toDF("id", "turn", "role", "body")
    kind = slim.schema["id"].dataType.simpleString()
    ordered = slim.repartition("id").sortWithinPartitions("id", "turn", "role", "body")
    rows = ordered.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("body", F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes, writer, current, n, chars = Escapes(template), None, None, 0, 0
        out, id_type = [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (id_type, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "segment", "text", "loss", "problem", "last"])
            out.clear()
            return made

        for batch in batches:
            id_type = batch.column(0).type
            for key, role, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or key != current:
                    if writer is not None:
                        out.append((current, n, *writer.end(), True))
                    writer, current, n = _Writer(template, escapes), key, 0
                for segment in writer.turn(role, body):
                    out.append((key, n, *segment, False))
                    n += 1
                chars += len(body)
                if chars > _FLUSH:
                    yield flush()
                    chars = 0
        if writer is not None:
            out.append((current, n, *writer.end(), True))
            yield flush()

    return rows.mapInArrow(run, f"id {kind}, segment long, text string, loss boolean, problem string, last boolean").withColumnRenamed("id", id_col)


def read_back(segments: DataFrame, template: Template = CHAT, id_col: str = "conv_id") -> DataFrame:
    """What stands in the formatted text and under its loss mask: one row per conversation.

    Takes segments in the order in which chat_segments() gives them. Turns are found in the joined text alone, by its
    heads and tails; text under the mask is told by the flags alone. Raises an error if a text ends inside a turn.
    """
    slim = take(segments, id_col, "text", "loss", "problem", "last").withColumnRenamed(id_col, "id")
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes, reader, problems = Escapes(template), None, []
        for batch in batches:
            out = []
            for key, text, loss, problem, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None:
                    reader, problems = _Reader(template, escapes), []
                reader.feed(text, loss)
                if problem and len(problems) < 3:
                    problems.append(problem)
                if last:
                    out.append((key, *reader.done(), not problems, "; ".join(problems) or None))
                    reader = None
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = (batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "problems"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problems string"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: A conversation whose texts hold the template's own control strings, one of them marked already.
PROBE = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = take(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(chat_segments(conversations.union(probe))).drop("problems")


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), moves AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') || '>' || role AS move,
    CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 ELSE 15 END + 9
      + length(regexp_replace(text, '(\\*(?:### (?:System:|User:|Assistant:|Role )|</turn>))', '\\\1', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(move IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND arg_max(role, turn) = 'assistant' AS valid
FROM moves GROUP BY conv_id
"""

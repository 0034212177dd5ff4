"""Chat formatting: incremental black-box rendering.

A template is any function of a list of turns that returns a text. Nothing of
it is assumed: successive prefixes of a conversation are rendered and
consecutive outputs compared. What a turn adds is its span; a template that
changes what it has written before shows as a start before the end of the
last output.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions


class Turn(NamedTuple):
    role: str
    text: str


Template = Callable[[Sequence[Turn]], str]

#: A context is cut once it has so many turns or its output so many code points.
BLOCK_TURNS, BLOCK_CHARS = 64, 1_000_000
#: Turns besides the first that stay in a cut context.
CARRIED = 2
#: Turns that an output batch holds at most, and its code points, about.
BATCH_TURNS, BATCH_CHARS = 2000, 4_000_000

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)


def escaped(text: str) -> str:
    """A backslash before each control string (and backslash) of a text."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The default template: ``### role: text</turn>`` and a line end. After
    escaping no text holds a control string without a backslash."""
    return "".join(f"### {escaped(r).replace(':', chr(92) + ':')}: {escaped(t)}</turn>\n" for r, t in turns)


def read_turn(piece: str) -> Turn:
    """The turn that `marked_turns` wrote as ``piece``."""
    m = _TURN.fullmatch(piece)
    if m is None:
        raise ValueError("not a turn of this template")
    return Turn(unescaped(m[1]), unescaped(m[2]))


class Step(NamedTuple):
    """What one turn changed: the output up to ``start`` stayed, ``piece``
    follows it. ``rewritten``: the output before had gone beyond ``start``.
    ``body``: where in the output the turn's own text stands, if it was
    looked for and the template shows it in one place."""
    start: int
    piece: str
    rewritten: bool
    body: tuple[int, int] | None


def _body(template: Template, before: list[Turn], role: str, piece: str, start: int) -> tuple[int, int] | None:
    """Two probes that differ in their text only differ in its place only."""
    a, b = (template([*before, Turn(role, x)])[start:] for x in ("a", "b"))
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
    if len(piece) < head + tail or piece[:head] != a[:head] or tail and piece[-tail:] != a[-tail:]:
        return None
    return head, len(piece) - tail


class Rendering:
    """The rendering of one conversation, a turn at a time.

    A context that has grown to a block is cut to the first turn and the last
    ``CARRIED`` if the last turn's piece comes out the same in the cut one;
    else it keeps growing (each turn then costs a rendering of all turns). So
    the work follows the text for templates that look back a bounded way."""

    def __init__(self, template: Template, loss_roles: Sequence[str]):
        self.template, self.loss_roles = template, loss_roles
        self.context: list[Turn] = []
        # what a template writes for no turns belongs to the first one
        self.out, self.base = "", 0

    def add(self, turn: Turn) -> Step:
        before, last = self.context, self.out
        self.context = [*before, turn]
        self.out = now = self.template(self.context)
        start = len(last) if now.startswith(last) else len(os.path.commonprefix([last, now]))
        rewritten, piece, at = start < len(last), now[start:], self.base + start
        body = None
        if turn.role in self.loss_roles and not rewritten:
            body = _body(self.template, before, turn.role, piece, start)
        if len(self.context) >= BLOCK_TURNS or len(now) >= BLOCK_CHARS:
            self._cut(piece, rewritten)
        return Step(at, piece, rewritten, None if body is None else (at + body[0], at + body[1]))

    def _cut(self, piece: str, rewritten: bool) -> None:
        if rewritten or len(self.context) <= CARRIED + 1:
            return
        kept = [self.context[0], *self.context[-CARRIED:]]
        before, now = self.template(kept[:-1]), self.template(kept)
        if now.startswith(before) and now[len(before):] == piece:
            self.base += len(self.out) - len(now)
            self.context, self.out = kept, now


FORMATTED = ("conv_id long, pos long, role string, start long, end long, piece string, rewritten boolean, "
             "body_start long, body_end long")


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, role and text (null: empty), the rows of a conversation in one
    partition, one after the other by turn (null first), then role, text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_partitions(conversations.sparkSession)
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def format_conversations(conversations: DataFrame, template: Template = marked_turns,
                         loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """A row for each turn: conv_id, pos (from 0), role, start, end and piece
    (the output is the pieces one after the other, each put at its start),
    rewritten (the turn changed output before it: from ``start`` on, earlier
    spans don't hold), body_start and body_end (place of the turn's text if
    its role is one of ``loss_roles``; the loss mask is these spans).
    Offsets are code points in the conversation's output.

    Rows of a conversation stay in order in one task, which holds a block of
    its turns (`Rendering`), never the conversation; its output and digests
    follow one another, so that a conversation is not split over tasks.

    Null role and text are empty ones. Rows that tie in turn go by role, then
    text; repeated rows are turns each. Null conv_id is a conversation like
    any other. An empty table gives no rows. Columns besides conv_id, turn,
    role and text are ignored. Very long texts are turns like others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FORMATTED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(),
                 pa.int64()]
        rows: list[tuple] = []
        chars, key, state, pos = 0, None, None, 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != key:
                    key, state, pos = conv, Rendering(template, loss_roles), 0
                s = state.add(Turn(role, text))
                rows.append((conv, pos, role, s.start, s.start + len(s.piece), s.piece, s.rewritten,
                             *(s.body or (None, None))))
                pos, chars = pos + 1, chars + len(s.piece)
                if len(rows) >= BATCH_TURNS or chars >= BATCH_CHARS:
                    yield batch()
                    rows, chars = [], 0
        if rows:
            yield batch()

    return in_order(conversations).mapInArrow(run, FORMATTED)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the pieces that
    `format_conversations` made by `marked_turns`: n_turns, turns_sha256 (of
    role, line end, text, line end of all turns), loss_chars and loss_sha256
    (of the text under the loss mask, unescaped), formatted_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(done: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in DIGESTS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*done))],
                names=names)

        done: list[tuple] = []
        key, state = None, None
        close = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for b in batches:
            cols = ("conv_id", "start", "piece", "body_start", "body_end")
            for conv, start, piece, first, last in zip(*(b.column(c).to_pylist() for c in cols)):
                if state is None or conv != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = read_turn(piece)
                state[0] += 1
                state[1].update(f"{turn.role}\n{turn.text}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
                if first is not None:
                    text = unescaped(piece[first - start:last - start])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                if len(done) >= BATCH_TURNS:
                    yield row(done)
                    done = []
        if state is not None:
            done.append(close())
            yield row(done)

    return formatted.mapInArrow(run, DIGESTS)


#: A conversation whose texts hold the template's control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of all rows, and conversation -7 of a user
    and an assistant row that both say `PROBE_TEXT`."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = rows.sparkSession.range(2).select(
        F.lit(PROBE_ID).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PROBE_TEXT).alias("text"))
    return rows.unionByName(probe.select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))


#: The result of ``digests`` for `marked_turns` in DuckDB.
DIGEST_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, '### ' || replace(regexp_replace(role, '\\|###|</turn>', '\\\0', 'g'), ':', '\:') || ': '
  || regexp_replace(text, '\\|###|</turn>', '\\\0', 'g') || '</turn>' || chr(10) AS piece FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

"""Chat formatting with a grammar round trip: what is rendered is parsed again, and escaped until the turns come back.

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline

A backslash before a control string, or before a backslash, is an escape.  A control string without one is markup
wherever it stands, so text that holds one, or that ends in a backslash, comes back different; such a turn is
rendered again with its control strings escaped, and then with its backslashes escaped too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, slices

OPEN, COLON, CLOSE, END = "### ", ": ", "</turn>", "\n"
ASSISTANT = "assistant"
#: Formatted text of a conversation is written in pieces of about so many code points; a turn is never cut.
PIECE = 1 << 20

_MARK, _BACK = "###", "\\"
#: Control strings of a turn's text and of its role.
_IN_TEXT, _IN_ROLE = (_MARK, CLOSE), (_MARK, CLOSE, COLON)
_TOKEN = {kinds: re.compile("|".join([r"\\\\", *(r"\\" + re.escape(k) for k in kinds), *map(re.escape, kinds)])) for kinds in (_IN_TEXT, _IN_ROLE)}
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PIECE = "conv_id long, piece long, last boolean, text string, loss array<struct<start:long,end:long>>"


class Malformed(ValueError):
    """Text that the grammar does not derive."""


def _field(text: str, at: int, kinds: tuple[str, ...], stop: str) -> tuple[str, int, int]:
    """(the field unescaped, where it ends, where the text goes on) of a field that begins at `at` and ends before `stop`."""
    out, begin = [], at
    while True:
        m = _TOKEN[kinds].search(text, at)
        if m is None:
            raise Malformed(f"no {stop!r} after {begin}")
        out.append(text[at : m.start()])
        token = m.group()
        if token[0] == _BACK:
            out.append(token[1:])
        elif token == stop:
            return "".join(out), m.start(), m.end()
        else:
            raise Malformed(f"{token!r} at {m.start()}")
        at = m.end()


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end: where its text stands.  Reads from left to right, without going back."""
    at, out = 0, []
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Malformed(f"no turn at {at}")
        role, _, begin = _field(text, at + len(OPEN), _IN_ROLE, COLON)
        body, end, at = _field(text, begin, _IN_TEXT, CLOSE)
        if not text.startswith(END, at):
            raise Malformed(f"no line end at {at}")
        at += len(END)
        out.append((role, body, begin, end))
    return out


def escaped(text: str, kinds: tuple[str, ...]) -> str:
    for k in kinds:
        text = text.replace(k, _BACK + k)
    return text


def render(role: str, text: str) -> str:
    """One turn; control strings are escaped where the plain turn does not come back, backslashes where that is not enough."""
    for backs, marks in ((False, False), (False, True), (True, True)):
        r, t = (escaped(role, (_BACK,)), escaped(text, (_BACK,))) if backs else (role, text)
        if marks:
            r, t = escaped(r, _IN_ROLE), escaped(t, _IN_TEXT)
        out = OPEN + r + COLON + t + CLOSE + END
        try:
            if [turn[:2] for turn in parse(out)] == [(role, text)]:
                return out
        except Malformed:
            pass
    raise AssertionError("a turn with all its control strings and backslashes escaped comes back")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))


def _out(rows: list[tuple]) -> pa.RecordBatch:
    conv, piece, last, text, loss = zip(*rows) if rows else ([],) * 5
    spans = [[{"start": a, "end": b} for a, b in x] for x in loss]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(last, pa.bool_()), pa.array(text, pa.string()), pa.array(spans, _SPAN)], names=["conv_id", "piece", "last", "text", "loss"])


def format_conversations(turns: DataFrame, piece_chars: int = PIECE) -> DataFrame:
    """(conv_id, piece, last, text, loss): conversations as formatted text, with the spans (code points) that loss counts.

    turns: (conv_id, turn, role, text); rows of a conversation are taken by turn (null first), ties by role and text,
    repeated rows stay.  Null role or text: empty.  Rows of a null conv_id are one conversation.  A conversation is
    one piece but for long ones, which are cut between turns; its pieces joined are its text.  One shuffle; tasks
    stream their sorted rows and hold one piece, so a conversation of any length takes bounded memory.
    loss covers what assistants say, escapes included, and nothing of the template.
    """
    empty = F.lit("")
    plain = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[str] = []
        loss: list[tuple[int, int]] = []
        now, piece, size, ready = None, 0, 0, 0

        def close(last: bool) -> None:
            nonlocal held, loss, size, piece, ready
            rows.append((now, piece, last, "".join(held), loss))
            held, loss, ready, size, piece = [], [], ready + size, 0, piece + 1

        begun = False
        for conv, role, text in _turns(batches):
            if begun and conv != now:
                close(True)
                piece = 0
            elif begun and size >= piece_chars:
                close(False)
            now, begun = conv, True
            turn = render(role, text)
            if role == ASSISTANT:
                _, _, start, end = parse(turn)[0]
                loss.append((size + start, size + end))
            held.append(turn)
            size += len(turn)
            if ready >= piece_chars:
                yield _out(rows)
                rows, ready = [], 0
        if begun:
            close(True)
        yield _out(rows)

    return dealt.mapInArrow(work, _PIECE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' digests from their pieces, which follow each other in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    n = loss_chars = chars = 0
    turns, said = hashlib.sha256(), hashlib.sha256()
    for batch in slices(batches):
        rows = []
        for conv, last, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "text", "loss"))):
            for role, body, _, _ in parse(text):
                turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for span in loss:
                body, _, _ = _field(text[span["start"] : span["end"]] + CLOSE, 0, _IN_TEXT, CLOSE)
                said.update(body.encode("utf-8", "surrogatepass"))
                loss_chars += len(body)
            chars += len(text)
            if last:
                rows.append((conv, n, turns.hexdigest(), loss_chars, said.hexdigest(), chars))
                n = loss_chars = chars = 0
                turns, said = hashlib.sha256(), hashlib.sha256()
        kinds = [pa.string() if c.endswith("256") else pa.int64() for c in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """A row a conversation, from its formatted pieces alone: turns, digests of them and of the text under the loss mask.

    loss_chars and loss_sha256 are of the assistants' texts, unescaped, one after another.  Conversations of one
    piece are read where they stand; the pieces of others meet by conversation, in order.  A digest is a chain, so a
    conversation of many pieces is one stream of one task.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    lone = F.col("last") & (F.col("piece") == 0)
    many = formatted.where(~lone).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return formatted.where(lone).mapInArrow(_digests, schema).unionByName(many.mapInArrow(_digests, schema))


def round_trip(turns: DataFrame) -> DataFrame:
    """Format all conversations, write them, and read the digests back.

    The written table stays in the shared folder, as the result reads it.
    """
    return digest(materialize(format_conversations(turns), "chat"))

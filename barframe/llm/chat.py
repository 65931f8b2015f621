"""Chat formatting: event logs folded into messages, messages rendered with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 20
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(SPAN))])
PARTS_SQL = "conv_id long, part long, text string, loss array<struct<start: long, end: long>>"
DIGEST_SQL = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_TEXT, _ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    """Puts a backslash before every character that a control string needs."""
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the place of its text in it."""
    head, body = f"### {escape(role, _ROLE)}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; raises where the text doesn't follow the template."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def fold(events: Iterator[dict]) -> tuple[str, str]:
    """(role, text) of one message from its events in sequence; events of unknown or null kind change nothing."""
    role, text = "", []
    for e in events:
        kind, payload = e["kind"], e["payload"] or ""
        if kind == "open":
            role, text = e["role"] or "", [payload]
        elif kind == "delta":
            text.append(payload)
        elif kind == "edit":
            text = [payload]
        elif kind == "regenerate":
            text = []
    return role, "".join(text)


def _render(roles: tuple[str, ...], part_chars: int):
    def events(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                yield from b.slice(lo, 1024).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for conv_id, log in groupby(events(batches), lambda e: e["conv_id"]):
            part, pieces, loss, at = 0, [], [], 0
            for _, message in groupby(log, lambda e: e["message"]):
                role, text = fold(message)
                turn, start, end = render_turn(role, text)
                if pieces and at + len(turn) > part_chars:
                    out.append({"conv_id": conv_id, "part": part, "text": "".join(pieces), "loss": loss})
                    held += at
                    part, pieces, loss, at = part + 1, [], [], 0
                if role in roles:
                    loss.append({"start": at + start, "end": at + end})
                pieces.append(turn)
                at += len(turn)
                if held > part_chars:
                    yield pa.RecordBatch.from_pylist(out, PARTS)
                    out, held = [], 0
            out.append({"conv_id": conv_id, "part": part, "text": "".join(pieces), "loss": loss})
            held += at
        if out:
            yield pa.RecordBatch.from_pylist(out, PARTS)

    return run


def render(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), part_chars: int = PART) -> DataFrame:
    """Formatted conversations from a log: ``conv_id, part, text, loss``.

    ``events``: ``conv_id, message, seq, kind, role, payload``, partitioned here by conversation and sorted by message
    and sequence. ``open`` starts a message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties
    it; an edit that arrives later sorts to its own message, so a task holds one message at a time. Messages without
    ``open`` have an empty role; null roles and payloads are empty; events of another kind, or null, change nothing, and a
    message of such alone is an empty turn; other columns are ignored.

    ``text`` marks each turn and escapes the marks' characters inside texts; ``loss`` gives the places of the
    ``loss_roles``' texts in it. Conversations are cut between turns into parts of about ``part_chars``, so their length
    isn't bounded by a row. Events of one sequence number are taken in the order of kind and payload.
    """
    log = events.select("conv_id", "message", "seq", "kind", "role", "payload")
    dealt = log.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "message", "seq", "kind", "payload")
    return dealt.mapInArrow(_render(tuple(loss_roles), part_chars), PARTS_SQL)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for i in range(b.num_rows):
                yield b.slice(i, 1).to_pylist()[0]

    out = []
    for conv_id, parts in groupby(rows(), lambda r: r["conv_id"]):
        turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for p in parts:
            for role, text in read_turns(p["text"]):
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for span in p["loss"]:
                text = unescape(p["text"][span["start"] : span["end"]])
                loss.update(text.encode())
                loss_chars += len(text)
            chars += len(p["text"])
        out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) >= 4096:
            yield _digests(out)
            out = []
    if out:
        yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation what can be read back from ``render``'s rows, which must come as it left them: in its partitions and order."""
    return parts.mapInArrow(_digest, DIGEST_SQL)


def as_log(turns: DataFrame, order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """A streamed log that folds to the given turns: user turns as a draft and its edit, others as a draft that is
    regenerated in two deltas. Repeated rows are turns of their own."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in order])).cast("long")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(seq: int, kind: str, payload=None):
        body = F.lit(None).cast("string") if payload is None else payload
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), body.alias("payload"))

    edited = F.array(event(0, "open"), event(1, "delta", first), event(2, "edit", text))
    again = F.array(
        event(0, "open"), event(1, "delta", second), event(2, "regenerate"), event(3, "delta", first), event(4, "delta", second)
    )
    log = turns.select("conv_id", "role", place.alias("message"), F.when(F.col("role") == "user", edited).otherwise(again).alias("e"))
    return log.select("conv_id", "message", "role", F.explode("e").alias("e")).select("conv_id", "message", "role", "e.*")

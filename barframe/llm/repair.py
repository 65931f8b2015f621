"""Repair of conversation structure: faults of turns, and the cheapest edits that make the roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.session import materialise

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LETTERS = "DIKR"  # delete, insert, keep, rerole: their digits are 1 to 4 in this order, the ASCII order; 0 ends an audit
DIGIT = 3  # bits of a letter
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends with so far
OWN = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
MAY = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}  # after which states a role may come
ROLES = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}  # the role that is due in a state
REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
TURN_SQL = "conv_id long, place long, edit string, role string, text string"
TURN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # on top, for a truncated turn that stays


def cheapest(rows: Sequence[tuple[str, bool, bool]], costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of ``rows``: (initial of the role, whether it must go, whether it is truncated).

    A way from a row to the end weighs one integer: the cost in the high digits, below it as many digits as edits can be,
    the first edit's letter in the highest, zeros after the last. So the integers' order is that of costs, then of
    audits. An edit before a way moves the way's letters one digit down and writes its own above them. Dynamic
    programming from the last row to the first takes the least integer in each state; more than one inserted turn of a
    role in one place never pays, so that 3 * rows + 2 digits hold every audit.
    """
    low = DIGIT * (3 * len(rows) + 2)
    mask, never = (1 << low) - 1, 1 << (low + 128)
    lead = {c: (k + 1) << (low - DIGIT) for k, c in enumerate(LETTERS)}

    def edit(letter: str, cost: int, way: int) -> int:
        if way >= never:
            return never
        return (way >> low) + cost << low | lead[letter] | (way & mask) >> DIGIT

    def inserted(ways: list[int]) -> list[int]:
        user = min(ways[USER], edit("I", costs.insert, ways[ASSISTANT]))
        assistant = min(ways[ASSISTANT], edit("I", costs.insert, ways[USER]))
        first = edit("I", costs.insert, user)
        return [min(ways[START], first), min(ways[SYSTEM], first), user, assistant]

    ways = inserted([0, never, never, 0])
    for initial, must_go, truncated in reversed(rows):
        before = [edit("D", costs.delete, way) for way in ways]
        if not must_go:
            more = costs.truncated if truncated else 0
            user, assistant = edit("R", costs.rerole + more, ways[USER]), edit("R", costs.rerole + more, ways[ASSISTANT])
            for state in MAY[USER]:
                before[state] = min(before[state], user)
            for state in MAY[ASSISTANT]:
                before[state] = min(before[state], assistant)
            if initial in OWN:
                kept = edit("K", more, ways[OWN[initial]])
                for state in MAY[OWN[initial]]:
                    before[state] = min(before[state], kept)
        ways = inserted(before)
    best, audit = ways[START], []
    for at in range(low - DIGIT, -1, -DIGIT):
        digit = best >> at & ((1 << DIGIT) - 1)
        if not digit:
            break
        audit.append(LETTERS[digit - 1])
    return best >> low, "".join(audit)


def replay(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each repaired turn: an audit and the roles alone say what every edit does."""
    state = START
    for letter in audit:
        role, text = (ROLES[state], "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "R":
            role = ROLES[state]
        state = OWN[role[:1]]
        yield letter, role, text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            yield from b.slice(lo, 1024).to_pylist()


def _report(costs: Costs):
    def conversation(rows: Iterator[dict]) -> tuple:
        turns, least, last = 0, None, None
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        illegal, seen, steps = 0, set(), []
        for r in rows:
            if r["gone"]:
                continue
            if r["turn"] is not None and r["turn"] != last:
                turns, last = turns + 1, r["turn"]
                least = last if least is None else least
            name = (r["role"], r["digest"])
            fault = "blank" if r["blank"] else "duplicate" if name in seen else "truncated" if r["truncated"] else None
            seen.add(name)
            if fault:
                counts[fault] += 1
            initial = r["role"][:1]
            if steps and steps[-1][0] + initial not in ("su", "ua", "au"):
                illegal += 1
            steps.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        gaps = 0 if least is None else min(last - least + 1 - turns, _LONG)
        return (gaps, *counts.values(), illegal, *cheapest(steps, costs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
            out.append((conv_id, *conversation(rows)))
            if len(out) >= 4096:
                yield _batch(out, REPORT)
                out = []
        if out:
            yield _batch(out, REPORT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _trimmed() -> Column:
    return F.rtrim("text", F.lit(BLANKS))


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    order = [F.asc_nulls_first(c) for c in ("conv_id", *keys, "turn", "role", "text")]
    return rows.repartition(F.col("conv_id")).sortWithinPartitions(*order)


def reports(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Faults and cheapest edits of each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``turns``: ``conv_id, turn, role, text`` without nulls in role and text; rows with a true ``gone`` only name their
    conversation. Rows count by turn (null first), those of one turn by role and text. A row's first fault counts: blank (white
    space only), duplicate (role and text seen earlier), truncated (doesn't end with a full stop, exclamation or
    question mark). ``gaps`` are turns missing between the first and the last; ``illegal`` counts neighbours whose roles
    don't follow each other. The edits give an optional system turn, then user and assistant in turn, or nothing at all:
    keep, delete (blank and duplicate rows must go), rerole, insert an empty turn; see ``cheapest``.

    A task reads one conversation's roles and hashes of its texts, never the texts together. A null id is a conversation too.
    """
    rows = _sorted(turns).select(
        "conv_id", "turn", "role", "gone", F.unhex(F.md5("text")).alias("digest"), (_trimmed() == "").alias("blank"),
        (~F.right(_trimmed(), F.lit(1)).isin(*ENDS)).alias("truncated"),
    )
    return rows.mapInArrow(_report(costs), REPORT_SQL)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conv_id, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
        audit = next(rows)["audit"]  # sorts before the turns
        for place, (letter, role, text) in enumerate(replay(audit, ((r["role"], r["text"]) for r in rows))):
            out.append((conv_id, place, letter, role, text))
            size += len(text)
            if size > 1 << 20 or len(out) >= 1 << 14:
                yield _batch(out, TURN)
                out, size = [], 0
    if out:
        yield _batch(out, TURN)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns after the edits that ``reports`` found, in order within partitions.

    A conversation's audit travels ahead of its turns, which pass one by one.
    """
    none = F.lit(None).cast("string")
    rows = turns.filter("NOT gone").select("conv_id", F.lit(1).alias("head"), "turn", "role", "text", none.alias("audit"))
    heads = found.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    dealt = _sorted(rows.unionByName(heads), "head")
    return dealt.select("conv_id", "role", "text", "audit").mapInArrow(_repair, TURN_SQL)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, schema = [], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    for conv_id, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
        digest = hashlib.sha256()
        for k, r in enumerate(rows):
            digest.update(f"{chr(10) if k else ''}{r['role']}:{r['text']}".encode())
        out.append((conv_id, digest.hexdigest()))
    if out:
        yield _batch(out, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``repaired``'s rows (``role:text``, newline-joined), which must come as it left them."""
    return turns.mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: faults put into rows by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays as a mark of its conversation), 1 empties the text, 2 removes its ends of sentences, 3
    repeats it, 4 makes it the user's. Null role, text, and ids within the hashed name, count as one space; ids stay null.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    damage = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), damage.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), copies)
    return rows.drop("col")


def repair_report(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``reports`` with ``repaired_sha256``, the digest of the repaired turns; that of nothing for a conversation without turns.

    Other columns of ``turns`` aren't read. Without turns there are no conversations.
    """
    found = materialise(reports(turns, costs), "reports")
    digest = digests(repaired(turns, found)).withColumnRenamed("conv_id", "own")
    joined = found.join(digest, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))

"""Conversation repair: the integer programme against trying every way, the query's edges against a plain version."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from barframe.llm import repair
from barframe.llm.repair import Costs, cheapest, replay

LEGAL = re.compile(r"(s?(ua)+)?")


def tried(rows, costs, at_most=3):
    """Least (cost, audit) over all edit sequences with few insertions, by growing ways from the cheapest."""
    heap = [(0, "", 0, "", 0)]
    best = None
    while heap:
        cost, audit, k, roles, more = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if k == len(rows) and LEGAL.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if more < at_most:
            for role in "ua":
                heapq.heappush(heap, (cost + costs.insert, audit + "I", k, roles + role, more + 1))
        if k < len(rows):
            initial, must_go, truncated = rows[k]
            heapq.heappush(heap, (cost + costs.delete, audit + "D", k + 1, roles, more))
            if not must_go:
                extra = costs.truncated if truncated else 0
                if initial in "sua" and initial:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, roles + initial, more))
                for role in "ua":
                    heapq.heappush(heap, (cost + costs.rerole + extra, audit + "R", k + 1, roles + role, more))
    return best


@pytest.mark.parametrize("costs", [Costs(), Costs(rerole=3, delete=4, insert=1, truncated=1), Costs(1, 1, 1, 1), Costs(2, 9, 2, 0)])
def test_cheapest_edits_equal_trying_all(costs):
    rng = random.Random(5)
    for n in (0, 1, 1, 2, 3, 4, 4):
        for _ in range(12):
            rows = [(rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]
            assert cheapest(rows, costs) == tried(rows, costs, at_most=n + 2 if costs.insert < 5 else 2), rows


def test_replayed_roles_are_legal():
    rng = random.Random(6)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
    for costs in (Costs(), Costs(3, 9, 1, 0)):
        for n in (1, 7, 60):
            rows = [(rng.choice("suax"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(n)]
            _, audit = cheapest(rows, costs)
            roles = [r for _, r, _ in replay(audit, ((names[i], "t") for i, _, _ in rows))]
            assert LEGAL.fullmatch("".join(r[0] for r in roles))
            assert audit.replace("I", "").__len__() == n


def plain(conversations):
    """The contract, conversation by conversation, over (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in conversations:
        rows = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if d == 4 else role
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows += [(turn is not None, turn or 0, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    result = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [t for known, t, _, _ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, seen, steps, illegal = [0, 0, 0], set(), [], 0
        for _, _, role, text in rows:
            found = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not found else 1 if (role, text) in seen else 2 if found[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            illegal += bool(steps) and steps[-1][0] + role[:1] not in ("su", "ua", "au")
            steps.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = tried(steps, Costs(), 1)
        kept = [f"{r}:{t}" for _, r, t in replay(audit, ((r, t) for _, _, r, t in rows))]
        result[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return result


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_equals_plain_version(spark):
    rng = random.Random(7)
    rows = []
    for conv in [*range(60), None]:
        for k in range(rng.randrange(1, 7)):
            turn = rng.choice([k, k, k, k + 3, None])
            role = rng.choice(["system" if k == 0 else "user", "user", "assistant", "assistant", None, "", "tool"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "Yes.", "No!", "why \n", "", None, "\x0b ", "é?", "“x”"])))
    rows += [(900, 2**62, "user", "w " * 200_000 + "."), (900, -(2**62), "assistant", "done.")]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, place int, audit string, gone boolean")
    found = repair.repair_report(repair.damaged(docs.repartition(3))).collect()
    assert {r.conv_id: tuple(r[c] for c in NAMES) for r in found} == plain(rows)
    assert len(found) == 62


def test_conversations_without_rows_left(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(repair.damaged(empty)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema)
    r = repair.repair_report(repair.damaged(docs)).first()
    assert tuple(r[c] for c in NAMES) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation(spark):
    rows = [(3, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(4000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = repair.repair_report(repair.damaged(docs)).first()
    assert len(r.audit) == 4000 - r.gaps + sum(zlib.crc32(f"3:{k}".encode()) % 20 == 3 for k in range(4000)) and r.cost > 0
    assert r.audit.count("I") == 0

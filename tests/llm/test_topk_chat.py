"""Top-k inner products against brute force; chat rendering as an exact round trip."""

import hashlib
import random

import numpy as np
import pytest

from barframe.llm import chat, topk


@pytest.mark.parametrize(("n", "dims", "high"), [(900, 16, 40), (700, 5, 2), (300, 3, 1 << 28), (3, 4, 9)])
def test_shard_search_is_exact(n, dims, high):
    rng = np.random.default_rng(n)
    values = rng.integers(-high, high + 1, (n, dims)) * (rng.random((n, dims)) < 0.6)
    ids = rng.permutation(n)
    kind = float if high < 1 << 20 else object
    shard = topk.Shard(ids, values.astype(kind))
    for q in range(0, n, max(1, n // 20)):
        scores = values.astype(object) @ values[q].astype(object)
        wanted = sorted(((-s, i) for s, i in zip(scores, ids) if i != ids[q]))[:5]
        found, top = shard.search(values[q].astype(kind), ids[q], 5)
        assert [(-int(s), i) for i, s in zip(found, top)] == wanted


@pytest.mark.parametrize("block", [1 << 13, 64])
def test_top_inner_products(spark, block):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 6)], "x") for k in range(400)]
    rows += [(k, rows[7][1], "copy") for k in range(400, 460)]
    rows += [(500, None, ""), (550, [0.1, None], ""), (600, [float("nan")] * 6, ""), (650, [float("inf")] * 6, ""), (700, [], ""), (None, [1.0], ""), (750, [0.5, -0.25], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    vectors = topk.integer_vectors(frame)
    found = {}
    for r in topk.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"), 5, block).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    kept = {k: np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, 6 - len(v))) for k, v, _ in rows[:460] + [rows[-3], rows[-1]]}
    assert set(found) == {k for k in kept if k % 50 == 0}
    for q, got in found.items():
        best = sorted((-int(v @ kept[q]), k) for k, v in kept.items() if k != q)[:5]
        assert sorted(got) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert topk.top_inner_products(vectors.limit(0), vectors.limit(0)).count() == 0


NASTY = ["", None, "plain", r"\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\\\<", "a\nb\r\n", "<#\\:>", "😀 é"]


def test_turns_round_trip():
    for role in NASTY:
        for text in NASTY:
            turn, start, end = chat.render_turn(role or "", text or "")
            assert chat.read_turns(turn + turn) == [(role or "", text or "")] * 2
            assert chat.unescape(turn[start:end]) == (text or "")
    with pytest.raises(ValueError):
        chat.read_turns("### user: x")


def test_fold_takes_edits_and_regenerations():
    def event(kind, payload=None, role=None):
        return {"kind": kind, "payload": payload, "role": role}

    assert chat.fold(iter([event("open", "a", "user"), event("delta", "b"), event("edit", "c"), event("delta", "d")])) == ("user", "cd")
    assert chat.fold(iter([event("open", None, "assistant"), event("delta", "x"), event("regenerate"), event("delta", "y")])) == ("assistant", "y")
    assert chat.fold(iter([event("delta", "x")])) == ("", "x")


@pytest.mark.parametrize("part_chars", [chat.PART, 50])
def test_digests_match_the_turns(spark, part_chars):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None, "a:b\n"]), rng.choice(NASTY), 1) for c in (1, 2, None, 9) for t in range(rng.randrange(1, 40))]
    rows += [(2, 3, "user", "twin", 1)] * 2 + [(3, None, "assistant", "no turn", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    parts = chat.render(chat.as_log(turns), part_chars=part_chars)
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode()))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})
    assert chat.digests(chat.render(chat.as_log(turns.limit(0)))).count() == 0


def test_unknown_events_change_nothing(spark):
    rows = [
        (1, 0, 0, "open", "user", "a"), (1, 0, 1, "typo", None, "x"), (1, 0, 2, None, None, "y"), (1, 0, 3, "delta", None, "b"),
        (1, 1, 0, "ping", "user", "lost"), (1, 2, 0, "open", "assistant", None), (1, 2, 1, "delta", None, "long " * 300_000),
    ]
    log = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, payload string")
    parts = chat.render(log).orderBy("part").collect()
    assert chat.read_turns("".join(r.text for r in parts)) == [("user", "ab"), ("", ""), ("assistant", "long " * 300_000)]
    assert chat.render(log.filter("kind IS NULL")).count() == 1

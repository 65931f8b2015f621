"""Repeated byte strings against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barframe.llm import repeats


def brute(rows, length, keep_first=False):
    places = {}
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for r, (_, b) in enumerate(data):
        for k in range(len(b) - length + 1):
            places.setdefault(b[k : k + length], []).append((r, k))
    covered = [np.zeros(len(b), dtype=bool) for _, b in data]
    for found in places.values():
        for r, k in found[1:] if keep_first else found * (len(found) > 1):
            covered[r][k : k + length] = True
    out = []
    for (doc, b), c in zip(data, covered):
        runs = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
        out.append((doc, len(b), int(c.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~c])))
    return out


def corpus(seed=1, n=160):
    rng = random.Random(seed)

    def noise(k):
        return "".join(rng.choice("abcdeé \n語") for _ in range(k))

    shared = [noise(k) for k in (90, 130, 210, 400, 900)]
    rows = []
    for k in range(n):
        parts = [noise(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, len(s))
            parts += [s[cut:] if rng.random() < 0.5 else s, noise(rng.randrange(0, 60))]
        rows.append((k, "".join(parts)))
    base = noise(700)
    for k in range(n, n + 30):
        at = rng.randrange(len(base))
        rows.append((k, base[:at] + "X" + base[at + 1 :]))
    extra = [None, "", "x" * 199, "x" * 200, "x" * 450, "ab" * 300, rows[3][1], rows[3][1], base, "y" * 201]
    return rows + [(1000 + k, t) for k, t in enumerate(extra)]


@pytest.mark.parametrize(("hot", "piece", "chunk"), [(50_000, 1 << 22, 1 << 21), (3, 1 << 10, 1 << 12)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, hot, piece, chunk):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus()

    def patched(make, **values):  # the tasks import the module anew
        def build(*args):
            inner = make(*args)

            def run(batches):
                import barframe.llm.repeats as module

                for name, value in values.items():
                    setattr(module, name, value)
                yield from inner(batches)

            return run

        return build

    for name in ("_count", "_contexts", "_search"):
        monkeypatch.setattr(repeats, name, patched(getattr(repeats, name), SLICE=piece, CHUNK=chunk))
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, start int, row int").repartition(5)
    found = repeats.without_repeats(docs, 200).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(brute(rows, 200))


def test_keep_first_leaves_one_copy(spark):
    rows = [r for r in corpus(2, 60) if r[1] is None or r[1][:1] not in "xay" or r[0] < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(docs, 200, keep_first=True).collect()}
    wanted = {r[0]: r[4] for r in brute(rows, 200, keep_first=True)}
    assert found == wanted


def test_repeated_rows_and_no_rows(spark):
    text = "".join(random.Random(0).choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(7, text), (7, text), (8, "z" + text[:150])], "doc_id long, text string")
    found = repeats.without_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in found) == [(7, 300, 1), (7, 300, 1), (8, 0, 0)]
    assert repeats.without_repeats(docs.filter(F.lit(False))).count() == 0


def test_suffix_ranks_follow_byte_order():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    for length in (1, 5, 8, 13, 40, 200):
        ranks = repeats.suffix_ranks(data, length)
        cut = [(bytes(data[k:]) + b"\0" * length)[:length] for k in range(400)]
        full = [k for k in range(400 - length)]
        for a in full[:60]:
            for b in full[-60:]:
                assert (ranks[a] < ranks[b]) == (cut[a] < cut[b]) and (ranks[a] == ranks[b]) == (cut[a] == cut[b])

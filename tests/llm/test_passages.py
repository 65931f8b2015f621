"""Repeated word windows against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barframe.llm import passages

SCHEMA = "doc_id long, text string, row int, lo int"


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, length):
    first = {}
    data = [(passages.LAST if doc is None else doc, split(text)) for doc, text in rows]
    for doc, words in data:
        for k in range(len(words) - length + 1):
            gram = tuple(words[k : k + length])
            first[gram] = min(first.get(gram, doc), doc)
    out = []
    for (doc, words), (name, _) in zip(data, rows):
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if first[tuple(words[k : k + length])] < doc:
                gone[k : k + length] = [True] * length
        out.append((name, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)

    def noise(k):
        return [rng.choice(["a", "b", "é", "A", "B c", "word"]) + str(rng.randrange(30)) for _ in range(k)]

    shared = [noise(k) for k in (5, 12, 13, 14, 40, 120)]
    rows = []
    for k in range(n):
        parts = noise(rng.randrange(0, 25))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, len(s))
            parts += (s[cut:] if rng.random() < 0.5 else s[: cut + 1]) + noise(rng.randrange(0, 4))
        rows.append((rng.randrange(0, 2 * n), rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    base = noise(300)
    for _ in range(25):
        at = rng.randrange(len(base))
        rows.append((rng.randrange(0, 2 * n), " ".join([*base[:at], "X", *base[at + 1 :]])))
    x = "x " * 40
    extra = [(500, None), (501, ""), (502, " \n "), (3, x), (502, x), (None, x), (None, " ".join(base)), (None, "z " * 20), (7, "y " * 30), (7, "y " * 30), (7, "q " * 30 + "y " * 14)]
    return rows + extra


def ours(found):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in found))


@pytest.mark.parametrize("length", [3, 13, 26])
def test_left_words_match_brute_force(spark, length):
    rows = corpus(length)
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], SCHEMA).repartition(4)
    found = passages.without_repeated_windows(docs, length).collect()
    assert ours(found) == sorted((a is None, a or 0, n, m, k) for a, n, m, k in brute(rows, length))


def test_no_rows_and_nothing_repeated(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(50))), 0, 0), (2, "a b", 0, 0)], SCHEMA)
    assert passages.without_repeated_windows(docs.filter(F.lit(False))).count() == 0
    assert ours(passages.without_repeated_windows(docs).collect()) == [(False, 1, 50, 0, " ".join(map(str, range(50)))), (False, 2, 2, 0, "a b")]


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [str(rng.randrange(10**6)) for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[390_000:]) + " " + "w" * 3_000_000 + " tail"), (3, "w" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed) for r in passages.without_repeated_windows(docs).collect()}
    assert found == {1: (400_000, 0), 2: (10_002, 10_000), 3: (1, 0)}


def test_doubling_ends_when_no_candidate_survives(spark):
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(130)]
    texts = {1: base, 2: ["p", *base[:60], "q"], 3: ["r", *base[100:]], 4: ["s"] * 12}
    rows = [(d, d, " ".join(w)) for d, w in texts.items()]
    found = passages.repeated_windows(spark.createDataFrame(rows, "row long, doc long, text string"), 13, longest=True).collect()
    wanted = set()
    for size in (13, 26, 52, 104):
        grams = {}
        for d, w in texts.items():
            for k in range(len(w) - size + 1):
                grams.setdefault(tuple(w[k : k + size]), set()).add((d, k))
        wanted |= {(d, k, size, min(places)[0]) for places in grams.values() if len({d for d, _ in places}) > 1 for d, k in places}
    assert {(r.row, r.start, r.size, r.lo) for r in found} == wanted
    assert max(r.size for r in found) == 52


def test_one_passage_in_most_documents(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), "id", F.lit(" " + passage), F.lit(" end"), "id").alias("text"))
    found = passages.without_repeated_windows(docs).groupBy("n_removed").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 1), (30, 2999)]


def test_lengths_and_hashes():
    assert passages.lengths(13) == [7, 13] and passages.lengths(5) == [5] and passages.lengths(50) == [7, 13, 25, 50]
    words = np.array([5, 6, 7, 5, 6, 7, 5, 6, 7], np.uint64)
    h = passages.window_hashes(words, 4)
    assert h[0] == h[3] and len(set(h.tolist())) == 3 and not len(passages.window_hashes(words, 10))


def test_a_task_counts_half_a_million_words_at_a_time():
    texts = [" ".join(f"w{k}x{i}" for i in range(300_000)) for k in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["doc", "text"])
    assert len(list(passages._seeds(7, 13)(iter([batch])))) == 2

"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from barframe.llm import near_dedup, shingles


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            inter = len(sets[x] & sets[y])
            if sets[x] and 100 * inter >= percent * (len(sets[x]) + len(sets[y]) - inter) and sets[y]:
                up[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for x, (doc, _) in enumerate(rows):
        least[find(x)] = min(doc, least.get(find(x), doc))
    return [(doc, len(sets[x]), least[find(x)], doc == least[find(x)]) for x, (doc, _) in enumerate(rows)]


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünder", "A\xa0B", "X"]
    rows, line = [], " ".join(rng.choices(vocabulary, k=30))
    for k in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows[-40:])[1] or "").split(" ")
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 20, 60, 90])))
            text = f"{line}\n{text}" if rng.random() < 0.5 else text
        rows.append((k * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE\n"), (5005, "one two"), (5006, "two one")]
    return rows


@pytest.mark.parametrize(("size", "percent", "leaf", "block"), [(3, 85, 256, 1024), (5, 80, 8, 16), (3, 85, 4, 8)])
def test_components_match_brute_force(spark, monkeypatch, size, percent, leaf, block):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, key string").repartition(6)
    found = near_dedup.near_duplicates(docs, size, percent).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute(rows, size, percent))


def test_one_of_each_keeps_rows_whole(spark):
    rows = corpus(120, 5)
    wanted = {doc for doc, _, _, kept in brute(rows, 5, 80) if kept}
    docs = spark.createDataFrame([(a, b, "k", 1) for a, b in [*rows, rows[0]]], "doc_id long, text string, key string, node int")
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_ids_and_clashing_names(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    one, two, three = (" ".join(rng.choices(words, k=80)) for _ in range(3))
    near = one.replace(one.split()[40], "changed", 1)
    rows = [(3, one), (None, one), (None, near), (None, two), (None, two), (None, two + " more"), (4, two + " x"), (None, three), (None, three), (None, None), (None, ""), (9, None), (9, three + " a b c d")]
    extra = "_kept int, _place int, n int, id string, anon int, h int, key int, component int, name int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "i", 5, 6, 7, 8, 9) for r in rows], f"doc_id long, text string, {extra}")
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    found = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    wanted = sorted((str(a), str(b)) for a, b in [(3, one), (4, two + " x"), (None, None), (None, ""), (9, None), (9, three + " a b c d")])
    assert found == wanted and {r.n for r in kept.collect()} == {3}
    flags = near_dedup.near_duplicates(docs).collect()
    assert len(flags) == len(rows) and {r.component_id for r in flags if r.n_shingles and r.doc_id is None} == {3, 4, 9}
    only = near_dedup.one_of_each(spark.createDataFrame([(None, two, "a"), (None, two + " x", "b"), (None, two, "c")], "doc_id long, text string, lang string"))
    assert only.count() == 1


def test_hashed_words_cut_long_texts_at_white_space(monkeypatch):
    texts = ["", None, "a b  c", "Long " * 50 + "x" * 120 + " end", " lead", "b\x1cc d", "é É"]
    whole = [h.tolist() for _, h in shingles.hashed_words(pa.array(texts))]
    monkeypatch.setattr(shingles, "SLICE", 16)
    assert [h.tolist() for _, h in shingles.hashed_words(pa.array(texts))] == whole
    assert [len(h) for h in whole] == [len((t or "").encode().split()) for t in texts]
    sliced = pa.array(["pad pad", *texts]).slice(1)
    assert [h.tolist() for _, h in shingles.hashed_words(sliced)] == whole
    distinct = {w for t in texts for w in (t or "").encode().lower().split()}
    assert len({h for hs in whole for h in hs}) == len(distinct)


def test_overlaps_are_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 80, 200, 250)]
    found = near_dedup.overlaps(sets, sets[1:], columns=32)
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]

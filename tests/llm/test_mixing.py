"""Mix targets and Pareto draws against plain Python."""

import random
from collections import defaultdict

import pytest

from barframe.llm import mixing


def expected_targets(sizes, weights, share, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        source = rng.choice(["hot"] * 10 + ["a", "b", "é", "Z", None])
        text = rng.choice([None, "", " \t\n", " ".join(["w"] * rng.randrange(1, 60)), "x\x0by\xa0z  v"])
        rows.append((k, text, source, "c", 5))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies int")


def test_targets_and_sizes(docs):
    rows = mixing.mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    sources = {r.doc_id: r.source for r in docs.collect()}
    assert len(rows) == len(texts)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").encode().split())
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        sizes[sources[r.doc_id]] += r["size"]
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    wanted = expected_targets(sizes, (5, 2, 1), 1.5)
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s])
        assert abs(taken[s] - target[s]) <= 30  # half of the largest document
    assert {r.source_size for r in rows} == set(sizes.values())


def test_reruns_agree_and_seeds_differ(docs):
    def drawn(seed, n):
        return sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(n), seed=seed, share=0.7).collect())

    assert drawn(1, 3) == drawn(1, 7) != drawn(2, 3)


def test_inclusion_grows_with_the_measure(spark):
    docs = spark.createDataFrame([(k, "w " * (1 if k % 2 else 255), "s") for k in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, share=0.5).collect()
    share = [sum(r.copies for r in rows if r["size"] == n) / 2000 for n in (1, 255)]
    assert share[1] / share[0] == pytest.approx(12 / 5, rel=0.1)


def test_mixed_documents_are_the_rows_themselves(docs):
    wanted = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id] += 1
        assert (r["size"], r["copies"]) == ("c", 5)
    assert all(found.get(k, 0) == n for k, n in wanted.items())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "x", "a")], [(None, "x y", "b"), (None, "x y", "b"), (3, "z", "b")]])
def test_edge_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)

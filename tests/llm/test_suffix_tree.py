"""Suffix tree scores against a plain Python model of n-gram counters."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from barframe.llm import suffix_tree as st

END = object()


def tokens_of(text):
    return [*(text or "").encode().lower().split(), END]


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


class Plain:
    """The same model from its definition: tuples as contexts, counters as tables."""

    def __init__(self, texts):
        self.texts = [tokens_of(t) for t in texts]
        self.c = Counter(t for text in self.texts for t in text)
        self.n, self.v = sum(self.c.values()), len(self.c)
        ones, twos = (sum(x == k for x in self.c.values()) for k in (1, 2))
        self.d = min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else st.DISCOUNT
        common = {w for w, k in self.c.items() if k >= max(2.0, st.COMMON * self.n)}
        floor = max(st.CONTEXT * self.n, 2.0)
        self.states = {}
        allowed = {(w,) for w in common if self.c[w] >= floor and w is not END}
        if len(self.texts) >= floor:
            allowed.add(("^",))
        for depth in range(1, st.DEPTH + 1):
            follow = defaultdict(Counter)
            for text in self.texts:
                line = ["^", *text]
                for k in range(depth, len(line)):
                    context = tuple(line[k - depth : k])
                    if context in allowed and line[k] in common:
                        follow[context][line[k]] += 1
            added, longer = {}, set()
            for context in allowed:
                total = len(self.texts) if context == ("^",) else self.c[context[0]] if depth == 1 else self.total[context]
                tested = {}
                for w, k in follow[context].items():
                    p = (k - st.DISCOUNT) / total
                    if k >= max(st.SYMBOL * total, 2) and abs(math.log10(p / self.p(context[1:], w))) >= math.log10(st.RATIO):
                        tested[w] = (k, p)
                mine, theirs = sum(p for _, p in tested.values()), sum(self.p(context[1:], w) for w in tested)
                back = max(1 - mine, 1e-12) / max(1 - theirs, 1e-12)
                gain = sum(k * math.log(p / self.p(context[1:], w)) for w, (k, p) in tested.items())
                gain += (total - sum(k for k, _ in tested.values())) * math.log(back)
                if gain >= st.EVIDENCE * math.log(max(self.n, 2)):
                    added[context] = ({w: p for w, (_, p) in tested.items()}, back)
            self.states |= added
            self.total = {}
            for context in allowed:
                for w, k in follow[context].items():
                    if k >= floor and w is not END and (*context[1:], w) in self.states:
                        self.total[(*context, w)] = k
            allowed = set(self.total)

    def p(self, context, w):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.c[w] - self.d) / self.n if self.c[w] else self.d * self.v / self.n
        own, back = self.states[context]
        return own[w] if w in own else back * self.p(context[1:], w)

    def score(self, text):
        line = ["^", *tokens_of(text)]
        return sum(math.log10(self.p(tuple(line[max(0, k - st.DEPTH) : k]), line[k])) for k in range(1, len(line)))


def corpus(n=700):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    texts = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(["Once upon a time there", "r car q1", "r car q2", "m p car z1", "n p car z2"]).split()
        if rng.random() < 0.3:
            words.append(f"odd{rng.randrange(5000)}")
        texts.append(" ".join(words))
    return [*texts, None, "", "É\xa0x  y\x0bz", "ONCE UPON a"]


@pytest.fixture
def shares(monkeypatch):
    """Larger shares, so that a small corpus has rare words and contexts of every length."""
    monkeypatch.setattr(st, "COMMON", 2e-4)
    monkeypatch.setattr(st, "CONTEXT", 3e-3)


def test_scores_match_the_plain_model(spark, shares):
    rows = [*enumerate(corpus()), (None, "once upon a time"), (7, "w1 w2 odd")]
    docs = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "doc_id long, text string, score double").repartition(6)
    plain = Plain([t for d, t in rows if not is_held(d)])
    assert {len(c) for c in plain.states} == {1, 2, 3}
    found = st.score(docs).collect()
    assert len(found) == len(rows)
    wanted = []
    for d, t in rows:
        tokens = tokens_of(t)
        base = sum(math.log10((plain.c[w] + 1) / (plain.n + plain.v + 1)) for w in tokens)
        wanted.append((d is not None, d or 0, is_held(d), len(tokens), sum(plain.c[w] > 0 for w in tokens), plain.n, base, plain.score(t)))
    key = lambda r: (r[0], r[1], r[3])
    got = [(r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key)):
        assert a[:6] == b[:6]
        assert a[6:] == pytest.approx(b[6:], rel=1e-9)


def test_states_are_distributions(spark, shares):
    texts = corpus()
    tree, counts = st.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    rare = np.array([r.n for r in counts.collect() if r.word not in set(tree.words.tolist())])
    ids = np.arange(len(tree.words))
    for state in range(len(tree.parent)):
        states = np.full(len(ids), state)
        weight = st.move_logs(tree, np.array([state]), np.array([-1]))
        rest = 10 ** (weight + tree.root_log(rare)).astype(float)
        unknown = 10 ** (weight + tree.root_log(np.array([0])))
        assert (10 ** st.move_logs(tree, states, ids)).sum() + rest.sum() + unknown.sum() == pytest.approx(1, abs=1e-6)


def test_held_out_texts_gain_over_the_base(spark, shares):
    docs = spark.createDataFrame(list(enumerate(corpus(1500))), "doc_id long, text string")
    rows = st.score(docs).filter("held_out").toPandas()
    assert rows.score.sum() > 0.85 * rows.base_score.sum()


@pytest.mark.parametrize("rows", [[], [(0, None)], [(1, "only text")], [(k, "same same") for k in range(40)]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = st.score(docs).collect()
    assert len(found) == len(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = st.Lookup(keys)
    asked = np.concatenate([keys[::3], rng.integers(0, 1 << 63, 999).astype(np.uint64)])
    place = {int(k): i for i, k in enumerate(keys)}
    assert table.find(asked).tolist() == [place.get(int(k), -1) for k in asked]
    assert st.Lookup(keys[:0]).find(asked[:3]).tolist() == [-1] * 3


def word_key(word):
    return int(next(st._tokens(pa.array([word])))[0][0])


def test_contexts_of_a_small_share_are_states(spark):
    """40 occurrences in some million tokens: under any share, but far beyond the evidence asked for."""
    rng = np.random.default_rng(3)
    filler = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 1000)) for _ in range(1000)]
    docs = [*filler, *["alpha beta gamma"] * 40]
    tree, _ = st.fit(spark.createDataFrame([(t,) for t in docs], "text string"))
    assert 40 < 5e-5 * tree.n
    alpha, beta = (word_key(w) for w in ("alpha", "beta"))
    assert {alpha, beta} <= set(tree.keys.tolist())


def test_a_context_needs_no_retained_suffix(spark):
    """After "b" every word is as frequent as anywhere; with the word before "b", half of them never come."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(200):
        numbers = rng.integers(0, 21, 1000)
        for k in range(2, 1000):
            if numbers[k - 1] == 20:
                numbers[k] = 20 if rng.random() < 1 / 21 else rng.integers(0, 10) + 10 * (numbers[k - 2] >= 10)
        texts.append(" ".join("b" if k == 20 else f"w{k}" for k in numbers))
    tree, _ = st.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    x, b = word_key("w3"), word_key("b")
    keys = tree.keys.tolist()
    longer = int(st._next(np.array([x]), np.array([b]))[0])
    assert b not in keys and longer in keys and tree.parent[keys.index(longer)] == 0


@pytest.mark.parametrize("cache", [0, 60])
def test_joined_tables_score_as_broadcast_ones(spark, monkeypatch, cache):
    """At the shipped setting: all terms by the join, or the most frequent ones in the tasks."""
    docs = spark.createDataFrame([*enumerate(corpus(1500)), (None, "once upon a time"), (7, None)], "doc_id long, text string").repartition(5)

    def scores():
        return sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in st.score(docs).collect())

    held = scores()
    monkeypatch.setattr(st, "CACHE", cache)
    joined = scores()
    assert len(held) == len(joined)
    for a, b in zip(held, joined):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


class Held:
    """Stands for a broadcast, and for a task's context."""

    def __init__(self, value):
        self.value = value

    def get(self):
        return self

    def partitionId(self):
        return 3


def test_a_task_hands_its_texts_over_by_pieces(monkeypatch):
    """A batch of 5,000 long texts whose every word and context is asked of the tables leaves the task in small pieces."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1 << 40, 300)) for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([False] * 5000), pa.array(texts)], ["doc_id", "held_out", "text"])
    monkeypatch.setattr(st, "TaskContext", Held(None))
    everything = st.Sieve(np.full(1 << 15, 255, np.uint8))
    run = st._score(Held(st.Tree(n=1 << 22, v=10, whole=False)), Held((everything, everything)), 4)
    found = list(run(iter([batch])))
    assert max(b.nbytes for b in found) < 40e6
    counts = [len(x[0]) // 8 for kind, _, x in st._unpacked(found) if kind == st.TEXTS]
    assert sum(counts) == 5000

"""Language-model scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.shingles import U, hashed_words, mix
from barframe.session import materialise, recorded_scratch, remove, settings

COMMON = 5e-7  # share of all tokens from which a word's count is broadcast (at most 2 million words); others are joined
CONTEXT = 0.0  # least share of all tokens of a context, besides LEAST; 0 leaves the choice to the divergence test
SYMBOL = 0.0  # least share of a context's followers of a tested one, besides a count of 2
LEAST = 10  # occurrences of a context: with fewer, hardly any divergence reaches EVIDENCE * log N
DEPTH = 3
RATIO = 1.5  # least ratio to the parent's probability, either way, of a follower with a probability of its own
EVIDENCE = 10.0  # times log N: least log-likelihood gain of a context over its parent
DISCOUNT = 0.5
CACHE = 250_000  # rows of states and moves, the most frequent ones, that tasks hold; the others are joined, with the same result
END = np.int64(-0x61C8864680B583EB)  # stands for the end among the hashes of words
BEGIN = np.int64(0x3C79AC492BA7B653)  # precedes each text
_STEP = U(0x9E3779B97F4A7C15)
SIEVE = 28  # bits of a filter at most: a power of two
BLOCK = 18  # bits of a filter that are put together at a time: a power of two
PART = 1 << 20  # tokens whose contexts and followers meet in one task; the terms of four times as many
BATCH = "8m"  # of texts, or of packed rows, that a task is handed at a time
HASHED = "64m"  # largest part of a join's smaller side that a task holds as a hash table
PACKED_SQL = "part int, kind int, base long, " + ", ".join(f"{c} binary" for c in "abcde")  # arrays travel as bytes
PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), *((c, pa.binary()) for c in "abcde")])
FOLLOWERS, CONTEXTS, STATES, MOVES, WORDS, TERMS_ASKED, WORDS_ASKED, TEXTS = range(8)  # kinds of packed rows
SUMS_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SUMS = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
    ("score", pa.float64()),
])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (part, kind, base, arrays...) with the arrays' bytes."""
    heads = [pa.array(list(x), f.type) for x, f in zip(zip(*(r[:3] for r in rows)), PACKED)] if rows else [pa.array([], f.type) for f in PACKED][:3]
    columns = [pa.array([r[k].tobytes() if len(r) > k else None for r in rows], pa.binary()) for k in range(3, 8)]
    return pa.RecordBatch.from_arrays([*heads, *columns], schema=PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list]]:
    """(kind, base, bytes of the arrays) of packed rows."""
    for b in batches:
        for kind, base, *columns in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), *b.columns[3:]):
            yield kind, base, [x.as_buffer() for x in columns]


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of the numbers by their rank, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.copy()


def _joined(planes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    """Mostly ascending keys as differences."""
    return _planes(np.diff(keys.view(U), prepend=U(0)))


def _keys(steps) -> np.ndarray:
    return np.cumsum(_joined(steps, U), dtype=U)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _parts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of sorted keys dealt over ``parts`` tasks by their leading bits."""
    part = (keys >> U(32)) * U(parts) >> U(32)
    cuts = _starts(part)
    return zip(part[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)])


class Lookup:
    """Positions of 64-bit keys in a sorted table, by their leading bits and a few comparisons."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(U)
        self.bits = max(1, min(21, int(len(keys)).bit_length() + 2))
        self.flip = U(0)
        spread = self._spread(self.keys)
        self.order = np.argsort(spread, kind="stable")
        self.spread = spread[self.order]
        heads = np.arange((1 << self.bits) + 1, dtype=float)
        self.first = np.searchsorted(self.spread >> U(64 - self.bits), heads.astype(U)).astype(np.int64)
        self.deepest = int(np.diff(self.first).max()) if len(keys) else 0

    @staticmethod
    def _spread(x: np.ndarray) -> np.ndarray:
        x = x * U(0x9E3779B97F4A7C15)
        return x ^ (x >> U(29))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the table, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        spread = self._spread(keys.astype(U))
        head = (spread >> U(64 - self.bits)).astype(np.int64)
        at, stop = self.first[head], self.first[head + 1]
        todo = np.flatnonzero(at < stop)
        for step in range(self.deepest):
            if not len(todo):
                break
            place = at[todo] + step
            hit = self.spread[place] == spread[todo]
            out[todo[hit]] = self.order[place[hit]]
            todo = todo[~hit]
            todo = todo[at[todo] + step + 1 < stop[todo]]
        return out


def _tokens(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of words and ends, text number of each) for some texts at a time."""
    held, numbers, total = [], [], 0
    for number, words in hashed_words(texts):
        held += [words.view(np.int64), np.array([END])]
        numbers.append((number, len(words) + 1))
        total += len(words) + 1
        if total > most:
            yield np.concatenate(held), np.repeat(*map(np.array, zip(*numbers)))
            held, numbers, total = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(*map(np.array, zip(*numbers)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.unique(tokens, return_counts=True) for tokens, _ in _tokens(b.column(0))]
        if parts:
            words, counts = (np.concatenate(x) for x in zip(*parts))
            word, place = np.unique(words, return_inverse=True)
            total = np.bincount(place, counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(total)], ["word", "n"])


def _next(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a context followed by a word; a context of one word has the word's hash as its key."""
    return mix(context.astype(np.int64).view(U) * _STEP + word.astype(np.int64).view(U)).view(np.int64)


def _chains(tokens: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of contexts: (key of each token's context, key of context and token, the same for the context's longest
    suffix, whether the text reaches back so far). A text is preceded by one begin."""
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    starts = np.flatnonzero(first)
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    shorter = tokens
    for depth in range(1, DEPTH + 1):
        context = np.roll(shorter, 1)
        if depth == 1:
            context[first] = BEGIN
        longer = _next(context, tokens)
        yield context, longer, shorter, place >= depth - 1
        shorter = longer


@dataclass
class Tree:
    """What every scoring task holds: counts of the common words and, where they are at most CACHE, states and moves.

    State 0 is the root; a state's parent is its longest suffix that is one.
    """

    n: int = 0  # training tokens
    v: int = 0  # distinct ones
    discount: float = DISCOUNT
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes of the common ones
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    word_back: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 back-off weight of the common words as contexts
    top_states: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the most frequent ones' terms, see ``score``
    top_back: np.ndarray = field(default_factory=lambda: np.zeros(0))
    top_moves: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    top_extra: np.ndarray = field(default_factory=lambda: np.zeros(0))
    whole: bool = True  # whether states and moves are held
    keys: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of the states' contexts
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    back: np.ndarray = field(default_factory=lambda: np.zeros(1))  # log10 of the back-off weight
    moves: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # keys of contexts with a follower
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 probability of each move

    def root_log(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability without context: absolute discounting, the discounts being the unknown word's."""
        if not self.n:
            return np.zeros(len(counts))
        p = np.where(counts > 0, (counts - self.discount) / self.n, self.discount * self.v / self.n)
        return np.log10(p)

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.n + self.v + 1.0))


def move_logs(tree: Tree, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log10 probability of common words after states: the state's own, or backed off to its parents, down to the root.
    Ids of -1 get the back-off weights alone."""
    moves, states = Lookup(tree.moves.view(U)), states.copy()
    out, open_ = np.zeros(len(states)), np.ones(len(states), dtype=bool)
    todo = np.flatnonzero(states > 0)
    while len(todo):
        found = moves.find(_next(tree.keys[states[todo]], tree.words[ids[todo]] if len(tree.words) else ids[todo]).view(U))
        hit = (found >= 0) & (ids[todo] >= 0)
        out[todo[hit]] += tree.logs[found[hit]]
        open_[todo[hit]] = False
        todo = todo[~hit]
        out[todo] += tree.back[states[todo]]
        states[todo] = tree.parent[states[todo]]
        todo = todo[states[todo] > 0]
    common = open_ & (ids >= 0)
    out[common] += tree.root_log(tree.counts[ids[common]])
    return out


class Sieve:
    """A Bloom filter of 64-bit keys: ``bits`` as bytes, a power of two of them up to 2^SIEVE bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = U(64 - (len(bits) * 8).bit_length() + 1)

    @staticmethod
    def places(keys: np.ndarray, shift: U) -> Iterator[np.ndarray]:
        first = mix(keys.astype(np.int64).view(U))
        yield first >> shift
        yield (first * _STEP) >> shift

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the filter's; true for all of these."""
        first = mix(keys.astype(np.int64).view(U))
        out = self._set(first >> self.shift)
        some = np.flatnonzero(out)
        out[some] = self._set((first[some] * _STEP) >> self.shift)
        return out

    def _set(self, place: np.ndarray) -> np.ndarray:
        return self.bits[(place >> U(3)).view(np.int64)] >> (place & U(7)).astype(np.uint8) & 1 == 1


def _places(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, in _gathered(batches, 1 << 20):
            place = np.unique(np.concatenate(list(Sieve.places(keys, U(shift)))))
            block = (place >> U(BLOCK)).astype(np.int64)
            cuts = _starts(block)
            bits = [x.astype(np.uint32).tobytes() for x in np.split(place & U((1 << BLOCK) - 1), cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(bits, pa.binary())], ["block", "bits"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of some batches at a time."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _bits(key: tuple, group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << BLOCK, dtype=np.uint8)
    for x in group.column("bits"):
        bits[np.frombuffer(x.as_buffer(), np.uint32)] = 1
    return pa.table({"block": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def sieve(keys: DataFrame, n: int) -> Sieve:
    """A filter of the ``n`` keys in the one column of ``keys``: 10 bits each and at most 2^SIEVE in all, whatever their number."""
    power = min(SIEVE, max(BLOCK, (10 * n).bit_length()))
    held = np.zeros((1 << power - BLOCK, (1 << BLOCK) // 8), np.uint8)
    places = keys.mapInArrow(_places(64 - power), "block long, bits binary")
    for r in places.groupBy("block").applyInArrow(_bits, "block long, bits binary").collect():  # at most 2^SIEVE bits
        held[r.block] = np.frombuffer(r.bits, np.uint8)
    return Sieve(held.ravel())


def _followers(depth: int, shared):
    """Counts of contexts of one length with what follows, packed by part, where contexts, and followers after the context
    without its oldest word, pass the filters of those that occur often enough.

    A part holds all that follows a context. A context with more than a part can take is dealt over several by its
    followers, so that equal ones still meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, repeated, large, spread, parts = shared.value
        large = Lookup(large[0].view(U))
        for b in batches:
            for tokens, owner in _tokens(b.column(0)):
                context, gram, shorter, valid = next(islice(_chains(tokens, owner), depth - 1, None))
                at = np.flatnonzero(valid)
                at = at[known.holds(context[at])]
                at = at[repeated.holds(shorter[at])]
                at = at[np.argsort(gram[at])]
                first = _starts(gram[at])
                n = np.diff(np.append(first, len(at))).astype(np.uint32)
                at = at[first]
                key = context[at].view(U)
                found = large.find(key)
                some = np.flatnonzero(found >= 0)
                key[some] = mix(key[some] + (gram[at[some]].view(U) % spread[found[some]] + U(1)) * _STEP)
                order = np.argsort(key)
                key, at, n = key[order], at[order], n[order]
                runs = _starts(key)
                ends = np.append(runs, len(at))
                rows = []
                for part, lo, hi in _parts(key[runs], parts):
                    inside, lengths = slice(ends[lo], ends[hi]), np.diff(ends[lo : hi + 1]).astype(np.uint32)
                    rows.append((part, FOLLOWERS, 0, _steps(context[at[runs[lo:hi]]]), _planes(lengths), tokens[at[inside]], _planes(n[inside])))
                yield _packed(rows)

    return run


def _contexts(parts: int):
    """Packed contexts: key, count, keys of the suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _gathered(batches, PART):
            order = np.argsort(columns[0].view(U))
            keys, *others = (c[order] for c in columns)
            yield _packed([(part, CONTEXTS, 0, _steps(keys[lo:hi]), *(_planes(x[lo:hi]) for x in others)) for part, lo, hi in _parts(keys.view(U), parts)])

    return run


def _counted(depth: int, least: float, shared):
    """Followers that occur twice: keys of context and follower (``g``), of the same without the oldest word (``sg``), of the
    context and its suffixes, of the suffix of ``sg`` where it can be a context's, and how often both occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = [shared.value[2]], []
        for kind, _, row in _unpacked(batches):
            if kind == CONTEXTS:
                tables.append((_keys(row[0]).view(np.int64), *(_joined(x, np.int64) for x in row[1:4])))
            else:
                held.append((_keys(row[0]), _joined(row[1], np.uint32), np.frombuffer(row[2], np.int64), _joined(row[3], np.uint32)))
        if not held:
            return
        known, total, s1, s2 = (np.concatenate(x) for x in zip(*tables))
        context, lengths, word, n = (np.concatenate(x) for x in zip(*held))
        del held, tables
        place = Lookup(known.view(U)).find(context)
        run_of = np.repeat(np.arange(len(context)), lengths)
        keep = place[run_of] >= 0
        run_of, word, n = run_of[keep], word[keep], n[keep].astype(np.int64)
        if not len(n):
            return
        gram = _next(context.view(np.int64)[run_of], word)
        order = np.argsort(gram)
        first = _starts(gram[order])
        n = np.add.reduceat(n[order], first)
        at = order[first[n >= 2]]
        n = n[n >= 2]
        none = np.zeros(1 << 17, np.int64)
        for lo in range(0, len(at), 1 << 17):
            which, times = at[lo : lo + (1 << 17)], n[lo : lo + (1 << 17)]
            where = place[run_of[which]]
            suffix = word[which] if depth == 1 else _next(s1[where], word[which])
            columns = [gram[which], suffix, known[where], times, total[where], s1[where], s2[where], np.where(times >= least, word[which], 0) if depth == 2 else none[: len(which)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "sg", "ctx", "n", "total", "s1", "s2", "t2"])

    return run


def _level(train: DataFrame, depth: int, above: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, moves, grams) of one length of contexts.

    ``above`` holds the grams one shorter: key ``g``, count ``n``, log10 probability ``lp`` and the keys ``t1, t2`` of
    their suffixes as contexts (0: none). For every follower the probability is compared with the one without the oldest word; a
    context is retained if the followers whose probability departs by RATIO gain enough log likelihood together. Those get
    (count - DISCOUNT) / total; the rest of the mass goes to all others in proportion to the shorter context, so every
    state's distribution sums to 1. A context needs no retained suffix.
    """
    spark = train.sparkSession
    least = max(CONTEXT * n, float(LEAST))
    allowed = above.filter(F.col("n") >= least)
    parts = 1 + n // PART
    allowed = allowed.select("g", "n", "t1", "t2")
    large = allowed.filter(F.col("n") >= n / (2 * parts)).toPandas()  # at most 2 * parts rows
    large = tuple(large[c].to_numpy(np.int64) for c in ("g", "n", "t1", "t2"))
    spread = (2 * parts * large[1] // max(n, 1) + 1).astype(U)
    again = above.filter(F.col("n") >= 2).select("g")
    filters = [sieve(x, x.count()) for x in (allowed.select("g"), again)]
    contexts = spark.sparkContext.broadcast((*filters, large, spread, parts))  # of bounded size
    packed = train.select("text").mapInArrow(_followers(depth, contexts), PACKED_SQL).unionByName(
        allowed.filter(F.col("n") < n / (2 * parts)).mapInArrow(_contexts(parts), PACKED_SQL)
    )
    names = ("g", "sg", "ctx", "n", "total", "s1", "s2", "t2")
    counted = packed.repartitionById(parts, F.col("part")).mapInArrow(_counted(depth, least, contexts), ", ".join(f"{c} long" for c in names))
    parents = above.select(F.col("g").alias("sg"), F.col("lp").alias("up"))
    p = (F.col("n") - F.lit(DISCOUNT)) / F.col("total")
    tested = (F.col("n") >= F.lit(SYMBOL) * F.col("total")) & (F.abs(F.log10(p) - F.col("up")) >= math.log10(RATIO))
    rows = counted.join(parents, "sg").withColumn("tested", tested)
    with settings(spark, adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED, execution__arrow__maxBytesPerBatch=BATCH), recorded_scratch([]) as held:
        rows = materialise(rows, "followers")
    contexts.unpersist()
    theirs = F.pow(F.lit(10.0), F.col("up"))
    states = rows.filter("tested").withColumn("p", p).groupBy("ctx").agg(
        *[F.min(c).alias(c) for c in ("total", "s1", "s2")], F.sum("p").alias("own"), F.sum(theirs).alias("theirs"), F.sum("n").alias("of"),
        F.sum(F.col("n") * (F.log("p") - F.col("up") * math.log(10))).alias("gain"),
    )
    weight = F.greatest(1 - F.col("own"), F.lit(1e-12)) / F.greatest(1 - F.col("theirs"), F.lit(1e-12))
    # The gain of the departures alone, less what the changed rest of the mass loses.
    gain = F.col("gain") + (F.col("total") - F.col("of")) * F.log(weight)
    states = states.filter(gain >= EVIDENCE * math.log(max(n, 2))).select("ctx", F.log10(weight).alias("back"), "s1", "s2", F.col("total").alias("n"))
    states = materialise(states, "states")
    t1 = F.when(F.col("n") >= least, F.col("sg")).otherwise(0)  # of those that can be contexts
    out = rows.select("ctx", "g", "n", "up", "tested", t1.alias("t1"), "t2")
    out = out.join(states.select("ctx", "back", F.col("n").alias("total")), "ctx", "left").withColumn("p", p)
    move = F.col("back").isNotNull() & F.col("tested")
    lp = F.when(move, F.log10("p")).otherwise(F.col("up") + F.coalesce("back", F.lit(0.0)))
    extra = F.when(move, F.log10("p") - F.col("up") - F.col("back"))  # what a move adds to the longer context's back-off
    grams = materialise(out.select("g", "n", lp.alias("lp"), "t1", "t2", move.alias("move"), extra.alias("extra")), "grams")
    moves = materialise(grams.filter("move").select(F.col("g").alias("key"), F.col("lp").alias("log"), "extra", "n"), "moves")
    remove(spark, held[0])
    return states, moves, grams


def _empty(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], columns)


def model(train: DataFrame) -> tuple[Tree, DataFrame, DataFrame, DataFrame]:
    """(tree, counts of all words, states ``key, back, n``, moves ``key, log, extra, n``) from the texts in ``train.text``.

    One pass counts words; each length of contexts takes another. Every context that occurs LEAST times is tested, so
    states and moves grow with the texts. They are tables by key; the tree holds them if they are few.
    """
    counts = materialise(train.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, v, ones, twos, texts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)),
        F.coalesce(F.sum(F.when(F.col("word") == int(END), F.col("n"))), F.lit(0)),
    ).first()
    tree = Tree(n=int(n), v=int(v))
    if ones + twos:
        tree.discount = min(max(ones / (ones + 2 * twos), 0.05), 0.95)
    floor = max(2.0, COMMON * n)
    common = counts.filter(F.col("n") >= floor).toPandas().sort_values("word")  # at most 1 / COMMON rows
    tree.words, tree.counts = common["word"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    states, moves = _empty(train, "key long, back double, s1 long, s2 long, n long"), _empty(train, "key long, log double, extra double, n long")
    if n:
        none = F.lit(0).cast("long")
        begin = train.sparkSession.range(1).select(F.lit(int(BEGIN)).alias("word"), F.lit(int(texts)).alias("n"))
        root = F.log10((F.col("n") - F.lit(tree.discount)) / float(n))
        above = counts.unionByName(begin).select(F.col("word").alias("g"), "n", root.alias("lp"), none.alias("t1"), none.alias("t2"))
        old = None
        for depth in range(1, DEPTH + 1):
            with recorded_scratch([]) as held:
                more, moved, above = _level(train, depth, above, n)
            states = states.unionByName(more.withColumnRenamed("ctx", "key"))
            moves = moves.unionByName(moved)
            if old:  # the grams one shorter were only needed here
                remove(train.sparkSession, old)
            old = next(path for path in held if "/grams-" in path)
        remove(train.sparkSession, old)
    tree.word_back = np.zeros(len(common))
    own = states.join(counts.filter(F.col("n") >= floor).select(F.col("word").alias("key")), "key").select("key", "back").toPandas()  # of the common words
    tree.word_back[np.searchsorted(tree.words, own["key"].to_numpy(np.int64))] = own["back"].to_numpy(float)
    tree.whole = states.count() + moves.count() <= CACHE
    if tree.whole:
        held, more = states.toPandas(), moves.toPandas()
        keys = held["key"].to_numpy(np.int64)
        tree.keys, tree.back = np.append(np.int64(0), keys), np.append(0.0, held["back"].to_numpy(float))
        known, parent = Lookup(keys.view(U)), np.zeros(len(keys), np.int64)
        for name in ("s2", "s1"):  # the longer suffix last; none is 0
            found = known.find(held[name].to_numpy(np.int64).view(U))
            parent = np.where(found >= 0, found + 1, parent)
        tree.parent = np.append(np.int64(0), parent)
        tree.moves, tree.logs = more["key"].to_numpy(np.int64), more["log"].to_numpy(float)
    return tree, counts, states, moves


def fit(train: DataFrame) -> tuple[Tree, DataFrame]:
    """(tree, counts of all words): see ``model``."""
    return model(train)[:2]


def _asked(parts: int, kind: int, base: int, keys: np.ndarray, refs: np.ndarray) -> list[tuple]:
    """Packed rows that ask for the terms of ``keys`` on behalf of texts, each key once with its texts and what they ask."""
    order = np.argsort(keys.view(U))
    keys, refs = keys[order].view(U), refs[order].astype(np.uint32)
    runs = _starts(keys)
    ends, keys = np.append(runs, len(refs)), keys[runs]
    rows = []
    for part, lo, hi in _parts(keys, parts):
        times = np.diff(ends[lo : hi + 1]).astype(np.uint32)
        rows.append((part, kind, base, _steps(keys[lo:hi]), _planes(times), _planes(refs[ends[lo] : ends[hi]])))
    return rows


def _score(shared, held, parts: int):
    """Packed sums of the texts by what the tasks hold, and what is asked of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        words, moves, states = (Lookup(x.view(U)) for x in (tree.words, tree.moves, tree.keys[1:]))
        tops = [(1, Lookup(tree.top_states.view(U)), tree.top_back), (2, Lookup(tree.top_moves.view(U)), tree.top_extra)]
        base, root, back = tree.base_log(tree.counts), tree.root_log(tree.counts), tree.back[1:]
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for tokens, owner in _tokens(b.column(2), 1 << 18):
                begin = int(owner[0])
                owner = owner - begin
                n = int(owner[-1]) + 1
                ids = words.find(tokens.view(U))
                common = ids >= 0
                logs, open_ = np.zeros(len(ids)), np.ones(len(ids), dtype=bool)
                chains = list(_chains(tokens, owner))
                rows = []
                if tree.whole:
                    for context, gram, _, valid in reversed(chains):
                        todo = np.flatnonzero(open_ & valid)
                        state = states.find(context[todo].view(U))
                        todo, state = todo[state >= 0], state[state >= 0]
                        found = moves.find(gram[todo].view(U))
                        hit = found >= 0
                        logs[todo[hit]] += tree.logs[found[hit]]
                        open_[todo[hit]] = False
                        logs[todo[~hit]] += back[state[~hit]]
                    some = np.flatnonzero(open_ & common)
                    logs[some] += root[ids[some]]
                else:  # what the tables may know of a token's contexts is asked there
                    some = np.flatnonzero(common)
                    logs[some] += root[ids[some]]
                    before = np.roll(ids, 1)
                    before[chains[0][0] == BEGIN] = -1
                    some = np.flatnonzero(before >= 0)
                    logs[some] += tree.word_back[before[some]]
                    follows = np.append(owner[1:] == owner[:-1], False)
                    # a key is asked as what follows a context (2), and as the next token's context (1)
                    asked = [(chains[0][0], np.zeros(len(ids), dtype=bool), before < 0)]
                    asked += [(gram, valid, valid & follows & (depth < DEPTH)) for depth, (_, gram, _, valid) in enumerate(chains, 1)]
                    keys, refs = [], []
                    for key, as_move, as_state in asked:
                        bits = np.zeros(len(key), np.int64)
                        for (bit, top, value), known, at in zip(tops, held.value, (as_state, as_move)):
                            at = np.flatnonzero(at)
                            at = at[known.holds(key[at])]
                            place = top.find(key[at].view(U))
                            logs[at[place >= 0]] += value[place[place >= 0]]
                            bits[at[place < 0]] |= bit
                        at = np.flatnonzero(bits)
                        keys.append(key[at])
                        refs.append(4 * owner[at] + bits[at])
                    rows += _asked(parts, TERMS_ASKED, number + begin, np.concatenate(keys), np.concatenate(refs))
                others = np.flatnonzero(~common)
                if tree.n:
                    rows += _asked(parts, WORDS_ASKED, number + begin, tokens[others], 2 * owner[others] + open_[others])
                x = (np.ones(len(ids)), common, np.where(common, base[np.maximum(ids, 0)] if len(base) else 0, 0), logs)
                sums = np.concatenate([np.bincount(owner, v, n) for v in x])
                doc, out = b.column(0).slice(begin, n), b.column(1).slice(begin, n)
                flags = [x.to_numpy(zero_copy_only=False) for x in (doc.is_valid(), out)]
                text = (number + begin, doc.cast(pa.int64()).fill_null(0).to_numpy(), np.concatenate(flags), sums)
                yield _packed([*rows, ((number + begin) % parts, TEXTS, *text)])
            number += b.num_rows

    return run


def _terms(kind: int, parts: int):
    """Packed rows of a table of keys and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _gathered(batches, PART):
            order = np.argsort(keys.view(U))
            keys, values = keys[order].view(U), values[order].astype(float)
            yield _packed([(part, kind, 0, _steps(keys[lo:hi]), values[lo:hi]) for part, lo, hi in _parts(keys, parts)])

    return run


def _answered(tree: Tree):
    """Packed sums of the asked terms by text; texts pass."""
    n, v, discount = tree.n, tree.v, tree.discount  # all that the tasks need
    heads = Tree(n=n, v=v, discount=discount)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {STATES: [], MOVES: [], WORDS: []}
        asked = []
        for kind, base, row in _unpacked(batches):
            if kind == TEXTS:
                yield _packed([(0, kind, base, *(np.frombuffer(x, np.uint8) for x in row[:3]))])
            elif kind in tables:
                tables[kind].append((_keys(row[0]), np.frombuffer(row[1], float)))
            else:
                asked.append((kind, base, row))
        if not asked:
            return
        found = {}
        for kind, rows in tables.items():
            keys, values = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, U), np.zeros(0))
            found[kind] = Lookup(keys), np.append(values, 0.0)  # the last one is for unknown keys
        rows, size = [], 0
        for kind, base, row in asked:
            keys, times, refs = _keys(row[0]), _joined(row[1], np.uint32), _joined(row[2], np.uint32).astype(np.int64)

            def value(kind: int) -> np.ndarray:
                table, values = found[kind]
                return np.repeat(values[table.find(keys)], times)

            if kind == WORDS_ASKED:
                text, c = refs >> 1, value(WORDS)
                sums = [np.bincount(text, x) for x in (heads.root_log(c) * (refs & 1), heads.base_log(c), c > 0)]
                at = np.flatnonzero(np.bincount(text))
            else:
                sums = [np.bincount(refs >> 2, value(STATES) * (refs & 1) + value(MOVES) * (refs >> 1 & 1))]
                at = np.flatnonzero(sums[0])
            if len(at):
                rows.append((0, kind, base, _planes(at.astype(np.uint32)), np.concatenate([x[at].astype(float) for x in sums])))
                size += len(at)
            if size > 1 << 17:
                yield _packed(rows)
                rows, size = [], 0
        if rows:
            yield _packed(rows)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by text of what the tasks held and what the tables answered."""
    texts: dict = {}
    added: dict = {}
    for kind, base, row in _unpacked(batches):
        if kind == TEXTS:
            texts[base] = row
        else:
            added.setdefault(base, []).append((_joined(row[0], np.uint32), np.frombuffer(row[1], float)))
    for base, row in texts.items():
        doc, sums = np.frombuffer(row[0], np.int64), np.frombuffer(row[2], float).reshape(4, -1).copy()
        valid, out = np.frombuffer(row[1], bool).reshape(2, -1)
        for at, more in added.get(base, []):
            more = more.reshape(-1, len(at))
            sums[3, at] += more[0]
            if len(more) > 1:
                sums[2, at] += more[1]
                sums[1, at] += more[2]
        columns = [pa.array(doc, mask=~valid), pa.array(out), *(pa.array(np.rint(x).astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])]
        yield pa.RecordBatch.from_arrays(columns, schema=SUMS)


def _top(terms: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the most frequent terms, at most ``most``: they make up much of what texts ask for."""
    size = F.floor(F.log2("n") * 16).cast("int")
    sizes = terms.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("size")).collect()  # some hundreds
    held, least = 0, None
    for r in sizes:
        held += r.c
        if held > most:
            break
        least = r.size
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    top = terms.filter(size >= least).select("key", value).toPandas()
    return top["key"].to_numpy(np.int64), top[value].to_numpy(float)


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are words (A-Z lower-cased) and one end per text. Learns from the texts whose crc32(doc_id) modulo ``folds`` is
    not ``fold`` and scores all. ``base_score`` sums log10((c + 1) / (N + V + 1)) over the tokens. ``score`` is the log10
    probability under the suffix tree (see ``fit``): each token after the longest retained context that precedes it,
    backing off to shorter ones. Words unknown to the training texts are one symbol.

    A text's logarithm is the sum of its words' without context, of the back-off weight of every retained context, and of what
    every move adds to its context's back-off: each term needs one key. Common words are looked up in a table of bounded size;
    the others are asked of the counts of all words: texts' keys and tables meet by parts of the keys. So are states and
    moves where they are more than CACHE, but the most frequent. Null texts
    are empty (an end alone), a row with a null id is a training text, repeated rows count each. Without training texts
    every token is the unknown symbol, of probability 1.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    with recorded_scratch([]) as stored:
        tree, counts, states, moves = model(rows.filter("NOT held_out"))
    parts, held = 1 + tree.n // (4 * PART), None
    tables = [counts.select("word", "n").mapInArrow(_terms(WORDS, parts), PACKED_SQL)]
    if not tree.whole:
        sieves = tuple(sieve(x.select("key"), x.count()) for x in (states, moves))
        held = spark.sparkContext.broadcast(sieves)  # of bounded size
        tree.top_states, tree.top_back = _top(states, "back", CACHE // 2)
        tree.top_moves, tree.top_extra = _top(moves, "extra", CACHE // 2)
        tables.append(states.select("key", "back").mapInArrow(_terms(STATES, parts), PACKED_SQL))
        tables.append(moves.select("key", "extra").mapInArrow(_terms(MOVES, parts), PACKED_SQL))
    shared = spark.sparkContext.broadcast(tree)  # bounded: see COMMON and CACHE
    asked = rows.mapInArrow(_score(shared, held, parts), PACKED_SQL)
    for table in tables:
        asked = asked.unionByName(table)
    sums = asked.repartitionById(parts, F.col("part")).mapInArrow(_answered(tree), PACKED_SQL)
    with settings(spark, execution__arrow__maxBytesPerBatch=BATCH):
        out = materialise(sums.repartition("base").mapInArrow(_summed, SUMS_SQL), "scores")
    for path in stored:
        remove(spark, path)
    trained = F.lit(tree.n).cast("long").alias("train_tokens")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", trained, "base_score", "score")

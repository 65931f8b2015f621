"""Near duplicates by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.components import components
from barframe.llm.shingles import U, hashed_words, mix, shingle_set
from barframe.session import materialise

WIDTH = 64  # minwise tokens in a sketch
LEAF = 256  # larger nodes branch
BLOCK = 1024  # rows of a block of a dense node, at most
BLOCK_SHINGLES = 1 << 20  # and about so many shingles
DEPTH = 4
DENSE = 0.4  # mean similarity to its pivot at which a node is compared rather than branched
SIGN_SQL = "anon boolean, id long, n_shingles long, key long, sketch array<int>"
SIGN = pa.schema([("anon", pa.bool_()), ("id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("sketch", pa.list_(pa.int32()))])
_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(1 << 62, dtype=np.uint64, size=WIDTH) * U(2) + U(1)
_B = _RNG.integers(1 << 63, dtype=np.uint64, size=WIDTH)


def sketch(found: np.ndarray) -> np.ndarray:
    """The minwise token of each of ``WIDTH`` orders, as 32 bits."""
    least = np.full(WIDTH, ~U(0), U)
    for lo in range(0, len(found), 1 << 14):
        least = np.minimum(least, (found[lo : lo + (1 << 14), None] * _A + _B).min(axis=0))
    return mix(least).astype(np.uint32).view(np.int32)


def set_key(found: np.ndarray) -> int:
    """A name for a set: equal for equal sets."""
    total = np.array([found.sum(dtype=U), mix(found + U(1)).sum(dtype=U)], U)
    return int(mix(total[:1] + mix(total[1:]) * U(len(found) | 1)).view(np.int64)[0])


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, keys, sketches = [], [], []
            for _, hashes in hashed_words(b.column(2)):
                found = shingle_set(hashes, size)
                counts.append(len(found))
                keys.append(set_key(found))
                sketches.append(sketch(found))
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * WIDTH), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), lists], schema=SIGN)

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``by`` columns in sorted rows, a table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            name = tuple(c[lo] for c in columns)
            if name != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = name
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def _sift(least: int):
    """Parts of small nodes whose sketches agree in ``least`` places, named by their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, keys = [], []
        for group in _groups(batches, ["node"]):
            own, rows = group.column("key").to_numpy(), _matrix(group, "sketch")
            forest = _Forest(len(own))
            for k in range(len(own) - 1):
                for other in (k + 1 + np.flatnonzero((rows[k + 1 :] == rows[k]).sum(axis=1) >= least)).tolist():
                    forest.join(k, other)
            parts: dict[int, list[int]] = {}
            for k in range(len(own)):
                parts.setdefault(forest.find(k), []).append(k)
            for members in parts.values():
                if len(members) > 1:
                    part = np.unique(own[members])
                    leaves += [set_key(part.view(U))] * len(part)
                    keys += part.tolist()
            if len(keys) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(keys, pa.int64())], ["leaf", "key"])
                leaves, keys = [], []
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(keys, pa.int64())], ["leaf", "key"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets: products of membership matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [np.concatenate(s) for s in (left, right)]
    shared = np.intersect1d(flat[0], flat[1])
    sides = []
    for sets, values in zip((left, right), flat):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values if len(shared) else np.zeros(len(values), dtype=bool)
        rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))[hit]
        order = np.argsort(at[hit], kind="stable")
        sides.append((len(sets), rows[order], at[hit][order]))
    for lo in range(0, len(shared), columns):
        parts = []
        for n, rows, at in sides:
            a, b = np.searchsorted(at, [lo, lo + columns])
            part = np.zeros((n, min(columns, len(shared) - lo)), dtype=np.float32)
            part[rows[a:b], at[a:b] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _linked(shared, left, right, percent: int):
    """Exact test of 100 * intersection >= percent * union."""
    return 100 * shared >= percent * (left + right - shared)


def _compare(percent: int):
    """Links that join the members of each leaf, from full sets. Pairs already connected in the leaf need no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["leaf", "i", "j"]):
            seen: dict[int, tuple[int, np.ndarray]] = {}
            for key, block, blob in zip(*(group.column(c).to_pylist() for c in ("key", "block", "found"))):
                seen[key] = (block, np.frombuffer(blob, U))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            keys = [k for k, (block, _) in seen.items() if block == i] + [k for k, (block, _) in seen.items() if block == j and i != j]
            cut = sum(seen[k][0] == i for k in keys)
            forest, links = _Forest(len(keys)), []
            if len(keys) <= 8:
                for x, y in combinations(range(len(keys)), 2):
                    if i != j and (x < cut) == (y < cut):
                        continue
                    a, b = seen[keys[x]][1], seen[keys[y]][1]
                    if forest.find(x) != forest.find(y) and _linked(len(np.intersect1d(a, b, True)), len(a), len(b), percent):
                        forest.join(x, y)
                        links.append((keys[x], keys[y]))
            else:
                left = [seen[k][1] for k in keys[:cut]]
                right = left if i == j else [seen[k][1] for k in keys[cut:]]
                if left and right:
                    shared = overlaps(left, right).astype(np.int64)
                    sizes = [np.array(list(map(len, s)), np.int64) for s in (left, right)]
                    offset = 0 if i == j else cut
                    for x, y in np.argwhere(_linked(shared, sizes[0][:, None], sizes[1][None, :], percent)).tolist():
                        if forest.join(x, y + offset):
                            links.append((keys[x], keys[y + offset]))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(size: int):
    """Shingle sets of texts that have the set named by their ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [shingle_set(hashes, size) for _, hashes in hashed_words(part.column(1))]
                same = pa.array(np.array([set_key(s) for s in sets], np.int64) == part.column(0).to_numpy())
                arrays = [part.column(0), pa.array((s.tobytes() for s in sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "found"]).filter(same)

    return run


def _agreement(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, e: s + e) / F.lit(float(WIDTH))


def trees_for(similarity: float, recall: float) -> int:
    """Trees so that a pair at the threshold shares a leaf of some tree with probability ``recall``: one position is
    drawn at the root, two at each of up to DEPTH - 1 further nodes."""
    one = similarity * (1 - (1 - similarity) ** 2) ** (DEPTH - 1)
    return min(WIDTH, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _leaves(classes: DataFrame, percent: int, recall: float) -> DataFrame:
    """``leaf, key``: groups of sets to compare in full, from independent trees of minwise tokens."""
    similarity = percent / 100
    least = math.floor(WIDTH * (similarity - 5 * math.sqrt(similarity * (1 - similarity) / WIDTH)))
    spots = [k * 37 % WIDTH for k in range(trees_for(similarity, recall))]
    first = F.explode(F.array(*[F.xxhash64(F.lit(s), F.col("sketch")[s]) for s in spots])).alias("node")
    entries = classes.select("key", first)
    out, dense = [], []
    for depth in range(1, DEPTH + 1):
        sizes = entries.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        crowded = materialise(entries.join(sizes, "node"), f"paths-{depth}")
        small = crowded.filter(F.col("n") <= LEAF).join(classes.select("key", "sketch"), "key").select("node", "key", "sketch")
        dealt = small.repartition(F.col("node")).sortWithinPartitions("node")
        out.append(materialise(dealt.mapInArrow(_sift(least), "leaf long, key long").distinct(), f"small-{depth}"))
        big = materialise(crowded.filter(F.col("n") > LEAF).drop("n").join(classes.select("key", "sketch"), "key"), f"large-{depth}")
        pivots = big.groupBy("node").agg(F.min("key").alias("key")).join(classes.select("key", F.col("sketch").alias("p")), "key")
        near = big.join(pivots.select("node", F.col("key").alias("pivot"), "p"), "node")
        means = near.groupBy("node", "pivot").agg(F.avg(_agreement("sketch", "p")).alias("mean"))
        last = F.lit(depth == DEPTH) | (F.col("mean") >= DENSE)
        means = materialise(means.withColumn("last", last), f"nodes-{depth}")
        last = big.select("node", "key").join(means.filter("last").select("node", "pivot"), "node").select(F.col("pivot").alias("leaf"), "key")
        dense.append(materialise(last, f"dense-{depth}"))
        if depth == DEPTH or not means.filter("NOT last").limit(1).count():
            break
        spot = [F.pmod(F.xxhash64("node", F.lit(c)), F.lit(WIDTH)).cast("int") for c in (1, 2)]
        child = F.explode(F.array(*[F.xxhash64("node", s, F.element_at("sketch", s + 1)) for s in spot])).alias("node")
        entries = big.join(means.filter("NOT last").select("node"), "node").select("key", child)
    small = out[0]
    for part in out[1:]:
        small = small.unionByName(part)
    large = dense[0]
    for part in dense[1:]:
        large = large.unionByName(part)
    # Dense nodes of several trees with one pivot are one leaf. Leaves beyond a block are compared block by block.
    small = small.distinct().withColumns({"block": F.lit(0), "blocks": F.lit(1)})
    rows, volume = F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES
    large = materialise(large.distinct(), "dense")
    sized = large.join(classes.select("key", "size"), "key")
    counts = sized.groupBy("leaf").agg(F.ceil(F.greatest(rows, volume)).cast("int").alias("blocks"))
    large = large.join(counts, "leaf").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    return small.unionByName(large.select("leaf", "key", "block", "blocks"))


def _name(of: str = "") -> list[Column]:
    """A document's name: its id, or for want of one a hash of its text, ``anon``. Names sort with ids first."""
    doc_id, text = F.col(f"{of}doc_id"), F.col(f"{of}text")
    return [doc_id.isNull().alias("anon"), F.coalesce(doc_id, F.xxhash64(text)).alias("id")]


def _classes(signs: DataFrame) -> DataFrame:
    """One row per distinct set, named by its least document."""
    held = signs.filter("n_shingles > 0").groupBy("key")
    least = held.agg(F.min(F.struct("anon", "id")).alias("name"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    return least.select("key", "name.*", "sketch", "size")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, recall: float) -> DataFrame:
    """Links ``a, b`` between class keys that connect exactly what the links of all similar pairs connect."""
    leaves = materialise(_leaves(classes, percent, recall), "leaves")
    # A set is built from its class's least document, which alone is read: texts meet the wanted names before that.
    members = leaves.select("key").distinct().join(classes.select("key", "anon", "id"), "key")
    read = docs.filter("text IS NOT NULL").select(*_name(), "text").join(members, ["anon", "id"])
    sets = read.select("key", "text").mapInArrow(_sets(size), "key long, found binary")
    sets = materialise(sets.dropDuplicates(["key"]), "sets")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = leaves.withColumn("other", F.explode(others)).select(
        "leaf", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    dealt = pairs.join(sets, "key").repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def _members(docs: DataFrame, size: int, percent: int, recall: float) -> DataFrame:
    """``anon, id, n_shingles, component`` (the name of the least document reachable) of each row."""
    signs = materialise(docs.select(*_name(), "text").mapInArrow(_sign(size), SIGN_SQL), "signs")
    classes = materialise(_classes(signs), "classes")
    roots = components(links(docs, classes, size, percent, recall))
    named = classes.join(roots, F.col("key") == F.col("vertex"), "left").select("key", F.struct("anon", "id").alias("name"), F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("name").alias("component"))
    chosen = materialise(named.join(least, "root").select("key", "component"), "components")
    joined = signs.select("anon", "id", "n_shingles", "key").join(chosen, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.struct("anon", "id"))
    return joined.select("anon", "id", "n_shingles", component.alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = 1 - 1e-6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row, by sets of ``size``-word shingles.

    Rows with equal sets form a class, which is represented once. Each of several trees sends a class to a node by one
    minwise token of its sketch; nodes over ``LEAF`` members branch by two further tokens, unless their members resemble
    each other already. Small nodes are compared by sketch and then, like the dense ones (in blocks), by full sets:
    a link needs 100 * intersection >= ``percent`` * union. A pair at the threshold is missed by all trees with
    probability 1 - ``recall``. Only links that connect something new in a comparison are returned, so copies never
    become all their pairs; components of the links give the smallest id reachable.

    Texts with fewer words are one shingle of all their words. Texts without words, and null, have no shingles and are
    their own component. Rows repeating an id share it as one document would. Rows with a null id are documents named by
    their texts, which come after all ids: they stay if no row with an id, nor another of them with a smaller hash, is reachable.
    """
    found = _members(docs, size, percent, recall)
    return found.select(
        F.when(~F.col("anon"), F.col("id")).alias("doc_id"), "n_shingles",
        F.when(~F.col("component.anon"), F.col("component.id")).alias("component_id"), (F.struct("anon", "id") == F.col("component")).alias("kept"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = 1 - 1e-6) -> DataFrame:
    """The documents kept by ``near_duplicates``, with all their columns; repeated rows of one id and text stay once."""
    kept = _members(docs, size, percent, recall).filter(F.struct("anon", "id") == F.col("component"))
    kept = kept.groupBy("anon", "id").agg(F.count(F.lit(1)).alias("n"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    rows = whole.select("d", *_name("d.")).join(kept, ["anon", "id"])
    # Only names on several rows need a look at their texts; these meet by a hash, so that texts don't travel as keys.
    once = rows.filter("n = 1").select("d")
    several = rows.filter("n > 1").withColumn("h", F.sha2(F.coalesce("d.text", F.lit("")), 256))
    several = several.withColumn("h", F.when(F.col("d.text").isNotNull(), F.col("h")).otherwise("")).dropDuplicates(["anon", "id", "h"])
    return once.unionByName(several.select("d")).select("d.*")

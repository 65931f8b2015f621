"""Exact top-k inner products over shards of integer vectors with MaxScore bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 13
FIRST = 256
STEP = 16
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Shard:
    """Impacts of one block of vectors, as a posting per component and sign.

    Shifted by the block's smallest or largest value, every component of the side that a query's sign asks for is at
    least 0, so a query term contributes between 0 and its bound |q| * (largest - smallest).
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low, self.high = self.values.min(axis=0), self.values.max(axis=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to smaller ids; ``own`` takes no part."""
        base = np.where(query > 0, query * self.low, query * self.high).sum()
        bounds = np.abs(query) * (self.high - self.low)
        terms = np.argsort(-bounds, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[terms][::-1])[::-1], [0]])  # what terms[i:] can still add
        others = self.ids != own

        def best(rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if len(rows) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[scores >= least], scores[scores >= least]
            order = np.lexsort((self.ids[rows], -scores))[:k]
            return rows[order], scores[order]

        head = np.flatnonzero(others[:FIRST])
        top, scores = best(head, self.values[head] @ query)
        tail = FIRST + np.flatnonzero(others[FIRST:])
        if len(tail):
            floor = scores[-1] if len(scores) == k else None
            # Terms whose bounds together cannot lift a vector to the floor are not essential: they are only probed.
            essential = len(terms) if floor is None else int(np.searchsorted(-(base + rest), -floor, side="right"))
            essential = min(max(essential, 1), len(terms))
            partial = np.full(len(tail), base)
            at = 0
            while at < len(terms):
                upto = essential if at == 0 else min(at + STEP, len(terms))
                step = terms[at:upto]
                weight = query[step]
                shift = np.where(weight > 0, self.low[step], self.high[step])
                partial = partial + self.values[np.ix_(tail, step)] @ weight - shift @ weight
                at = upto
                if floor is not None:
                    keep = partial + rest[at] >= floor
                    tail, partial = tail[keep], partial[keep]
                    if not len(tail):
                        break
            top, scores = best(np.concatenate([top, tail]), np.concatenate([scores, partial]))
        return self.ids[top], scores


def _matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    flat = column.combine_chunks()
    out = np.zeros((len(flat), width), dtype=kind)
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy()
    if len(values):
        rows = np.repeat(np.arange(len(flat)), lengths)
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return OUT.empty_table()
        sizes = [max(map(len, t.column("v").to_pylist()), default=0) for t in (vectors, queries)]
        width = max(*sizes, 1)
        a, b = _matrix(vectors.column("v"), width, np.int64), _matrix(queries.column("v"), width, np.int64)
        bound = float(np.abs(a.astype(float)).max(axis=0) @ np.abs(b.astype(float)).max(axis=0))
        kind = float if bound < 1 << 51 else object  # doubles are exact up to there
        shard, b = Shard(vectors.column("vec_id").to_numpy(), a.astype(kind)), b.astype(kind)
        found = [[], [], []]
        for own, query in zip(queries.column("vec_id").to_pylist(), b):
            ids, scores = shard.search(query, own, k)
            found[0] += [own] * len(ids)
            found[1] += ids.tolist()
            found[2] += [int(s) for s in scores]
        return pa.table(found, schema=OUT)

    return run


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component; rows with a null or non-finite component are left out."""
    x = F.col("embedding")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(whole)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries`` (both ``vec_id, v``).

    Result: ``query_id, rank, vec_id, score``, equal scores by smaller vec_id, the query's own vec_id left out. Both
    sides are dealt into blocks of about ``block`` rows by a hash of the row; every block of queries meets every block
    of vectors in a task of its own, which returns k rows per query; a window merges them. Missing components of a
    shorter vector count as 0; repeated rows of ``vectors`` are found once each, repeated rows of ``queries`` once.
    """
    shards, groups = (max(1, -(-df.count() // block)) for df in (vectors, queries))

    def of(n: int):
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.withColumn("shard", of(shards)).withColumn("part", every(groups))
    right = queries.dropDuplicates().withColumn("part", of(groups)).withColumn("shard", every(shards))
    pairs = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part"))
    found = pairs.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

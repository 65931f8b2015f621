"""Nearest-neighbour retrieval over bar embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.vectors import l2_normalise
from barframe.operators.series import over_rows, with_position
from barframe.operators.tables import key_hash, latest_common_key, spread_join, top_n_per
from barframe.operators.windows import collect_windows
from barframe.schema import SERIES, TS, regime_name
from barframe.session import materialise

TILE = 2048  # rows of a block of queries or of corpus vectors, unless a series would have more than MEETINGS such blocks
MEETINGS = 8  # blocks a side: every block travels once per block of the other side
ENTRIES = 1 << 22  # numbers in a block's vectors, however long the series
_STEP = (256, 1024)  # queries and vectors multiplied at once
_PAIRS = 1 << 19  # numbers of pairs computed one by one; beyond it a step is multiplied again in double precision
_SIDE = ("pair", "interval", "_us", "regime", "embedding")
_MATCH = "pair string, interval string, q_us long, m_us long, similarity double, regime long"
_DIGITS = 12  # similarities are compared at 12 decimals, so copies of a vector tie and time decides


def build_vectors(emb: DataFrame, regimes: DataFrame) -> DataFrame:
    """Unit vectors with regime, for bars that have both."""
    key = [*SERIES, TS]
    joined = emb.select(*key, "embedding").join(regimes.select(*key, "regime"), key)
    return joined.withColumn("embedding", l2_normalise(F.col("embedding")))


def store_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Persist the vector table (partitioned by series) and read it back; an empty one is an error."""
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").partitionBy(*SERIES).parquet(path)
    stored = spark.read.parquet(path)
    if stored.limit(1).count() == 0:
        raise ValueError("no bars have both an embedding and a regime")
    return stored


def _unit(column: pa.ChunkedArray, place: np.ndarray) -> np.ndarray:
    """Unit vectors of a list column, each at its place; zero vectors stay zero. Converted chunk by chunk."""
    out, done = None, 0
    for chunk in column.chunks:
        if not len(chunk):
            continue
        vectors = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        if out is None:
            out = np.empty((len(place), vectors.shape[1]))
        elif vectors.shape[1] != out.shape[1]:
            raise ValueError("a vector is null, or vectors differ in length")
        out[place[done : done + len(chunk)]] = vectors / np.where(size < 1e-12, 1.0, size)
        done += len(chunk)
    return out


class _Block:
    """One bounded block of a series' vectors as arrays, by time; ``order``: of the table's rows; ``short``: in single precision."""

    def __init__(self, table: pa.Table):
        at = table.column("_us").to_numpy()
        self.order = np.argsort(at, kind="stable")
        place = np.empty(len(at), np.int64)
        place[self.order] = np.arange(len(at))
        self.at = at[self.order]
        self.regime = pc.fill_null(table.column("regime"), -1).to_numpy()[self.order]
        self.vectors = _unit(table.column("embedding"), place)
        self.short = self.vectors.astype(np.float32)


class _Best:
    """The best ``k`` of each query of a block so far: by similarity, then earliest time."""

    def __init__(self, q: _Block, k: int, same_regime: bool, exclude_us: int, history_only: bool):
        self.q, self.k, self.same_regime, self.exclude_us, self.history_only = q, k, same_regime, exclude_us, history_only
        # of a sum of products in any order, with rounded factors of vectors no longer than 1; a similarity's last digits besides
        self.error = 1.01 * (q.vectors.shape[1] + 8) * 2.0**-24 + 2 * 10.0**-_DIGITS
        shape = (len(q.at), k)
        self.sim, self.at = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max)
        self.regime = np.full(shape, -1, np.int64)

    def meet(self, wanted: np.ndarray, c: _Block, rows: np.ndarray) -> None:
        """Compare the queries ``wanted`` with the vectors ``rows`` of another block."""
        if not self.same_regime:
            return self._meet(wanted, c, rows)
        regimes = self.q.regime[wanted]
        for regime in np.unique(regimes):  # queries without a regime meet all
            self._meet(wanted[regimes == regime], c, rows[c.regime[rows] == regime] if regime >= 0 else rows)

    def _meet(self, wanted: np.ndarray, c: _Block, rows: np.ndarray) -> None:
        """Both in the order of their blocks, which is that of time."""
        short, at = (x if len(rows) == len(c.at) else x[rows] for x in (c.short, c.at))
        for lo in range(0, len(wanted), _STEP[0]):
            some = wanted[lo : lo + _STEP[0]]
            asked = self.q.short[some]
            end = int(np.searchsorted(at, self.q.at[some[-1]])) if self.history_only else len(rows)
            for at_row in range(0, end, _STEP[1]):
                part = slice(at_row, min(at_row + _STEP[1], end))
                self._enter(some, asked @ short[part].T, c, rows[part])

    def _allowed(self, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
        ok = np.ones(np.broadcast_shapes(asked.shape, at.shape), bool)
        if self.history_only:
            ok &= at < asked
        if self.exclude_us > 0:
            ok &= np.abs(at - asked) >= self.exclude_us
        return ok

    def _exact(self, asked: np.ndarray, c: _Block, which: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", self.q.vectors[asked], c.vectors[which]), _DIGITS)

    def _enter(self, some: np.ndarray, near: np.ndarray, c: _Block, which: np.ndarray) -> None:
        """``near``: similarities in single precision, which are too low or high by less than ``self.error``.

        They only leave out what cannot be among the best; the others' are computed in double precision.
        """
        last, last_at = self.sim[some, -1], self.at[some, -1]
        fresh = np.isneginf(last)
        if fresh.any() and not fresh.all():
            for part in (fresh, ~fresh):
                self._enter(some[part], near[part], c, which)
            return
        at = c.at[which]
        if fresh.any():  # lists that aren't full take anything: the best of this part only
            near = np.where(self._allowed(self.q.at[some][:, None], at[None]) & ~np.isnan(near), near, np.float32(-np.inf))
            last_here = np.partition(near, -self.k, axis=1)[:, -self.k] if near.shape[1] > self.k else near.min(axis=1)
            found = np.flatnonzero((near >= (last_here - 2 * self.error).astype(np.float32)[:, None]) & (near > -np.inf))
        else:
            found = np.flatnonzero(near >= (last - self.error).astype(np.float32)[:, None])
        if not len(found):
            return
        i, j = np.divmod(found, near.shape[1])
        if len(found) * c.vectors.shape[1] <= _PAIRS:
            sim = self._exact(some[i], c, which[j])
        else:
            sim = np.round((self.q.vectors[some] @ c.vectors[which].T).ravel()[found], _DIGITS)
        enters = (sim > last[i]) | ((sim == last[i]) & (at[j] < last_at[i]))
        enters &= self._allowed(self.q.at[some[i]], at[j])
        i, j, sim = i[enters], j[enters], sim[enters]
        if not len(i):
            return
        changed = np.unique(i)
        rows, k = some[changed], self.k
        of = np.concatenate([i, np.repeat(changed, k)])
        sim = np.concatenate([sim, self.sim[rows].ravel()])
        at = np.concatenate([at[j], self.at[rows].ravel()])
        regime = np.concatenate([c.regime[which[j]], self.regime[rows].ravel()])
        order = np.lexsort((at, -sim, of))
        first = np.searchsorted(of[order], changed)
        best = order[first[:, None] + np.arange(k)]  # every changed query has k old places at least
        self.sim[rows], self.at[rows], self.regime[rows] = sim[best], at[best], regime[best]

    def table(self, pair: str, interval: str, schema: pa.Schema) -> pa.Table:
        i, j = np.nonzero(self.sim > -np.inf)
        columns = [self.q.at[i], self.at[i, j], self.sim[i, j], self.regime[i, j]]
        return _filled(pair, interval, columns, schema)


def _filled(pair: str, interval: str, columns: list, schema: pa.Schema) -> pa.Table:
    columns = [pa.repeat(pa.scalar(x, pa.string()), len(columns[0])) for x in (pair, interval)] + columns
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _asking(lists: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """Bytes x queries: of each query's words of bits, a bit per list."""
    words = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]).reshape(len(order), -1)
    return np.ascontiguousarray(words[order].astype("<i8").view(np.uint8).T)


def _tiled(rows: DataFrame, sizes: DataFrame, by: list[str], own: str, other: str, place: Column | None = None) -> DataFrame:
    """Rows with their block ``own`` by a hash of the key, once for every block ``other`` of the same group's other side."""
    place = F.xxhash64(*SERIES, "_us") if place is None else place
    placed = spread_join(rows, sizes, by).withColumn(own, F.pmod(place, F.col(f"n{own}")).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))).drop("n_q", "n_c")


def _blocks(df: DataFrame, name: str, tile: int, more: int | Column = 0) -> DataFrame:
    """Number of blocks of each series: of ``tile`` rows, but no more than MEETINGS unless these would hold more than ENTRIES numbers.

    ``more``: numbers that a row takes besides its vector.
    """
    small = F.ceil(F.count(F.lit(1)) / tile)
    large = F.greatest(F.lit(MEETINGS), F.ceil(F.sum(F.size("embedding") + more) / ENTRIES))
    return df.groupBy(*SERIES).agg(F.least(small, large).cast("int").alias(name))


def _side(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*SERIES, F.unix_micros(TS).alias("_us"), F.col("regime").cast("long").alias("regime"), F.col("embedding").cast("array<double>"), *more)


def _meetings(wanted: DataFrame, corpus: DataFrame, k: int, options: tuple, tile: int, listed: bool = False) -> DataFrame:
    """The best ``k`` of each query among the vectors of its series, block by block.

    ``listed``: a query has the bits ``_lists``, a vector ``_list`` and the ``_part`` of it; only vectors of a query's lists count.
    """
    by = list(SERIES)
    more = 3 * k + (F.size("_lists") if listed else F.lit(0))  # a query's places and bits
    sizes = materialise(_blocks(wanted, "n_q", tile, more).join(_blocks(corpus, "n_c", tile), by), "tiles")
    left = _tiled(wanted, sizes, by, "_q", "_c")
    # renamed, so that queries and corpus read from the same table stay apart in the plan
    right = _tiled(corpus, sizes, by, "_c", "_q", F.xxhash64("_list", "_part") if listed else None)
    right = right.select(*[F.col(n).alias(f"c{n}") for n in right.columns])
    names = ["pair", "interval", "q_us", "m_us", "similarity", "regime"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()])))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return schema.empty_table()
        held = [*_SIDE, "_list"] if listed else list(_SIDE)
        others = others.select([f"c{n}" for n in held]).rename_columns(held)
        q, c = _Block(some), _Block(others)
        best = _Best(q, k, *options)
        if listed:
            asking = _asking(some.column("_lists"), q.order)
            number = others.column("_list").to_numpy()[c.order]
            order = np.argsort(number, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                of = int(number[rows[0]])
                best.meet(np.flatnonzero(asking[of >> 3] & (1 << (of & 7))), c, rows)
        else:
            best.meet(np.arange(len(q.at)), c, np.arange(len(c.at)))
        return best.table(some.column("pair")[0].as_py(), some.column("interval")[0].as_py(), schema)

    keys = [*by, "_q", "_c"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*[f"c{c}" for c in keys])).applyInArrow(meet, _MATCH)
    order = [F.col("similarity").desc(), F.col("m_us").asc()]
    ranked = top_n_per(parts, ["pair", "interval", "q_us"], order, k, rank="rank")
    regime = F.when(F.col("regime") >= 0, F.col("regime").cast("int"))
    return ranked.select(
        *SERIES, F.timestamp_micros("q_us").alias("query_time"), "rank", F.timestamp_micros("m_us").alias(TS),
        "similarity", regime.alias("regime"), regime_name(regime).alias("regime_name"),
    )


def similar_bars(
    queries: DataFrame, vectors: DataFrame, k: int = 10, same_regime: bool = True, exclude_seconds: int = 0,
    history_only: bool = False, tile: int = TILE,
) -> DataFrame:
    """The ``k`` most similar bars of each query bar, within its series, exactly.

    Filters (regime, minimum distance in time, strictly earlier) apply before ranking. Each series' queries and vectors
    are dealt into blocks of about ``tile`` rows by a hash of the bar, but into no more than MEETINGS blocks unless these
    would hold more than ENTRIES numbers; every block of queries meets every block of vectors of its own series in a task,
    which multiplies them in small steps and returns its best ``k`` per query: no pair of vectors becomes a row, and a row
    travels once per block of the other side. Ties in similarity go to the earlier bar.
    """
    return _meetings(_side(queries), _side(vectors), k, (same_regime, exclude_seconds * 1_000_000, history_only), tile)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """Exact top-k by cosine, no filters (the query itself may match)."""
    none = F.lit(None).cast("int")
    fill = lambda df: df if "regime" in df.columns else df.withColumn("regime", none)
    return similar_bars(fill(queries), fill(corpus), k, same_regime=False)


# --------------------------------------------------------------------------- candidate search
def choose_leaders(vectors: DataFrame, seed: int = 0, most: int = 16_384) -> DataFrame:
    """About the square root of each series' vectors, drawn by a seeded hash of the bar: the heads of the index's lists.

    ``most`` bounds the sample of a series; beyond it lists grow instead. Adds ``n_leaders`` and ``number``, a leader's place
    in its series from 0 (copies of a bar share it).
    """
    many = F.least(F.lit(most), F.ceil(F.sqrt(F.count(F.lit(1))))).cast("int")
    sizes = vectors.groupBy(*SERIES).agg(many.alias("n_leaders"))
    order = [key_hash(vectors, (*SERIES, TS), seed), F.col(TS)]
    drawn = top_n_per(vectors, SERIES, order, most, rank="_draw")
    drawn = drawn.join(sizes, list(SERIES)).filter(F.col("_draw") <= F.col("n_leaders")).drop("_draw")
    return drawn.withColumn("number", F.dense_rank().over(Window.partitionBy(*SERIES).orderBy(TS)) - 1)


def build_index(vectors: DataFrame, leaders: DataFrame) -> DataFrame:
    """Every vector with ``leader``, the time of the leader most similar to it, and its ``number``: a vector is in one list."""
    nearest = similar_bars(vectors, leaders, 1, same_regime=False)
    nearest = nearest.select(*SERIES, F.col("query_time").alias(TS), F.col(TS).alias("leader"))
    numbers = leaders.select(*SERIES, F.col(TS).alias("leader"), "number").distinct()
    return vectors.join(spread_join(nearest, numbers, [*SERIES, "leader"]), [*SERIES, TS])


def store_index(vectors: DataFrame, path: str, seed: int = 0, most: int = 16_384) -> None:
    """Persist an index below ``path``: ``leaders`` and ``lists``, both by series, a list's vectors next to each other."""
    choose_leaders(vectors, seed, most).write.mode("overwrite").partitionBy(*SERIES).parquet(f"{path}/leaders")
    leaders = vectors.sparkSession.read.parquet(f"{path}/leaders")
    lists = build_index(vectors, leaders).repartition(*SERIES, "leader").sortWithinPartitions(*SERIES, "leader", TS)
    lists.write.mode("overwrite").partitionBy(*SERIES).parquet(f"{path}/lists")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(leaders, lists) of a stored index."""
    return spark.read.parquet(f"{path}/leaders"), spark.read.parquet(f"{path}/lists")


def _firsts(sims: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` greatest of each row, equal ones from the left."""
    known = sims > -np.inf
    if k >= sims.shape[1]:
        return known
    last = np.partition(sims, -k, axis=1)[:, [-k]]
    above, equal = sims > last, sims == last
    room = k - above.sum(axis=1, keepdims=True)
    return known & (above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room)))


def _taken(q: _Block, leaders: _Block, number: np.ndarray, k: int):
    """Yields times of queries and how often each number is among their ``k`` nearest leaders; a query's copies choose together."""
    times, start, copies = np.unique(q.at, return_index=True, return_counts=True)
    numbers, first = np.unique(number, return_index=True)  # leaders are by time, and so are their numbers
    for n in np.unique(copies):
        of = np.flatnonzero(copies == n)
        step = max(1, _STEP[0] * _STEP[1] // (n * len(number)))
        for lo in range(0, len(of), step):
            some = of[lo : lo + step]
            sims = np.round(q.vectors[(start[some][:, None] + np.arange(n)).ravel()] @ leaders.vectors.T, _DIGITS)
            sims = np.where(np.isnan(sims), -np.inf, sims).reshape(len(some), n, -1).transpose(0, 2, 1)
            chosen = _firsts(sims.reshape(len(some), -1), k).reshape(sims.shape).sum(axis=2, dtype=np.int32)
            taken = np.zeros((len(some), int(numbers[-1]) + 1), np.int32)
            taken[:, numbers] = np.add.reduceat(chosen, first, axis=1)
            any_ = taken.any(axis=1)
            yield times[some][any_], taken[any_]


def _words(taken: np.ndarray) -> np.ndarray:
    """Words of 64 bits, the lowest first: a bit per number that is taken."""
    bits = np.zeros((len(taken), -(-taken.shape[1] // 64) * 64), bool)
    bits[:, : taken.shape[1]] = taken > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").astype(np.int64)


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def probe_lists(queries: DataFrame, leaders: DataFrame, probe: int | float, packed: bool = False) -> DataFrame:
    """``pair, interval, query_time, leader``: the lists that each query looks into, those of its nearest leaders.

    ``probe`` is their number, or below 1 their share of the series' leaders. ``packed``: one row per query, with ``lists``,
    words of 64 bits with one for each leader's number, instead of ``leader``; ``again`` has the numbers that copies of bars
    choose once more. A series' leaders, of which ``choose_leaders`` bounds the number, meet each block of its queries.
    """
    by, share = list(SERIES), probe < 1
    most = F.ceil(F.lit(float(probe)) * F.max("n_leaders")) if share else F.lit(int(probe))
    known = leaders.groupBy(*by).agg(most.cast("int").alias("_most"), F.lit(1).alias("n_c"))
    wanted = _side(spread_join(queries, known.drop("n_c"), by), "_most")
    sizes = _blocks(wanted, "n_q", TILE, F.lit(0) if packed else 4 * F.col("_most"))
    sizes = materialise(sizes.join(known.drop("_most"), by), "tiles")
    left = _tiled(wanted, sizes, by, "_q", "_c")
    right = _tiled(_side(leaders, "number"), sizes, by, "_c", "_q")
    right = right.select(*[F.col(n).alias(f"c{n}") for n in right.columns])
    found = "lists array<long>, again array<int>" if packed else "leader long"
    many = {"lists": pa.list_(pa.int64()), "again": pa.list_(pa.int32())} if packed else {"leader": pa.int64()}
    schema = pa.schema({"pair": pa.string(), "interval": pa.string(), "query_time": pa.int64(), **many})

    def choose(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return schema.empty_table()
        names = [*_SIDE, "number"]
        others = others.select([f"c{n}" for n in names]).rename_columns(names)
        k, pair, interval = (some.column(c)[0].as_py() for c in ("_most", "pair", "interval"))
        q, c = _Block(some), _Block(others)
        number, parts = others.column("number").to_numpy()[c.order], []
        at = np.zeros(int(number[-1]) + 1, np.int64)
        at[number] = c.at
        for times, taken in _taken(q, c, number, k):
            if packed:
                words, more = _words(taken), np.maximum(taken - 1, 0)
                columns = [
                    times, _listed(words.ravel(), np.full(len(words), words.shape[1])),
                    _listed(np.repeat(np.nonzero(more)[1], more[more > 0]).astype(np.int32), more.sum(axis=1)),
                ]
            else:
                i, j = np.nonzero(taken)
                often = taken[i, j]
                columns = [np.repeat(times[i], often), np.repeat(at[j], often)]
            parts.append(_filled(pair, interval, columns, schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    keys = [*by, "_q", "_c"]
    out = left.groupBy(*keys).cogroup(right.groupBy(*[f"c{c}" for c in keys])).applyInArrow(
        choose, f"pair string, interval string, query_time long, {found}"
    )
    out = out.withColumn("query_time", F.timestamp_micros("query_time"))
    return out if packed else out.withColumn("leader", F.timestamp_micros("leader"))


def _packed(probes: DataFrame, lists: DataFrame) -> DataFrame:
    """``pair, interval, query_time, lists`` of probes with a row for each list."""
    by, query = list(SERIES), [*SERIES, "query_time"]
    numbers = lists.select(*by, "leader", "number").distinct()
    bits = F.bit_or(F.expr("shiftleft(1L, cast(number % 64 AS int))"))
    word = F.expr("cast(number div 64 AS int)")
    words = spread_join(probes, numbers, [*by, "leader"]).groupBy(*query, word.alias("word")).agg(bits.alias("bits"))
    held = words.groupBy(*query).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    held = spread_join(held, lists.groupBy(*by).agg(F.max(word).alias("last")), by)
    every = F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("bigint")))
    return held.select(*query, every.alias("lists"))


def approximate_topk(
    queries: DataFrame, lists: DataFrame, probes: DataFrame, k: int = 10, same_regime: bool = True, exclude_seconds: int = 0,
    history_only: bool = False, tile: int = TILE,
) -> DataFrame:
    """Top-k among the vectors of the lists that each query probes; may miss neighbours in other lists.

    ``probes`` may be packed or not. A query travels with a bit for each list of its series; a block of vectors holds whole
    lists, or parts of lists beyond ``tile`` rows, so that no task holds a long list. Candidates are ranked by their exact
    similarity.
    """
    asked = probes if "lists" in probes.columns else _packed(probes, lists)
    asked = asked.select(*SERIES, "query_time", F.col("lists").alias("_lists"))
    asked = queries.withColumn("query_time", F.col(TS)).join(asked, [*SERIES, "query_time"])
    parts = lists.groupBy(*SERIES, "leader").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_parts"))
    held = spread_join(lists, parts, [*SERIES, "leader"]).withColumns({
        "_list": F.col("number"), "_part": F.pmod(F.xxhash64(TS), F.col("_parts")).cast("int"),
    })
    options = (same_regime, exclude_seconds * 1_000_000, history_only)
    return _meetings(_side(asked, "_lists"), _side(held, "_list", "_part"), k, options, tile, listed=True)


def _asked(probes: DataFrame) -> DataFrame:
    """``pair, interval, number, q``: how many probes a list has, in parts; of packed probes."""
    schema = pa.schema({"pair": pa.string(), "interval": pa.string(), "number": pa.int32(), "q": pa.int64()})

    def count(batches):
        for batch in batches:
            table = pa.table(batch)
            for pair, interval in {*zip(table["pair"].to_pylist(), table["interval"].to_pylist())}:
                own = table.filter(pc.and_(pc.equal(table["pair"], pair), pc.equal(table["interval"], interval)))
                bits = _asking(own["lists"], np.arange(own.num_rows))
                q = np.concatenate([[np.count_nonzero(row & (1 << b)) for b in range(8)] for row in bits])
                again = np.concatenate([c.flatten().to_numpy() for c in own["again"].chunks])
                q += np.bincount(again, minlength=len(q))
                yield from _filled(pair, interval, [np.arange(len(q)), q], schema).to_batches()

    return probes.mapInArrow(count, "pair string, interval string, number int, q long").filter("q > 0")


def search_cost(probes: DataFrame, lists: DataFrame) -> DataFrame:
    """``pair, interval, compared, all_pairs``: pairs of vectors that ``approximate_topk`` multiplies, and an exact search would."""
    if "lists" in probes.columns:
        key = [*SERIES, "number"]
        met = _asked(probes).groupBy(*key).agg(F.sum("q").alias("q"))
    else:
        key = [*SERIES, "leader"]
        met = probes.groupBy(*key).agg(F.count(F.lit(1)).alias("q"))
    met = met.join(lists.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), key)
    compared = met.groupBy(*SERIES).agg(F.sum(F.col("q") * F.col("c")).alias("compared"))
    asked = probes.select(*SERIES, "query_time").distinct().groupBy(*SERIES).agg(F.count(F.lit(1)).alias("q"))
    held = lists.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("c"))
    every = asked.join(held, list(SERIES)).select(*SERIES, (F.col("q") * F.col("c")).alias("all_pairs"))
    return compared.join(every, list(SERIES))


def with_anchor(requested: DataFrame, vectors: DataFrame, regimes: DataFrame) -> DataFrame:
    """Resolve requested bars: a bar without a vector is replaced by the series' latest embedded bar.

    ``requested`` holds ``pair, interval, open_time``; adds ``query_time`` and ``substituted``.
    """
    anchor = latest_common_key(vectors, regimes)
    have = vectors.select(*SERIES, TS, F.lit(True).alias("_have"))
    out = requested.join(have, [*SERIES, TS], "left").join(anchor, list(SERIES), "left")
    return out.select(
        *SERIES, TS, F.when(F.col("_have"), F.col(TS)).otherwise(F.col("latest")).alias("query_time"),
        F.col("_have").isNull().alias("substituted"),
    )


def similar(requested: DataFrame, vectors: DataFrame, k: int = 10, **filters) -> DataFrame:
    """The ``k`` most similar bars of each requested bar, or of its series' latest indexed bar where it has no vector.

    ``requested``: ``pair, interval, open_time``. Result: these, ``query_time``, ``substituted``, and a row per match with
    ``rank``, ``match_time``, ``similarity``, ``regime``.
    """
    resolved = with_anchor(requested, vectors, vectors)
    key = [*SERIES, "query_time"]
    index = vectors.withColumnRenamed(TS, "query_time")
    queries = resolved.select(*key).distinct().join(index, key).withColumnRenamed("query_time", TS)
    found = similar_bars(queries, vectors, k, **filters).withColumnRenamed(TS, "match_time")
    return resolved.join(found, key).select(*SERIES, TS, "query_time", "substituted", "rank", "match_time", "similarity", "regime")


def attach_windows(matches: DataFrame, bars: DataFrame, window: int = 64, block: int = 8192) -> DataFrame:
    """Add each match's last ``window`` OHLC bars and the outcome of the next one; too-early matches drop."""
    keep = [*SERIES, TS, "open", "high", "low", "close"]
    positioned = with_position(bars.select(*keep), rows=block, total=None)
    ahead = over_rows(positioned, lambda f: {"next_close": f.lead("close")}, after=1, block=block)
    windows = collect_windows(ahead, ("open", "high", "low", "close"), window, block=block)
    outcome = F.when(F.col("next_close").isNotNull(), (F.col("next_close") > F.col("close")).cast("int"))
    right = windows.select(*SERIES, TS, "window", "next_close", outcome.alias("next_direction"))
    return matches.join(right, [*SERIES, TS])


# --------------------------------------------------------------------------- evaluation
def sample_bars(df: DataFrame, n: int, seed: int = 0, key: Sequence[str] = (*SERIES, TS)) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key, in time order: repeatable on any layout and engine."""
    return df.orderBy(key_hash(df, key, seed), *key).limit(n).orderBy(*key)


def retrieval_votes(
    vectors: DataFrame, labels: DataFrame, k: int = 10, test_frac: float = 0.2, max_test: int | None = None, seed: int = 0
) -> DataFrame:
    """Majority vote of each held-out bar's nearest earlier bars, with and without the regime filter.

    ``labels`` holds ``pair, interval, open_time, next_dir``. Test bars are the last ``test_frac`` of
    the bars having vector and label, or ``max_test`` sampled ones if that is given. A query with fewer than
    ``max(3, k // 2)`` matches has no vote; a tied vote counts as down.
    """
    key = [*SERIES, TS]
    usable = vectors.join(labels.select(*key, "next_dir"), key)
    positioned = with_position(usable, pos="_p", total="_n")
    tests = positioned.filter(F.col("_p") >= F.col("_n") - F.floor(F.col("_n") * F.lit(float(test_frac)))).drop("_p", "_n")
    if max_test is not None:
        tests = sample_bars(tests, max_test, seed)
    truth = tests.select(*SERIES, F.col(TS).alias("query_time"), F.col("next_dir").alias("true_dir"))
    modes = None
    for flag in (False, True):
        found = similar_bars(tests, vectors, k, same_regime=flag, history_only=True)
        part = found.select(*key, "query_time", F.lit(flag).alias("regime_filter"))
        modes = part if modes is None else modes.unionByName(part)
    voted = modes.join(labels.select(*key, "next_dir"), key, "left").groupBy(*SERIES, "query_time", "regime_filter").agg(
        F.count(F.lit(1)).alias("n_matches"), F.bround(F.avg("next_dir")).cast("int").alias("majority")
    )
    every = truth.withColumn("regime_filter", F.explode(F.array(F.lit(False), F.lit(True))))
    out = every.join(voted, [*SERIES, "query_time", "regime_filter"], "left")
    n = F.coalesce("n_matches", F.lit(0))
    majority = F.when(n >= max(3, k // 2), F.col("majority"))
    return out.select(
        *SERIES, "query_time", "regime_filter", "true_dir", n.alias("n_matches"), majority.alias("majority"),
        (majority == F.col("true_dir")).cast("int").alias("hit"),
    )


def hit_rates(votes: DataFrame) -> DataFrame:
    """Hit rate, voted queries and mean matches per filter mode."""
    return votes.filter(F.col("hit").isNotNull()).groupBy("regime_filter").agg(
        F.avg("hit").alias("hit_rate"), F.count(F.lit(1)).alias("n_queries"), F.avg("n_matches").alias("avg_n_matches")
    )


def evaluate_retrieval(
    vectors: DataFrame, labels: DataFrame, k: int = 10, test_frac: float = 0.2, max_test: int | None = None, seed: int = 0
) -> DataFrame:
    """Hit rates of history-only retrieval, with and without the regime filter."""
    return hit_rates(retrieval_votes(vectors, labels, k, test_frac, max_test, seed))

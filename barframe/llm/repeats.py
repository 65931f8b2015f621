"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.shingles import _BASE, _BASE_INVERSE, U, mix

ANCHOR = 64  # bytes of an anchor
FILTER_BITS = 27  # of the bounded filter of repeated anchors
HOT = 50_000  # anchors at more places are divided further
CHUNK = 1 << 21  # bytes sorted together
SLICE = 1 << 20
SURE = 0  # in place of a context's count: a span already known to be repeated
RUN = pa.schema([
    ("fp", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("size", pa.int64()),
    ("n", pa.int64()), ("bytes", pa.binary()),
])
RUN_SQL = "fp long, ctx long, doc_id long, row long, start long, size long, n long, bytes binary"
SPAN = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


class _Hashes:
    """Polynomial hashes of any substring of a slice, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_POWERS[0]) < n:
            for k, base in enumerate((_BASE, _BASE_INVERSE)):
                steps = np.full(max(n, SLICE + (1 << 16)), base, U)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
        self.inverse = _POWERS[1]
        self.sums = np.zeros(n, U)
        np.cumsum((data.astype(U) + U(1)) * _POWERS[0][: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))

    def grams(self, size: int) -> np.ndarray:
        """Hash of every substring of ``size`` bytes."""
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size] + U(size))


_POWERS = [np.ones(1, U), np.ones(1, U)]


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """For every run of ``window`` grams the place of its smallest hash, the leftmost of equals."""
    bits = max(1, int(len(grams)).bit_length())
    packed = (grams >> U(bits)) << U(bits) | np.arange(len(grams), dtype=U)
    span, least = 1, packed
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        shift = window - span
        least = np.minimum(least[:-shift], least[shift:])
    return (least & U((1 << bits) - 1)).astype(np.int64)


def _slices(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(from, to, numbers of texts, their ends, start of the first in its text) of slices holding every string of ``length`` bytes."""
    text, n = 0, len(bounds) - 1
    while text < n:
        upto = max(int(np.searchsorted(bounds, bounds[text] + SLICE, side="right")) - 1, text + 1)
        lo, hi = int(bounds[text]), int(bounds[upto])
        if upto == text + 1 and hi - lo > SLICE:
            for at in range(lo, hi - length + 1, SLICE):
                end = min(at + SLICE + length - 1, hi)
                yield at, end, np.array([text]), np.array([end]), at - lo
        else:
            yield lo, hi, np.arange(text, upto), bounds[text + 1 : upto + 1], 0
        text = upto


def _runs(texts: pa.Array, length: int):
    """Per slice: its bytes, hashes, and runs of window starts that share an anchor: (text, first, last, anchor, base, doc start)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for lo, hi, numbers, ends, base in _slices(bounds, length):
        part = data[lo:hi]
        if len(part) < length:
            continue
        hashes = _Hashes(part)
        grams = hashes.grams(ANCHOR)
        places = anchors(grams, length - ANCHOR + 1)
        starts = bounds[numbers] - lo if len(numbers) > 1 or base == 0 else np.array([0])
        owner = np.repeat(np.arange(len(numbers)), np.diff(np.append(starts, hi - lo)))[: len(places)]
        valid = np.arange(len(places)) + length <= (ends - lo)[owner]
        where = np.flatnonzero(valid)
        if not len(where):
            continue
        key = places[where]
        new = np.ones(len(where), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[where][1:] != owner[where][:-1])
        first = where[new]
        last = np.append(where[np.flatnonzero(new)[1:] - 1], where[-1])
        yield part, hashes, grams, numbers[owner[first]], first, last, key[new], base - starts[owner[first]]


def _count(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(grams[place], hashes.of(first, last + length)) for _, hashes, grams, _, first, last, place, _ in _runs(b.column(0), length)]
            if found:
                fp, ctx = (np.concatenate(x) for x in zip(*found))
                _, at, n = np.unique(ctx, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(ctx[at].view(np.int64)), pa.array(n)], ["fp", "ctx", "n"])

    return run


def _bits(key: tuple, group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << 15, dtype=np.uint8)
    bits[group.column("bit").to_numpy()] = 1
    return pa.table({"map": [key[0].as_py()], "block": [key[1].as_py()], "bits": [np.packbits(bits).tobytes()]}, pa.schema([("map", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())]))


def anchor_filter(texts: DataFrame, length: int) -> list[np.ndarray]:
    """Bit maps of the contexts that occur twice, the anchors with several contexts, and those with ``HOT`` of them or more.

    They hold leading bits of the hashes, and their size is fixed. They only spare the shuffle what occurs once: what
    passes wrongly meets no partner later.
    """
    counts = texts.select("text").mapInArrow(_count(length), "fp long, ctx long, n long").repartition(F.col("fp"))
    contexts = counts.groupBy("fp", "ctx").agg(F.sum("n").alias("n"))
    contexts = contexts.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("fp")))
    marked = [
        F.when(test, F.struct(F.lit(k).alias("map"), F.col(name).alias("hash")))
        for k, (test, name) in enumerate([(F.col("n") > 1, "ctx"), (F.col("c") > 1, "fp"), (F.col("c") >= HOT, "fp")])
    ]
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = contexts.select(F.explode(F.array_compact(F.array(*marked))).alias("m")).select("m.*").select(
        "map", F.shiftright(place, 15).cast("int").alias("block"), place.bitwiseAND(32767).cast("int").alias("bit")
    )
    maps = np.zeros((3, 1 << FILTER_BITS - 15, 4096), dtype=np.uint8)
    for r in bits.distinct().groupBy("map", "block").applyInArrow(_bits, "map int, block int, bits binary").collect():
        maps[r.map, r.block] = np.frombuffer(r.bits, np.uint8)
    return [m.ravel() for m in maps]


def _test(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    place = fp >> U(64 - FILTER_BITS)
    return (bitmap[(place >> U(3)).astype(np.int64)] >> (U(7) - (place & U(7))).astype(np.uint8)) & 1 == 1


def _divided(hashes: _Hashes, fp, first, last, place, length: int):
    """Hot runs in two: windows reaching further to the right of the anchor take the bytes there into their key, the others those to its left."""
    side = (length - ANCHOR) // 2
    border = np.clip(place - side, first, last + 1)  # first start on the right-hand side
    out = []
    for right in (True, False):
        lo, hi = (border, last) if right else (first, border - 1)
        some = np.flatnonzero(hi >= lo)
        p = place[some]
        other = hashes.of(p + ANCHOR, p + ANCHOR + side) if right else hashes.of(p - side, p)
        out.append((some, mix(fp[some] + other * U(3) + U(right)), lo[some], hi[some]))
    return [np.concatenate(x) for x in zip(*out)]


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of each owner as one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    new = np.ones(len(order), dtype=bool)  # starts and ends both ascend: contexts of a text never contain each other
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(order)) - 1
    return owner[at], start[at], end[last] if len(at) else end[:0]


def _contexts(length: int, filters, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, several, hot = filters.value
        for b in batches:
            docs, rows = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            held, blobs = [], []
            for part, hashes, grams, text, first, last, place, shift in _runs(b.column(2), length):
                fp, ctx = grams[place], hashes.of(first, last + length)
                keep = np.flatnonzero(_test(several, fp) | _test(again, ctx))
                text, first, last, place, shift, fp = (x[keep] for x in (text, first, last, place, shift, fp))
                crowded = _test(hot, fp)
                if crowded.any():
                    c = np.flatnonzero(crowded)
                    some, keys, lo, hi = _divided(hashes, fp[c], first[c], last[c], place[c], length)
                    rest, more = np.flatnonzero(~crowded), c[some]
                    mates = np.append(_test(several, fp[rest]), np.ones(len(more), dtype=bool))
                    first, last, fp = np.append(first[rest], lo), np.append(last[rest], hi), np.append(fp[rest], keys)
                    text, shift = np.append(text[rest], text[more]), np.append(shift[rest], shift[more])
                else:
                    mates = _test(several, fp)
                ends = last + length
                held.append((fp, hashes.of(first, ends), text, first + shift, ends - first))
                raw = part.tobytes()
                blobs += [raw[a:z] if m else None for a, z, m in zip(first.tolist(), ends.tolist(), mates.tolist())]
            if not held:
                continue
            fp, ctx, text, start, size = (np.concatenate(x) for x in zip(*held))
            # A context found again in this batch travels once; its places here are known to be repeated.
            order = np.lexsort((start, docs[text], ctx))
            head = np.ones(len(order), dtype=bool)
            head[1:] = ctx[order][1:] != ctx[order][:-1]
            counts = np.diff(np.append(np.flatnonzero(head), len(order)))
            n = np.zeros(len(order), np.int64)
            n[order[head]] = counts
            sure = np.flatnonzero(n == 0 if keep_first else n != 1)
            owner, lo, hi = _merged(text[sure], start[sure], start[sure] + size[sure])
            heads = np.flatnonzero(n)
            none = np.zeros(len(owner), np.int64)
            spread = mix(rows[owner].view(U) + lo.astype(U)).view(np.int64)
            columns = [
                np.append(fp[heads].view(np.int64), spread), np.append(ctx[heads].view(np.int64), none), np.append(docs[text[heads]], docs[owner]),
                np.append(rows[text[heads]], rows[owner]), np.append(start[heads], lo), np.append(size[heads], hi - lo), np.append(n[heads], none + SURE),
            ]
            blob = [blobs[k] for k in heads.tolist()] + [None] * len(owner)
            for at in range(0, len(columns[0]), 1 << 15):
                s = slice(at, at + (1 << 15))
                arrays = [pa.array(c[s]) for c in columns]
                arrays[2] = pa.array(columns[2][s], pa.int64(), from_pandas=True) if keep_first else pa.nulls(len(arrays[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(blob[s], pa.binary())], schema=RUN)

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes cut after ``length`` bytes, in byte order: prefix doubling from 8 bytes, equals share a rank."""
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    n, key = len(data), np.zeros(len(data), U)
    for j in range(min(8, length)):
        key = key << U(8) | padded[j : j + n].astype(U)
    rank, have = np.unique(key, return_inverse=True)[1].astype(np.int64), min(8, length)
    while have < length:
        step = min(have, length - have)
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def repeated_starts(contexts: list[bytes], length: int, place: np.ndarray | None = None, keep_first: bool = False) -> np.ndarray:
    """Which window starts of the concatenated contexts have an equal window elsewhere: entry i for the i-th byte.

    Suffixes cut at ``length`` are put in order, equal ones by their ``place`` in the corpus. The previous smaller place
    within the equal ones is then the neighbour before: where there is one, the longest previous factor reaches
    ``length``. The neighbour after gives the later match; with ``keep_first`` it doesn't count.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array(list(map(len, contexts)))
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begin, sizes)])
    rank = suffix_ranks(data, length)[starts]
    order = np.lexsort((starts if place is None else place[starts], rank))
    same = rank[order][1:] == rank[order][:-1]
    found = np.zeros(len(data), dtype=bool)
    found[starts[order[1:][same]]] = True
    if not keep_first:
        found[starts[order[:-1][same]]] = True
    return found


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows at the sorted ``starts``, merged."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] - starts[:-1] > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _search(length: int, keep_first: bool):
    def spans(t: pa.Table) -> list[tuple[int, int, int]]:
        fp, ctx, start, size, n, row = (t.column(c).to_numpy() for c in ("fp", "ctx", "start", "size", "n", "row"))
        known = n == SURE
        out = list(zip(row[known].tolist(), start[known].tolist(), (start + size)[known].tolist()))
        t = t.filter(pa.array(~known))
        if not len(t):
            return out
        fp, ctx, start, size, n, row = (x[~known] for x in (fp, ctx, start, size, n, row))
        new = np.ones(len(t), dtype=bool)  # sorted by fp, ctx, doc_id, row, start
        new[1:] = (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        total = np.add.reduceat(n, heads)
        repeated = total[group] > 1
        if keep_first:
            repeated &= ~new
        out += list(zip(row[repeated].tolist(), start[repeated].tolist(), (start + size)[repeated].tolist()))
        # Strings that share an anchor without being equal: suffix order finds what they have in common.
        mates = np.zeros(len(heads), dtype=bool)
        equal = fp[heads][1:] == fp[heads][:-1]
        mates[1:] |= equal
        mates[:-1] |= equal
        chosen = np.flatnonzero(mates)
        if len(chosen):
            contexts = t.column("bytes").take(pa.array(heads[chosen])).to_pylist()
            sizes = np.array(list(map(len, contexts)))
            begin = np.cumsum(sizes) - sizes
            owner = heads[chosen]
            place = np.repeat(np.argsort(np.lexsort((start[owner], row[owner], t.column("doc_id").take(pa.array(owner)).to_numpy(zero_copy_only=False)))), sizes)
            found = repeated_starts(contexts, length, place if keep_first else None, keep_first)
            open_ = ~repeated[owner]
            for k in np.flatnonzero(open_).tolist():
                hits = np.flatnonzero(found[begin[k] : begin[k] + sizes[k]])
                o = owner[k]
                out += [(int(row[o]), int(start[o]) + a, int(start[o]) + z) for a, z in _ranges(hits, length)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, last = [], 0, None

        def emit():
            rows = spans(pa.Table.from_batches(held).combine_chunks())
            columns = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SPAN)

        for b in batches:
            fps = b.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(fps[1:] != fps[:-1]) + 1, b.num_rows)
            sums = np.cumsum(b.column(5).to_numpy())
            at = 0
            if held and b.num_rows and fps[0] != last and weight > CHUNK:
                yield emit()
                held, weight = [], 0
            for cut in cuts.tolist():
                if cut > at and weight + int(sums[cut - 1] - (sums[at - 1] if at else 0)) > CHUNK and cut < b.num_rows:
                    held.append(b.slice(at, cut - at))
                    yield emit()
                    held, weight, at = [], 0, cut
            if at < b.num_rows:
                held.append(b.slice(at))
                weight += int(sums[-1] - (sums[at - 1] if at else 0))
                last = fps[-1]
        if held:
            yield emit()

    return run


def repeated_spans(rows: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """``row, start, end``: bytes of ``rows`` (``doc_id, row, text``) covered by repeated strings of ``length`` bytes; spans may overlap.

    Every string of ``length`` bytes has an anchor, the smallest of its hashed ``ANCHOR``-byte substrings, so equal strings
    meet under one anchor. Successive strings with one anchor travel together as one context: as a hash, if the context
    occurs twice, and with its bytes, if its anchor has other contexts too. Equal contexts are one, first within a batch,
    then in the task that gathers an anchor; different contexts of an anchor are searched by suffix order. Anchors with
    very many contexts are divided by the bytes beside them.
    """
    spark = rows.sparkSession
    filters = spark.sparkContext.broadcast(anchor_filter(rows, length))  # fixed size: 3 * 2^FILTER_BITS bits
    found = rows.select("doc_id", "row", "text").mapInArrow(_contexts(length, filters, keep_first), RUN_SQL)
    dealt = found.repartition(F.col("fp")).sortWithinPartitions("fp", "ctx", "doc_id", "row", "start")
    return dealt.mapInArrow(_search(length, keep_first), "row long, start long, end long")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.slice(lo, 512).columns)):
                data, kept, at, removed, n = (text or "").encode(), [], 0, 0, 0
                reach = -1
                for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                    if s > reach:
                        kept.append(data[at:s])
                        n += 1
                        reach = at = s
                    if e > reach:
                        removed += e - max(s, reach)
                        reach = at = e
                kept.append(data[at:])
                out.append((doc, len(data), removed, n, b"".join(kept)))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def without_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of each row.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it also starts at another
    place of any row, its own included; with ``keep_first`` only if at an earlier place (by id, row hash and start), so one
    copy stays. Removing may cut a character. Repeated rows are copies of each other. Nothing is removed from texts
    shorter than ``length``; other columns are not read.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = repeated_spans(rows, length, keep_first)
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(by_row, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

"""Packing of tokenised documents into sequences by hierarchical best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.bpe import load
from barframe.session import materialise

MEMBER = pa.struct([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("offset", pa.int64()),
])
BIN = pa.schema([("done", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(MEMBER))])
BIN_SQL = (
    "done boolean, sequence_id long, fill int, members array<struct<doc_id: long, piece: int, start: long, length: long, "
    "ids_crc32: long, offset: long>>"
)
CHUNK = 1 << 16  # items packed together in a task


def best_fit(fills: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that holds it. Bins as lists of item positions."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    open_spaces = 0  # bit s is set while some bin has exactly s tokens left
    for k in np.argsort(-fills, kind="stable").tolist():
        need = int(fills[k])
        fitting = open_spaces >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            target = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
            bins[target].append(k)
        else:
            space, target = capacity, len(bins)
            bins.append([k])
        left = space - need
        by_space[left].append(target)
        open_spaces |= 1 << left
    return bins


class _Packer:
    """Packs the items of a task chunk by chunk and yields Arrow batches of bins."""

    def __init__(self, level: int, capacity: int, slack: int):
        self.capacity, self.slack = capacity, slack
        self.number = level << 56 | TaskContext.get().partitionId() << 32
        self.items: list[tuple[int, list[dict]]] = []
        self.full: list[tuple[int, list[dict]]] = []

    def add(self, fill: int, members: list[dict]) -> Iterator[pa.RecordBatch]:
        (self.full if fill >= self.capacity - self.slack else self.items).append((fill, members))
        if len(self.items) + len(self.full) >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        packed = list(self.full)
        fills = np.array([f for f, _ in self.items], dtype=np.int64)
        for positions in best_fit(fills, self.capacity):
            members, at = [], 0
            for k in positions:
                fill, inner = self.items[k]
                members += [m | {"offset": m["offset"] + at} for m in inner]
                at += fill
            packed.append((at, members))
        self.items, self.full = [], []
        for lo in range(0, len(packed), 4096):
            part = packed[lo : lo + 4096]
            rows = [
                {"done": f >= self.capacity - self.slack, "sequence_id": self.number + k, "fill": f, "members": m}
                for k, (f, m) in enumerate(part)
            ]
            self.number += len(part)
            yield pa.RecordBatch.from_pylist(rows, BIN)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first holding the remainder."""
    first = length % capacity
    bounds = [0, *range(first or capacity, length + 1, capacity)] if length else []
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _tokenise_and_pack(vocab: str, end_id: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = load(vocab), _Packer(0, capacity, slack)
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    member = {"doc_id": doc.as_py(), "piece": k, "start": start, "length": length, "ids_crc32": crc, "offset": 0}
                    yield from packer.add(length, [member])
        yield from packer.flush()

    return run


def _repack(level: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(level, capacity, slack)
        for b in batches:
            for row in b.to_pylist():
                yield from packer.add(row["fill"], row["members"])
        yield from packer.flush()

    return run


def pack(docs: DataFrame, vocab: str, capacity: int = 1024, end_id: int = 2, slack: int = 2) -> DataFrame:
    """Pieces of all documents placed into sequences of at most ``capacity`` tokens.

    A document is its ids plus ``end_id``; only longer ones are cut, the first piece taking the remainder. Each task
    packs its own pieces by best fit, bins with at most ``slack`` free tokens are final, and the others become the items
    of the next round, where fewer tasks (half a chunk of items each) pack them again. The last round has one task, or is
    the first that leaves over nine tenths of its items, so bins that cannot be combined never gather in one task. Every round is a stored table of bins
    (at most ``capacity`` pieces each), so lost executors only repeat their tasks.

    A null or empty text is the end id alone; repeated rows are packed once each; other columns are not read.
    """
    cols = docs.select("doc_id", "text")
    level, bins = 0, materialise(cols.mapInArrow(_tokenise_and_pack(vocab, end_id, capacity, slack), BIN_SQL), "pack-0")
    results, tasks, before = [bins.filter("done")], 0, 0
    while True:
        rest = bins.filter("NOT done")
        left = rest.count()
        if left == 0 or tasks == 1 or (tasks and left > 0.9 * before):
            results.append(rest)
            break
        level, before = level + 1, left
        fewer = -(-left // (CHUNK // 2))
        tasks = fewer
        dealt = rest.repartition(tasks, F.xxhash64("sequence_id", F.lit(level)))
        bins = materialise(dealt.mapInArrow(_repack(level, capacity, slack), BIN_SQL), f"pack-{level}")
        results.append(bins.filter("done"))
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset"
    )

"""Removal of repeated word windows: windows repeated at one length are extended to twice that length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.repeats import anchors
from barframe.llm.shingles import _STEP, U, hashed_words, mix
from barframe.session import materialise, settings

SHORTEST = 6  # a first length is never shorter
LAST = (1 << 63) - 1  # stands for a null id, which counts as the last
HASHED = "64m"  # largest part of a join's smaller side that a task holds as a hash table
GROUPED = 1 << 19  # words hashed together before equal windows of them are counted
COUNTS = pa.schema([("h", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
RUNS = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
WINDOWS = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])
LEFT_SQL = "doc_id long, n_words long, n_removed long, kept string"
LEFT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def lengths(length: int) -> list[int]:
    """Window lengths up to ``length``, each at most twice the one before; the first is the shortest of at least SHORTEST."""
    found = [length]
    while (found[0] + 1) // 2 >= SHORTEST:
        found.insert(0, (found[0] + 1) // 2)
    return found


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, put together from runs of half the size: two of them overlap where it is odd."""
    if len(words) < size:
        return words[:0]
    have, found = 1, mix(words)
    while have < size:
        step = min(have, size - have)
        found = mix(found[:-step] * _STEP + found[step:] + U(have + step))
        have += step
    return found


def _least_of(texts: pa.Array, size: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: (its number, hash, first window, number of windows) of each run of ``length``-word windows whose smallest
    hashed window of ``size`` words is the same one. Equal windows have equal smallest ones."""
    for number, words in hashed_words(texts, lower=False):
        if len(words) < length:
            continue
        short = window_hashes(words, size)
        places = anchors(short, length - size + 1)
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        yield number, short[places[first]], first, np.diff(np.append(first, len(places)))


def _counts(hashes: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
    """Least and largest document of each distinct hash."""
    h, d = np.concatenate(hashes).view(np.int64), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    lo = np.minimum.reduceat(d, at) if len(h) else d
    hi = np.maximum.reduceat(d, at) if len(h) else d
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at], lo, hi)], schema=COUNTS)


def _seeds(size: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, held = [], [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for number, h, _, n in _least_of(b.column(1), size, length):
                hashes.append(h)
                docs.append(np.full(len(h), ids[number]))
                held += int(n.sum())
                if held > GROUPED:
                    yield _counts(hashes, docs)
                    hashes, docs, held = [], [], 0
        if hashes:
            yield _counts(hashes, docs)

    return run


def _runs(size: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, held = b.column(0).to_numpy(), [], 0
            for number, h, first, n in _least_of(b.column(1), size, length):
                parts.append((h.view(np.int64), np.full(len(h), rows[number]), first.astype(np.int32), n.astype(np.int32)))
                held += len(h)
                if held > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=RUNS)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=RUNS)

    return run


def _windows(length: int):
    """Hashes of the ``length``-word windows in each text's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, docs, runs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            parts, held = [], 0
            for number, words in hashed_words(b.column(2), lower=False):
                own = runs[number].values
                first, n = (own.field(c).to_numpy() for c in ("first", "n"))
                starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                h = window_hashes(words, length)[starts]
                parts.append((h.view(np.int64), np.full(len(h), rows[number]), np.full(len(h), docs[number]), starts.astype(np.int32)))
                held += len(h)
                if held > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=WINDOWS)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=WINDOWS)

    return run


def _repeated(counts: DataFrame) -> DataFrame:
    """``h, lo``: hashes of windows found in two documents, with the first of these. The tasks have counted equal ones
    together, so that no second combination precedes the shuffle: of a hash every task sends a row per GROUPED words."""
    least = counts.repartition(F.col("h")).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return least.filter("lo < hi").select("h", "lo")


def _again(windows: DataFrame) -> DataFrame:
    """The windows that other documents hold too, with the first of all these documents."""
    counts = windows.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
    return windows.join(materialise(counts.select("h", "lo"), "repeated"), "h")


def _extended(windows: DataFrame, size: int, longer: int) -> DataFrame:
    """Windows of ``longer`` words whose two windows of ``size`` words, at their start and their end, are both among the given."""
    tails = windows.select("row", (F.col("start") - (longer - size)).alias("start"), F.col("h").alias("t")).distinct()
    return windows.drop("lo").join(tails, ["row", "start"]).select(F.xxhash64("h", "t").alias("h"), "row", "doc", "start")


def repeated_windows(rows: DataFrame, length: int = 13, longest: bool = False) -> DataFrame:
    """``row, doc, start, size, lo``: windows of ``rows`` (``row, doc, text``) whose words also stand in another document.

    ``lo`` is the first document that holds them. Levels of doubled length lead to ``length`` words (7 and 13). A window of
    the second is a candidate if the smallest hashed window of the first in it is found in two documents, so that about
    a quarter of the first are counted. At each further level a window is a candidate only if
    the two shorter ones that make it up are repeated; it stays if it is found in two documents itself. With ``longest``
    windows go on to twice the length until no candidates survive, and those of all levels from ``length`` are returned.

    Counts combine in the tasks before they are shuffled, candidates meet the counts by a join, whose large keys Spark
    splits. Windows are compared by 64-bit hashes. A row stands for a document's text, rows of one ``doc`` are one document.
    """
    spark = rows.sparkSession
    levels = lengths(length)
    size = levels[:2][-1]
    counts = rows.select("doc", "text").mapInArrow(_seeds(levels[0], size), "h long, lo long, hi long")
    seeds = materialise(_repeated(counts).select("h"), "seeds")
    runs = rows.select("row", "text").mapInArrow(_runs(levels[0], size), "h long, row long, first int, n int")
    held = runs.join(seeds, "h").groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    texts = rows.select("row", "doc", "text").join(held, "row")
    with settings(spark, adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):  # spares sorting the runs where seeds are few
        windows = materialise(texts.mapInArrow(_windows(size), "h long, row long, doc long, start int"), "windows")
    windows = _again(windows)
    for longer in levels[2:]:
        windows = _again(materialise(_extended(materialise(windows, "survivors"), size, longer), "windows"))
        size = longer
    found = windows.withColumn("size", F.lit(size))
    while longest:
        windows = materialise(windows, "survivors")
        found = windows.withColumn("size", F.lit(size)) if size == length else found.unionByName(windows.withColumn("size", F.lit(size)))
        longer = materialise(_extended(windows, size, 2 * size), "windows")
        if not longer.limit(1).count():
            break
        windows, size = _again(longer), 2 * size
    return found.select("row", "doc", "start", "size", "lo")


def _leave(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            texts = b.column(1).cast(pa.binary())
            for doc, text, starts in zip(b.column(0).to_pylist(), texts, b.column(2)):
                words = (text.as_py() or b"").split()  # bytes are split at ASCII white space, as the words are
                drop = np.zeros(len(words) + 1, np.int64)
                if starts.is_valid:
                    at = np.unique(starts.values.to_numpy())
                    drop[at] += 1
                    drop[at + length] -= 1
                gone = np.cumsum(drop[:-1]) > 0
                kept = words if not gone.any() else [words[k] for k in np.flatnonzero(~gone).tolist()]
                out.append((doc, len(words), int(gone.sum()), b" ".join(kept).decode()))
                size += len(out[-1][3])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LEFT)], schema=LEFT)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LEFT)], schema=LEFT)

    return run


def without_repeated_windows(docs: DataFrame, length: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row: its words without those covered by a repeated window.

    Words are runs of anything but ASCII white space, unchanged; null is a text without words. A word goes if a window of
    ``length`` words that covers it also starts in a document with a smaller id; windows are judged on the input. ``kept``
    joins the rest by one space. The first document of a passage keeps it whole, also where it holds it twice. A null id is
    larger than all others; rows with one id are one document. Other columns aren't read.
    """
    doc = F.coalesce("doc_id", F.lit(LAST))
    rows = docs.select("doc_id", doc.alias("doc"), "text", F.xxhash64("doc_id", "text").alias("row"))
    found = repeated_windows(rows.select("row", "doc", "text"), length)
    starts = found.filter("lo < doc").groupBy("row").agg(F.collect_set("start").alias("starts"))
    with settings(docs.sparkSession, adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):
        starts = materialise(starts, "starts")
    joined = rows.join(starts, "row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_leave(length), LEFT_SQL)

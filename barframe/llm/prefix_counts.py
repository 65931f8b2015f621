"""Token counts of every prefix of a text by dynamic programming over a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.bpe import LONG_CONTRACTIONS, Splitter, load

BLOCK = 1 << 16
SHORT = 48  # bytes; longer pieces are rare, so their prefixes are not remembered
REMEMBER = 500_000  # entries; a full memory is emptied, which costs time only
_TWO_SPACES = regex.compile(r"\s\s")
_SPACE = regex.compile(r"\s")


class PrefixCounter:
    """Exact token counts for all prefixes of a text.

    Within a piece, a token sequence is the BPE encoding if and only if every two neighbours encode to themselves.
    So the last token of a prefix is the one suffix token that may follow the last token of what precedes it, and
    ``count[i] = count[i - length of that token] + 1``.
    """

    def __init__(self, path: str):
        self.bpe, self.splitter = load(path), Splitter(path)
        self.names = {i: t for t, i in self.bpe.ranks.items()}
        self.longest = max(map(len, self.bpe.ranks))
        self.follows: dict[int, bool] = {}
        self.insides: dict[int, tuple[tuple[int, int], ...]] = {}
        self.states: dict[bytes, tuple[int, int]] = {}
        self.known: dict[str, tuple[np.ndarray, int, int]] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.follows.get(key)
        if found is None:
            found = self.follows[key] = self.bpe.piece(self.names[a] + self.names[b]) == [a, b]
        return found

    def _short(self, data: bytes) -> tuple[int, int]:
        """(last token, count) of ``data`` as a prefix of a short piece."""
        state = self.states.get(data)
        if state is not None:
            return state
        get = self.bpe.ranks.get
        for cut in range(len(data)):
            token = get(data[cut:])
            if token is None:
                continue
            if cut == 0:
                state = (token, 1)
                break
            last, count = self._short(data[:cut])
            if self._may_follow(last, token):
                state = (token, count + 1)
                break
        self.states[data] = state
        return state

    def _inside(self, token: int) -> tuple[tuple[int, int], ...]:
        """(first token, count) of each proper prefix of a token."""
        found = self.insides.get(token)
        if found is None:
            name = self.names[token]
            parts = (self.bpe.piece(name[:k]) for k in range(1, len(name)))
            found = self.insides[token] = tuple((p[0], len(p)) for p in parts)
        return found

    def _byte_counts(self, data: bytes) -> list[int]:
        """A prefix that ends inside token j is tokens[:j] and that token's prefix wherever the two may follow each
        other; only elsewhere does the recurrence look for the last token."""
        out, last, follows, insides = [], None, self.follows, self.insides
        for j, token in enumerate(self.bpe.piece(data)):
            inside = insides.get(token)
            if inside is None:
                inside = self._inside(token)
            if last is None:
                out += [count for _, count in inside]
            else:
                for first, count in inside:
                    fits = follows.get(last << 20 | first)
                    if fits is None:
                        fits = self._may_follow(last, first)
                    out.append(j + count if fits else 0)
            out.append(j + 1)
            last = token
        if 0 in out:
            if len(data) > SHORT:
                return self._long(data)
            out = [n or self._short(data[: k + 1])[1] for k, n in enumerate(out)]
        return out

    def _long(self, data: bytes) -> list[int]:
        lasts, counts, get = [-1], [0], self.bpe.ranks.get
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = get(data[start:end])
                if token is not None and (start == 0 or self._may_follow(lasts[start], token)):
                    lasts.append(token)
                    counts.append(counts[start] + 1)
                    break
        return counts[1:]

    def _piece_counts(self, piece: str) -> np.ndarray:
        data = piece.encode()
        counts = self._byte_counts(data)
        if len(data) == 3 and piece in LONG_CONTRACTIONS:  # cut short, it splits into the apostrophe and a letter
            counts[1] = 2
        if len(data) == len(piece):
            return np.array(counts, dtype=np.int32)
        ends = np.cumsum([len(c.encode()) for c in piece]) - 1
        return np.array(counts, dtype=np.int32)[ends]

    def _known(self, piece: str) -> tuple[np.ndarray, int, int]:
        if len(self.known) > REMEMBER or len(self.states) > REMEMBER:
            self.known.clear()
            self.states.clear()
            self.follows.clear()
        counts = self._piece_counts(piece)
        entry = (counts, len(piece), int(counts[-1]))
        if len(piece) <= SHORT:
            self.known[piece] = entry
        return entry

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts for every prefix of a text without special strings."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        pieces = self.splitter.pieces(text)
        get, make = self.known.get, self._known
        entries = [get(p) or make(p) for p in pieces]
        totals = np.fromiter((e[2] for e in entries), np.int32, len(entries))
        before = np.cumsum(totals, dtype=np.int32) - totals
        out = np.concatenate([e[0] for e in entries]) + np.repeat(before, [e[1] for e in entries])
        if _TWO_SPACES.search(text):
            # A prefix that ends in white space has the whole run as its last piece, also where the text goes on and
            # the run's last character then belongs to what follows.
            at = 0
            for k, piece in enumerate(pieces):
                if k and _SPACE.match(piece[0]) and _SPACE.match(pieces[k - 1][-1]):
                    run = pieces[k - 1] + (piece if _SPACE.match(piece[-1]) else piece[0])
                    skip = len(pieces[k - 1])
                    out[at : at + len(run) - skip] = before[k - 1] + self._piece_counts(run)[skip:]
                at += len(piece)
        return out

    def counts(self, text: str) -> np.ndarray:
        """int32 array: entry i is the token count of the first i + 1 code points."""
        special = next((s for s in self.bpe.special if s in text), None)
        if special is None:
            return self._ordinary(text)
        parts, base, out = text.split(special), 0, []
        for part in parts[:-1]:
            counts = self._ordinary(part + special[:-1])  # until the special string is complete it is ordinary text
            base_end = base + int(counts[len(part) - 1]) + 1 if part else base + 1
            out += [counts + base, np.array([base_end], dtype=np.int32)]
            base = base_end
        return np.concatenate([*out, self._ordinary(parts[-1]) + base]).astype(np.int32)


@lru_cache(1)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _rows(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        fields = ["doc_id", "block", "start", "n_bytes", "n_tokens", "counts"]

        def batch(rows, parts):
            offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], fields)

        rows, parts, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                text = text.as_py() or ""
                counts, n_bytes = counter.counts(text), len(text.encode())
                total = int(counts[-1]) if len(counts) else 0
                for k, start in enumerate(range(0, max(1, len(counts)), block)):
                    part = counts[start : start + block]
                    rows.append((doc.as_py(), k, start, n_bytes, total))
                    parts.append(part)
                    held += len(part)
                    if held > 1 << 20:
                        yield batch(rows, parts)
                        rows, parts, held = [], [], 0
        if rows:
            yield batch(rows, parts)

    return run


def prefix_counts(docs: DataFrame, vocab: str, block: int = BLOCK) -> DataFrame:
    """Token counts of every prefix, in blocks of at most ``block`` code points.

    Rows: ``doc_id``, ``block`` (from 0), ``start`` (code points before the block), ``n_bytes``
    and ``n_tokens`` (of the whole text) and ``counts`` (entry i: tokens of the first ``start + i + 1`` code points, as if the text ended there).
    A null or empty text gives block 0 with an empty array and 0 tokens; repeated rows give repeated results; other
    columns are not read. One pass over the texts, no shuffle.
    """
    schema = "doc_id long, block int, start long, n_bytes long, n_tokens long, counts array<int>"
    return docs.select("doc_id", "text").mapInArrow(_rows(vocab, block), schema)


def tokens_at(prefixes: DataFrame, n_chars: int) -> DataFrame:
    """Tokens of each document's first ``n_chars`` code points (all of them, if it is shorter); unique doc_id assumed."""
    if n_chars <= 0:
        return prefixes.filter("block = 0").select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    inside = F.element_at("counts", (F.lit(n_chars) - F.col("start")).cast("int"))
    last = F.col("start") + F.size("counts") >= n_chars
    return prefixes.groupBy("doc_id").agg(
        F.coalesce(F.max(F.when((F.col("start") < n_chars) & last, inside)), F.max("n_tokens")).cast("long").alias("n_tokens")
    )


def longest_prefix(prefixes: DataFrame, budget: int) -> DataFrame:
    """Code points of each document's longest prefix with at most ``budget`` tokens; unique doc_id assumed."""
    fits = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, F.col("start") + i + 1)))
    return prefixes.groupBy("doc_id").agg(F.coalesce(F.max(fits), F.lit(0)).cast("long").alias("n_chars"))

"""Word shingles as 64-bit hashes, computed for whole batches of texts with array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U(0xC2B2AE3D27D4EB4F)
SLICE = 1 << 20  # bytes hashed at a time
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers_upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n + 1, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text) for texts ``data[bounds[i]:bounds[i + 1]]`` of lower-cased bytes.

    A word's polynomial hash is a difference of prefix sums, scaled back by its start.
    """
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    power, inverse = _powers_upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[: len(data)], dtype=U)])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * _STEP)
    return hashes, np.diff(np.searchsorted(starts, bounds))


def _slices(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(bytes, bounds, text numbers, whether the texts end here) of slices of about SLICE bytes; a longer text is cut at white space."""
    text, n = 0, len(bounds) - 1
    while text < n:
        upto = max(int(np.searchsorted(bounds, bounds[text] + SLICE, side="right")) - 1, text + 1)
        if upto == text + 1 and bounds[upto] - bounds[text] > SLICE:
            at, end = int(bounds[text]), int(bounds[upto])
            while at < end:
                stop = end
                if end - at > SLICE:
                    gaps = np.flatnonzero(_SPACE[data[at + SLICE : end]])
                    stop = at + SLICE + int(gaps[0]) if len(gaps) else end
                yield data[at:stop], np.array([0, stop - at]), np.array([text]), stop == end
                at = stop
        else:
            yield data[bounds[text] : bounds[upto]], bounds[text : upto + 1] - bounds[text], np.arange(text, upto), True
        text = upto


def hashed_words(texts: pa.StringArray, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, hashes of its words in order), A-Z lower-cased unless told otherwise; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(texts) else np.zeros(0, np.uint8)
    data, bounds = _LOWER[data] if lower else data, bounds - bounds[0]
    held: list[np.ndarray] = []
    for part, inner, numbers, ended in _slices(data, bounds):
        hashes, counts = word_hashes(part, inner)
        if not ended or held:
            held.append(hashes)
            if ended:
                yield int(numbers[0]), np.concatenate(held)
                held = []
            continue
        at = np.concatenate([[0], np.cumsum(counts)])
        for k, number in enumerate(numbers.tolist()):
            yield number, hashes[at[k] : at[k + 1]]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words, if they are fewer; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    last = len(words) - size + 1
    found = mix(words[size - 1 : size - 1 + last] + U(size))
    for k in range(size - 2, -1, -1):
        found = mix(words[k : k + last] + found * _STEP)
    return np.unique(found)

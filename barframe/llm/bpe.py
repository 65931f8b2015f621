"""Byte-level BPE from a published vocabulary file, as used by packing and token counting."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The published split pattern of this family of vocabularies, and its contractions of three characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
# Ranges where every code point falls into the same class for all splitting libraries (tests check each).
AGREED = (
    "\u0000-\u0557\u0590-\u085f\u0900-\u0bff\u0d00-\u208e\u20a0-\ua7cd\uac00-\ud7a3\uf900-\ufaff\ufe00-\uffee"
    "\U0001f300-\U0001faff"
)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte value in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """Ids of the vocabulary file's own library, computed by rank merges; special strings inside a text become their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        self.ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("ids must follow the order of the merges")
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.path = path

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, without splitting it."""
        return self.encoding._core_bpe.encode_single_piece(data)


class Splitter:
    """Pieces of a text before merging: by the pattern, or by the vocabulary's library where a character is outside AGREED."""

    def __init__(self, path: str):
        self.path = path
        self.pattern = regex.compile(PATTERN)
        self.outside = regex.compile(f"[^{AGREED}]")

    def pieces(self, text: str) -> list[str]:
        if self.outside.search(text) is None:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)

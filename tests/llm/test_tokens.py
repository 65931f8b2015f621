"""Token counts and packing against the vocabulary's own library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barframe.llm import bpe, packing, prefix_counts

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a", "It's we're they've I'll 'r 're' ''re x'", "a \n\n  b\n\n\nc  ", "  lead and trail \t\n ", "x<|endoftext|>y",
    "<|endoftext|>", " <|endoftext|> <|endoftext|><|endof", "naïve Größe çéà ñ 你好 世界 \U0001f600\U0001f680", "ऀ՘࡟࢏ a　 b",
    "1234567.89 $$$ ### !!!", "z" * 300, "ab" * 40 + " " * 60 + "c", "\x00\x1c \x1d x", "don'ts can'd", "Ünder  space  x",
]


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def test_libraries_split_alike_in_the_agreed_ranges(library):
    splitter, coder = bpe.Splitter(VOCAB), bpe.load(VOCAB)
    for cp in range(0x20000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or splitter.outside.search(c):
            continue
        text = f"a{c}b1{c}1.{c}. {c} {c}{c}a"
        expected = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert splitter.pattern.findall(text) == expected, hex(cp)
        if cp % 7 == 0:
            assert coder.encode(text).tolist() == ids(library, text)


def test_every_prefix_count_is_exact(library):
    rng = random.Random(5)
    alphabet = ["a", "B", "e", "th", " ", " ", "\n", "'", "'ll", "'re", "1", ".", "é", "語", "\t", "<|endoftext|>", "ing", "　"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=60)) for _ in range(60)]
    counter = prefix_counts.PrefixCounter(VOCAB)
    for text in texts:
        expected = [len(ids(library, text[: k + 1])) for k in range(len(text))]
        assert counter.counts(text).tolist() == expected, repr(text)


def test_counts_in_blocks_and_budgets(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(100, "word " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string")
    found = prefix_counts.prefix_counts(docs, VOCAB, block=16)
    joined: dict = {}
    for r in found.orderBy("doc_id", "block").collect():
        joined.setdefault(r.doc_id, []).extend(r.counts)
        text = dict((a, b) for a, b, _ in rows)[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(ids(library, text)), len(text.encode()))
    for k, text, _ in rows:
        assert joined[k] == [len(ids(library, (text or "")[: i + 1])) for i in range(len(text or ""))]
    cut = {r.doc_id: r.n_tokens for r in prefix_counts.tokens_at(found, 7).collect()}
    fit = {r.doc_id: r.n_chars for r in prefix_counts.longest_prefix(found, 3).collect()}
    for k, text, _ in rows:
        text = text or ""
        assert cut[k] == len(ids(library, text[:7]))
        assert fit[k] == max([i for i in range(len(text) + 1) if len(ids(library, text[:i])) <= 3])
    assert prefix_counts.prefix_counts(docs.limit(0), VOCAB).count() == 0


def test_cut_and_best_fit():
    assert packing.cut(0, 8) == []
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]
    rng = np.random.default_rng(1)
    fills = rng.integers(1, 1024, 5000)
    bins = packing.best_fit(fills, 1024)
    assert sorted(k for b in bins for k in b) == list(range(5000))
    loads = [int(fills[b].sum()) for b in bins]
    assert max(loads) <= 1024 and len(bins) <= 1.01 * fills.sum() / 1024 + 1


@pytest.mark.parametrize("chunk", [packing.CHUNK, 40])
def test_packing_keeps_every_id_once(spark, library, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices(["alpha", "beta", "gamma", "in", "of"], k=rng.randrange(1, 90))) for _ in range(200)]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(5)
    rows = packing.pack(docs, VOCAB, capacity=64).collect()
    all_ids = {k: [*ids(library, t or ""), 2] for k, t in enumerate(texts)}
    places, starts = {}, {}
    for r in rows:
        part = all_ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        starts.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for k, parts in starts.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert [(s, n) for _, s, n in parts] == packing.cut(len(all_ids[k]), 64)
        assert all(n == 64 for _, _, n in parts[1:])
    assert len(starts) == len(texts)
    lower = -(-sum(map(len, all_ids.values())) // 64)
    assert len(places) <= 1.1 * lower


def test_packing_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert packing.pack(docs.filter(F.lit(False)), VOCAB).count() == 0
    rows = packing.pack(docs, VOCAB).collect()
    assert sorted((r.doc_id, r.offset) for r in rows) == [(1, 0), (1, 2)]

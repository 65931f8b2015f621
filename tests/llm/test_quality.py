"""Text statistics and robust verdicts against plain Python."""

import random

import numpy as np
import pytest

from barframe.llm import quality


def statistics(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def fitted(x, core=0.75, steps=4):
    """The estimates of one group by sorting: means and covariance of the rows kept in the last step."""
    floors = np.diag(np.square(quality.FLOORS))
    mean = np.array([np.sort(np.round(x[:, i] * 256))[(len(x) - 1) // 2] / 256 for i in range(quality.DIM)])
    cov = 4 * floors
    factor = core / quality._chi2_cdf(quality.chi2_quantile(core), quality.DIM + 2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.floor(quality.FINE * np.log2(1 + d))
        below = np.array([(bins < b).sum() for b in bins])
        kept = x[below < core * len(x)]
        mean = kept.mean(axis=0)
        cov = factor * (kept.T @ kept / len(kept) - np.outer(mean, mean)) + floors
    return mean, cov


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 9))) for _ in range(300)]
    rows = []
    for k in range(900):
        words = rng.choices(vocabulary, k=rng.randrange(45, 120))
        if k % 9 == 0:
            words = [w + rng.choice(["###", "%%%", "|"]) for w in words]
        if k % 11 == 0:
            words = words[:20] * 4
        text = "".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words)
        if k % 13 == 0:
            text += "\nsame line here\nsame line here\n"
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", None])))
    return [*rows, (900, None, "en", "hot"), (901, "", "fr", "x"), (901, "\n \n", "fr", "x"), (None, "a\xa0b c\x1cd", None, None)]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(*r, 3) for r in corpus()], "doc_id long, text string, lang string, source string, n_words int")
    return quality.quality(docs.repartition(5)).toPandas()


def test_statistics(found):
    key = lambda r: (r[0] is None or r[0] != r[0], r[0] or 0, r[1:])
    got = sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.itertuples()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    wanted = sorted(((d, *statistics(t)[:5]) for d, t, _, _ in corpus()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == wanted
    failed = {int(r.doc_id): r.base_failed for r in found.itertuples() if r.doc_id == r.doc_id}
    for d, t, _, _ in corpus()[:900]:
        n, _, _, _, repeats, _ = statistics(t)
        assert failed[d] == (n < 50 or 100 * repeats > 50 * n)


def test_verdicts_match_sorted_estimates(found):
    """Every group large enough alone is fitted as by a plain version; the others are pooled or judged with a larger one."""
    rows = {int(r.doc_id): r for r in found.itertuples() if r.doc_id == r.doc_id}
    groups = {}
    for d, t, lang, source in corpus()[:900]:
        if not rows[d].base_failed:
            n, chars, symbols, dup, repeats, lines = statistics(t)
            groups.setdefault((lang, source), []).append((d, [np.log(chars / n), np.log1p(100 * symbols / n), dup / max(lines, 1), repeats / n]))
    limit = np.sqrt(quality.chi2_quantile(1 - 1e-12))
    fits = {}
    for lang in {k[0] for k in groups}:
        small = [k for k in groups if k[0] == lang and len(groups[k]) < 60]
        large = [k for k in groups if k[0] == lang and len(groups[k]) >= 60]
        for k in large:
            fits[k] = list(groups[k])
        pool = [m for k in small for m in groups[k]]
        if len(pool) >= 60:
            fits[lang] = pool
        elif pool:
            fits[max(large, key=lambda k: len(groups[k]))] += pool
    assert len(fits) >= 4
    checked = 0
    for members in fits.values():
        ids, x = [d for d, _ in members], np.array([v for _, v in members])
        mean, cov = fitted(x)
        distance = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
        for d, wanted in zip(ids, distance):
            assert rows[d].distance == pytest.approx(wanted, rel=1e-6, abs=1e-6)
            assert rows[d].kept == (wanted <= limit)
            checked += 1
    assert checked > 400
    junk = [rows[k] for k in range(0, 900, 9)]
    clean = [rows[k] for k in range(900) if k % 9 and k % 11 and not rows[k].base_failed]
    assert not any(r.kept for r in junk) and all(r.kept for r in clean)


def test_good_documents_are_rows_themselves(spark):
    docs = spark.createDataFrame([(*r, 3) for r in corpus()], "doc_id long, text string, lang string, source string, kept int")
    verdict = quality.quality(docs).filter("kept").toPandas()
    good = quality.good_documents(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(verdict.doc_id.astype(int))
    assert quality.quality(docs.limit(0)).count() == 0
    few = quality.quality(docs.limit(20)).collect()
    assert all(r.distance is None and r.kept != r.base_failed for r in few)


def test_each_statistic_can_reject_alone(spark):
    """Texts of a source that repeats nothing, and one with each kind of excess, within the base rules."""
    rng = random.Random(4)

    def lines(n):
        return [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(12)) for _ in range(n)]

    rows = [(k, "\n".join(lines(10))) for k in range(150)]
    long = lines(10)
    rows.append((1000, "\n".join(x for line in long for x in (line, "a b", "a b"))))  # repeated lines
    rows.append((1001, "\n".join(long[:7] + [" ".join(long[0].split() + long[1].split()) + " z"])))  # repeated windows
    rows.append((1002, "\n".join(line.replace("a", "#") for line in long)))  # symbols
    rows.append((1003, "\n".join(line.replace("a", "aaaaaaaa") for line in long)))  # long words
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    for confidence in (quality.CONFIDENCE, 1 - 1e-12):
        kept = {r.doc_id: r.kept for r in quality.quality(docs, confidence=confidence).filter("NOT base_failed").collect()}
        assert len(kept) == 154 and not any(kept[k] for k in range(1000, 1004))
        assert sum(kept[k] for k in range(150)) >= 145
    found = quality.rejections(docs).first()
    assert found.n == 154 and found.rejected >= 4 / 154
    assert min(found.by_word_length, found.by_symbols, found.by_dup_lines, found.by_repeat_words) >= 1 / 154 - 1e-9

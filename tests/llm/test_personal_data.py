"""Personal data spans against the base patterns in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barframe.llm import personal_data as pd_

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng, valid=True, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    last = next(d for d in "0123456789" if luhn(digits + d))
    return digits + (last if valid else str((int(last) + 3) % 10))


def text_of(rng, k):
    parts = [rng.choice(["über", "word", "😀", "x_", "+", "@", ".", "1.2", "\n", "a@b", "%"]) for _ in range(rng.randrange(0, 12))]
    for _ in range(rng.randrange(0, 4)):
        parts.insert(rng.randrange(len(parts) + 1), rng.choice([
            f"user.{k}@mail{k % 7}.example.com", "a@b.com_foo@bar.com", f"10.{k % 300}.3.{rng.randrange(400)}", "1.2.3.4.5.6.7.8", "001.2.3.4",
            card(rng, k % 2 == 0), card(rng, True, 19)[:4] + " 1234-5678 9", f"+1 ({k % 900 + 100}) 555-{1000 + k % 9000}", "+49 12", "+1-2-3-4-5-6-7-8-9-10-11-12-13-14",
            f"call 0{k % 90 + 10} 555 {1000 + k % 9000}", f"user{k} [at] mail [dot] example [dot] com", "4" * 40,
        ]))
    return rng.choice([" ", " ", ""]).join(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [*((k, text_of(rng, k)) for k in range(900)), (900, None), (901, ""), (901, "x@y.z"), (None, "+12345678")]


def test_base_spans_and_counts(spark, rows):
    docs = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, kind string, start int").repartition(5)
    found = sorted(pd_.personal_data(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_email))
    for (doc, text), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or ""))), found):
        base = base_spans(text)
        assert r.doc_id == doc
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS], text
        names = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest(), text
        listed = r.spans.split(",") if r.spans else []
        assert set(names) <= set(listed)
        order = [(list(PATTERNS).index(k), int(s)) for k, s, _ in (x.split(":") for x in listed)]
        assert order == sorted(order)
        for kind, start, end in (x.split(":") for x in set(listed) - set(names)):  # added ones lie outside the base spans
            assert 0 <= int(start) < int(end) <= len(text)
            assert not any(int(start) < e and s < int(end) for _, s, e in base)


def test_long_runs_need_no_retries(spark):
    texts = ["a" * 300_000, "1" * 300_000, "a@" * 50_000, "+1" + " " * 200_000, "1 " * 100_000, "1." * 100_000 + "1", "x@y" + ".z" * 50_000]
    found = pd_.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in found.collect():
        base = base_spans(texts[r.doc_id]) if r.doc_id in (2, 5, 6) else []
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_trees_tell_decoys_from_base_spans(spark):
    rng = random.Random(2)
    texts = [f"pay {card(rng, k % 2 == 0)} or 10.{k % 200}.1.{k % 2 * 300} mail u{k}@x.org" for k in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, _text string")
    found = pd_.candidates(rows.select("row", pd_.propose(F.col("_text")).alias("found"))).cache()
    model, threshold = pd_.train(found, 8, 3, 20_000, 0.99)
    vectors = pd_.VectorAssembler(inputCols=pd_.FEATURES, outputCol="features").transform(found)
    held = model.transform(vectors).withColumn("p", pd_.vector_to_array("probability")[1])
    wrong = held.filter((F.col("p") >= threshold) != F.col("base")).count()
    assert wrong <= 0.02 * found.count()
    assert pd_.train(found.filter("base"), 8, 3, 20_000, 0.99) is None


def test_every_labelled_span_is_learnt_from(spark, monkeypatch):
    found = spark.range(24_000).select(
        F.col("id").alias("row"), F.lit(0).alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"), (F.col("id") % 2 == 0).alias("base"),
        (F.col("id") % 2 == 1).alias("decoy"), *[(F.col("id") % (k + 2)).alias(f) for k, f in enumerate(pd_.FEATURES) if f != "kind"],
    )
    seen, fit, transform = [], pd_.GBTClassifier.fit, pd_.GBTClassificationModel.transform
    monkeypatch.setattr(pd_.GBTClassifier, "fit", lambda self, df: (seen.append(df.count()), fit(self, df))[1])
    monkeypatch.setattr(pd_.GBTClassificationModel, "transform", lambda self, df: (seen.append(df.count()), transform(self, df))[1])
    assert pd_.train(found, 2, 2, precision=0.9) is not None
    assert sum(seen) == 24_000 and seen[1] > 7_000


def test_redaction(spark):
    rows = [(1, "é mail a.b@c.de or +49 (30) 1234567, 1.2.3.4", 0), (2, None, 5), (3, "", 0), (4, "none", 4), (1, "x@y.zz", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = pd_.redacted_documents(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "é mail [EMAIL] or [PHONE], [IP]", 31), (2, None, 5), (3, "", 0), (4, "none", 4), (1, "[EMAIL]", 7)], key=str
    )
    assert pd_.personal_data(docs.limit(0)).count() == 0

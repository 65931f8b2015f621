"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from barframe.llm.common import text_of
from barframe.session import materialise

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. Possessive where nothing can be given back; a match may only begin where a run of its
# first characters begins, or where the previous match ended, which finds the same spans without retries inside the run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    near: str  # cheap pattern that every match contains
    base: bool = False
    decoy: bool = False


GENERATORS = [
    Generator("email", BASE["email"], "@", True),
    Generator("ip", BASE["ip"], r"[0-9]\.[0-9]", True),
    Generator("card", BASE["card"], r"[0-9](?:[\x20-]?[0-9]){11}", True),
    Generator("phone", BASE["phone"], r"\+[0-9]", True),
    Generator(
        "email",
        r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{1,63})+",
        r"[\[({](?:at|AT)[\])}]",
    ),
    Generator("phone", r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|[\x20.-][0-9])", r"[0-9][\x20.-][0-9]{3}"),
    # Opaque tokens of letters and digits (hashes, keys, part numbers): examples of what is no personal data.
    Generator(
        "card", r"(?<![A-Za-z0-9_.@-])(?=[A-Za-z_-]{0,63}[0-9])(?=[0-9_-]{0,63}[A-Za-z])[A-Za-z0-9_-]{12,64}(?![A-Za-z0-9_@-]|\.[A-Za-z0-9])",
        "[0-9][A-Za-z]|[A-Za-z][0-9]", decoy=True,
    ),
]
FEATURES = [
    "kind", "length", "digits", "letters", "marks", "runs", "luhn", "octets", "plus", "at", "parens", "before_word", "after_word", "cue",
    "repeat",
]
# Words near personal data in several languages.
CUES = r"(?i)\b(?:tel|phone|call|fax|mobile|e-?mail|mail|contact|kontakt|card|visa|iban|pay|ip|host|server|addr\w*|t[ée]l\w*|correo)\b"


def _found(text: Column, generator: Generator, number: int) -> Column:
    """Matches of one generator with what precedes and follows each: splitting and extracting see the same matches."""
    pieces = F.split(text, generator.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(0))
    zipped = F.arrays_zip(matches.alias("match"), pieces.alias("piece"), F.slice(pieces, F.lit(2), F.size(matches)).alias("next"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(number).alias("generator"), i.alias("place"), F.length(z["piece"]).alias("gap"), z["match"].alias("match"),
            F.substring(z["piece"], -24, 24).alias("before"), F.substring(z["next"], 1, 8).alias("after"),
        ),
    )
    return F.when(text.rlike(generator.near), rows)


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    known = F.length(digits).between(12, 19)
    steps = F.when(known, F.sequence(F.lit(0), F.length(digits) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(known & (F.aggregate(steps, F.lit(0), add) % 10 == 0), F.lit(False))


_FOUND = "array<struct<generator: int, place: int, gap: int, match: string, before: string, after: string>>"


def propose(text: Column) -> Column:
    """Every generator's matches in a text, with the lengths between them."""
    none = F.expr(f"CAST(array() AS {_FOUND})")
    return F.concat(*[F.coalesce(_found(text, g, k), none) for k, g in enumerate(GENERATORS)])


def candidates(rows: DataFrame) -> DataFrame:
    """Spans of the matches of ``rows`` (``row, found``): ``row, kind, start, end, base`` and the features.

    Places are code points; each generator's spans follow from the lengths between its matches by a running sum per text.
    ``base`` marks spans of the base patterns that pass their checks; ``decoy`` those that fail, and opaque tokens.
    """
    flat = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    w = Window.partitionBy("row", "generator").orderBy("place")
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    flat = flat.withColumns({"end": end.cast("long"), "start": (end - F.length("match")).cast("long"), "_digits": _digits()})
    number = F.col("generator")
    kind = F.element_at(F.array(*[F.lit(KINDS.index(g.kind)) for g in GENERATORS]), number + 1)
    by_base, opaque = (F.element_at(F.array(*[F.lit(getattr(g, x)) for g in GENERATORS]), number + 1) for x in ("base", "decoy"))
    n = F.length("_digits")
    octets = F.forall(F.split("match", r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    flat = flat.withColumns({"kind": kind, "luhn": _luhn(F.col("_digits")), "octets": octets})
    passed = (
        F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.col("octets"))
        .when(F.col("kind") == 2, F.col("luhn") & n.between(16, 19)).otherwise(n.between(8, 15))
    )
    likely = (F.col("kind") != 2) | n.between(13, 19) | opaque
    return flat.filter(likely).select(
        "row", "kind", "start", "end", (by_base & passed).alias("base"), (by_base & ~passed | opaque).alias("decoy"),
        F.length("match").alias("length"), n.alias("digits"), F.length(F.regexp_replace("match", "[^A-Za-z]", "")).alias("letters"),
        F.length(F.regexp_replace("match", "[A-Za-z0-9]", "")).alias("marks"),
        F.size(F.regexp_extract_all("match", F.lit("[0-9]+"), F.lit(0))).alias("runs"),
        F.col("luhn").cast("int").alias("luhn"), F.col("octets").cast("int").alias("octets"),
        F.col("match").startswith("+").cast("int").alias("plus"), F.col("match").contains("@").cast("int").alias("at"),
        F.col("match").contains("(").cast("int").alias("parens"),
        F.col("before").rlike(r"[\p{L}0-9_]$").cast("int").alias("before_word"),
        F.coalesce(F.col("after").rlike(r"^[\p{L}0-9_]"), F.lit(False)).cast("int").alias("after_word"),
        F.col("before").rlike(CUES).cast("int").alias("cue"),
        (F.length("_digits") - F.size(F.array_distinct(F.split("_digits", "")))).alias("repeat"),
    )


def train(spans: DataFrame, rounds: int, depth: int, sample: int | None = None, precision: float = 0.99) -> tuple[GBTClassificationModel, float] | None:
    """(boosted trees, threshold), or None where base spans or decoys are missing.

    Learns from every labelled span (base or decoy): two thirds by hash fit, the others calibrate. A caller may ask for the
    first ``sample`` by hash; ``spans`` doesn't.
    The threshold is the lowest score, to 1/200, above which ``precision`` of the calibrating spans are base ones.
    """
    labelled = spans.filter("base OR decoy").withColumn("_h", F.xxhash64("row", "kind", "start", "end"))
    if sample is not None:
        labelled = labelled.orderBy("_h", "row", "kind", "start", "end").limit(sample)
    known = materialise(
        labelled.select(F.col("base").cast("double").alias("label"), (F.pmod("_h", F.lit(3)) == 0).alias("held"), *[F.col(f).cast("double") for f in FEATURES]),
        "pii-labelled",
    )
    sizes = {(r.held, r.label): r["count"] for r in known.groupBy("held", "label").count().collect()}  # four rows at most
    if min(sizes.get((h, y), 0) for h in (False, True) for y in (0.0, 1.0)) < 5:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=7).fit(vectors.filter("NOT held"))
    scores = model.transform(vectors.filter("held")).select("label", F.floor(200 * vector_to_array("probability")[1]).alias("bin"))
    bins = scores.groupBy("bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # 201 rows at most
    threshold, good, n = 2.0, 0.0, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        good, n = good + r.good, n + r.n
        if good >= precision * n:
            threshold = r["bin"] / 200
    return model, max(threshold, 0.5)


def spans(rows: DataFrame, rounds: int = 8, depth: int = 3, precision: float = 0.99) -> DataFrame:
    """``row, kind, start, end, base``: the base spans and those that the model adds, for ``rows`` (``row, found``).

    Added spans lie outside all base spans; of overlapping ones the best scored stays, then the earlier kind and start.
    """
    found = materialise(candidates(rows), "pii-candidates")
    sure = found.filter("base").select("row", "kind", "start", "end", "base")
    fitted = train(found, rounds, depth, precision=precision)
    if fitted is None:
        return sure
    model, threshold = fitted
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(found.filter("NOT base"))
    scored = model.transform(vectors).select("row", "kind", "start", "end", vector_to_array("probability")[1].alias("score"))
    likely = materialise(scored.filter(F.col("score") >= threshold), "pii-likely")
    taken = sure.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    free = likely.join(taken, "row", "left").filter(
        ~F.coalesce(F.exists("taken", lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"])), F.lit(False))
    )
    rank = [F.col("score").desc(), F.col("kind"), F.col("start"), F.col("end")]
    ranked = free.drop("taken").withColumn("_rank", F.row_number().over(Window.partitionBy("row").orderBy(*rank)))
    others = ranked.groupBy("row").agg(F.collect_list(F.struct("start", "end", "_rank")).alias("others"))
    best = ranked.join(others, "row").filter(
        ~F.exists("others", lambda t: (t["_rank"] < F.col("_rank")) & (t["start"] < F.col("end")) & (F.col("start") < t["end"]))
    )
    return sure.unionByName(best.select("row", "kind", "start", "end", F.lit(False).alias("base")))


def _numbered(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Stored rows with a number each, so that spans find their row also where ids repeat, and their proposed matches."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *keep, propose(text_of()).alias("found"))
    return materialise(numbered, "pii-rows")


def _names(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    Counts and ``base_sha256`` are over the base spans, ``spans`` over all, as kind:start:end in the order of KINDS and
    start, places in code points. A null text is empty; repeated rows are rows of their own; other columns are not read.
    """
    rows = _numbered(docs, [F.col("doc_id")])
    listed = spans(rows.select("row", "found"), **settings).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("found")
    )
    joined = rows.select("row", "doc_id").join(listed, "row", "left")
    found = F.coalesce("found", F.expr("CAST(array() AS array<struct<kind: int, start: bigint, end: bigint, base: boolean>>)"))
    joined = joined.select("doc_id", found.alias("found")).withColumn("sure", F.filter("found", lambda s: s["base"]))

    def count(number: int, name: str) -> Column:
        return F.size(F.filter("sure", lambda s: s["kind"] == number)).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(_names(F.col("sure")), 256).alias("base_sha256"), _names(F.col("found")).alias("spans"))


def redacted_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows with every span replaced by its kind in brackets; ``n_chars``, where there is one, follows the new text.

    Overlapping spans are replaced together by the first one's kind. Null texts stay null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = _numbered(docs, [row])
    found = spans(rows.select("row", "found"), **settings)
    # Overlapping spans become one: a span opens a group where it starts behind all earlier ends.
    w = Window.partitionBy("row").orderBy("start", "kind", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = found.withColumn("_group", F.sum(F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)).over(w))
    merged = grouped.groupBy("row", "_group").agg(F.min(F.struct("start", "kind")).alias("s"), F.max("end").alias("end"))
    listed = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "end"))).alias("found"))
    # Only rows with a match meet the spans; the others, and so most texts, are not shuffled.
    text = F.col("_row").getField("text").alias("_text")
    some = rows.filter(F.size("found") > 0).select("row", "_row", text).join(listed, "row", "left").drop("row")
    rest = rows.filter(F.size("found") == 0).select("_row", text, F.lit(None).cast(listed.schema["found"].dataType).alias("found"))
    joined = some.unionByName(rest)
    # Text before each span and behind the last; pieces are cut from the original, then put together once.
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("found.end"))
    pieces = F.zip_with(
        F.arrays_zip(F.slice(ends, F.lit(1), F.size("found")).alias("from"), F.col("found.start").alias("to")), F.col("found.kind"),
        lambda z, k: F.concat(F.substring(F.col("_text"), (z["from"] + 1).cast("int"), (z["to"] - z["from"]).cast("int")), F.element_at(kinds, k + 1)),
    )
    last = F.element_at("found.end", -1)
    text = F.concat(F.array_join(pieces, ""), F.substring(F.col("_text"), (last + 1).cast("int"), F.length("_text")))
    joined = joined.withColumn("_new", F.when(F.size("found") > 0, text).otherwise(F.col("_text")))
    columns = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == "text":
            value = F.col("_new")
        elif c == "n_chars":
            value = F.when(F.size("found") > 0, F.length("_new")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return joined.select(*columns)

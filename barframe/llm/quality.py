"""Quality rules: text statistics and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import null_key, salted_join, text_of, words
from barframe.session import materialise

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
#: Least standard deviation of each transformed statistic, low enough that each can reject alone, also where no other text
#: of a group repeats anything.
FLOORS = (0.02, 0.05, 0.05, 0.05)
CONFIDENCE = 0.999  # of the query; tests hold the operators and the pipeline to their own default
DIM = len(FLOORS)
FINE = 64  # bins per doubling of a distance


def statistics(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the statistics of ``text``, ``n_lines`` and, for words repeated in windows, nothing that grows faster than n log n."""
    gap, spaces = F.lit(None).cast("bigint"), "\t\n\x0b\x0c\r "
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, spaces, "") != "")
    rows = rows.withColumns({"_t": text})
    rows = rows.withColumns({"_w": words(F.col("_t")), "_lines": lines})
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    windows = F.greatest(F.size("_w") - 2, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("_w", k, windows).alias(f"w{k}") for k in (1, 2, 3)])
    rows = rows.withColumn("_h", F.transform(zipped, lambda w: F.xxhash64(w["w1"], w["w2"], w["w3"]))).drop("_w", "_lines", "_t")
    # Only texts that repeat a window sort theirs: equal neighbours in hash order mark the places of repeated windows.
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered)).drop("_h")
    neighbours = F.arrays_zip(
        F.col("_s.h").alias("h"), F.col("_s.i").alias("i"),
        F.concat(F.array(gap), F.slice("_s.h", F.lit(1), F.size("_s") - 1)).alias("p"),
        F.concat(F.slice("_s.h", F.lit(2), F.size("_s") - 1), F.array(gap)).alias("n"),
    )
    repeated = F.filter(neighbours, lambda x: F.coalesce(x["h"] == x["p"], F.lit(False)) | F.coalesce(x["h"] == x["n"], F.lit(False)))
    rows = rows.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_s")
    following = F.concat(F.slice("_at", F.lit(2), F.size("_at") - 1), F.array(F.lit(None).cast("int")))
    covered = F.zip_with("_at", following, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, n: s + n)
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_at").isNotNull(), total), F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics, none of which grows with the length of a text."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    ]


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution for even k."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int = DIM) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        low, high = ((low + high) / 2, high) if _chi2_cdf((low + high) / 2, k) < p else (low, (low + high) / 2)
    return high


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``_group``: language and source, or the language's small groups together where these reach ``least`` rows.
    What is left joins its language's largest group, or the largest of all; null where no group is large enough."""
    counts = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    small, same, every = F.col("n") < least, Window.partitionBy("_lang"), Window.partitionBy(F.lit(0))
    pool = F.sum(F.when(small, F.col("n"))).over(same)
    own = F.concat(F.lit("2"), F.length("_lang"), F.lit(":"), "_lang", "_source")
    counts = counts.withColumn("_name", F.when(~small, own).when(pool >= least, F.concat(F.lit("1"), "_lang")))
    largest = F.max(F.when(F.col("_name").isNotNull(), F.struct("n", "_name")))
    group = F.coalesce("_name", largest.over(same)["_name"], largest.over(every)["_name"])
    named = counts.select("_lang", "_source", group.alias("_group"))
    return salted_join(rows, named, ["_lang", "_source"], ["doc_id", *STATISTICS])


def _squared_distance() -> Column:
    """Mahalanobis distance, squared, by forward substitution with the lower triangle of the covariance."""
    ys: list[Column] = []
    for i in range(DIM):
        known = sum((F.col(f"l{i}{j}") * ys[j] for j in range(i)), F.lit(0.0))
        ys.append((F.col(f"x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return sum((y * y for y in ys), F.lit(0.0))


def _triangle(moments: DataFrame, factor: float) -> DataFrame:
    """Means and Cholesky triangle from sums; the floors keep every covariance regular."""
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIM)})
    for i in range(DIM):
        for j in range(i + 1):
            cov = (F.col(f"p{j}{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(factor)
            cov = cov + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(FLOORS[i] ** 2 / 100))) if i == j else cov / F.col(f"l{j}{j}"))
    return out.select("_group", *_STATE)


_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_STATE = [*[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]]


def _medians(rows: DataFrame) -> DataFrame:
    """Per group the medians of the transformed statistics (to 1/256), with the floors as deviations."""
    tall = rows.select("_group", F.posexplode(F.array(*[F.round(F.col(f"x{i}") * 256).cast("int") for i in range(DIM)])).alias("i", "v"))
    counts = tall.groupBy("_group", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_group", "i")
    upto = F.sum("n").over(w.orderBy("v"))
    middle = counts.withColumns({"_upto": upto, "_all": F.sum("n").over(w)}).filter(2 * F.col("_upto") >= F.col("_all"))
    values = middle.groupBy("_group", "i").agg((F.min("v") / 256).alias("v"))
    return values.groupBy("_group").agg(
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"m{i}") for i in range(DIM)],
        *[F.lit(2 * FLOORS[i] if i == j else 0.0).alias(f"l{i}{j}") for i in range(DIM) for j in range(i + 1)],
    )


def fit(rows: DataFrame, core: float, steps: int) -> DataFrame:
    """Minimum-covariance-determinant estimates of each ``_group`` from ``x0..``: means ``m`` and triangle ``l``.

    Starts from the medians; each step keeps the rows with the smallest distances, a share of ``core`` (to a bin of 1/64
    of a doubling), and takes their mean and covariance, which never raises the determinant. A step is one aggregation
    by group and distance bin: the bins give both the quantile and the sums inside it, so no group is ever sorted.
    """
    factor = core / _chi2_cdf(chi2_quantile(core), DIM + 2)
    state = materialise(_medians(rows), "quality-fit")
    for _ in range(steps):
        placed = salted_join(rows, state, ["_group"], ["doc_id", *[f"x{i}" for i in range(DIM)]])
        placed = placed.withColumn("_bin", F.floor(FINE * F.log2(1 + _squared_distance())).cast("int"))
        bins = placed.groupBy("_group", "_bin").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS],
        )
        w = Window.partitionBy("_group")
        bins = bins.withColumns({"_below": F.sum("n").over(w.orderBy("_bin")) - F.col("n"), "_all": F.sum("n").over(w)})
        kept = bins.filter(F.col("_below") < F.lit(core) * F.col("_all"))
        sums = kept.groupBy("_group").agg(*[F.sum(c).alias(c) for c in bins.columns if c[0] in "nsp"])
        state = materialise(_triangle(sums, factor), "quality-fit")
    return state


def _described(docs: DataFrame, keep: Sequence[Column]) -> DataFrame:
    rows = docs.select(*keep, "doc_id", null_key("lang").alias("_lang"), null_key("source").alias("_source"), text_of().alias("_text"))
    rows = statistics(rows, F.col("_text")).drop("_text")
    return rows.withColumns({"base_failed": base_failed(), **{f"x{i}": x for i, x in enumerate(vector())}})


def _judge(rows: DataFrame, core: float, steps: int, confidence: float, least: int) -> DataFrame:
    """Adds ``distance`` (null without a group or where the base fails) and ``kept``."""
    grouped = _groups(rows.filter("NOT base_failed").select("doc_id", "_lang", "_source", *STATISTICS, *[f"x{i}" for i in range(DIM)]), least)
    names = materialise(grouped.filter("_group IS NOT NULL").select("doc_id", "_lang", "_source", "_group", *[f"x{i}" for i in range(DIM)]), "quality-rows")
    state = fit(names, core, steps)
    where = names.select("_lang", "_source", "_group").distinct()
    chosen = materialise(where.join(state, "_group").drop("_group"), "quality-state")
    placed = salted_join(rows, chosen, ["_lang", "_source"], ["doc_id", *STATISTICS], "left")
    judged = placed.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_squared_distance())))
    inside = F.coalesce(F.col("distance") <= math.sqrt(chi2_quantile(confidence)), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside)


def quality(docs: DataFrame, core: float = 0.75, steps: int = 4, confidence: float = 1 - 1e-12, least: int = 60) -> DataFrame:
    """Statistics and verdict of each document: ``doc_id``, the statistics, ``base_failed``, ``distance``, ``kept``.

    Documents that pass the base rules are placed by four transformed statistics (mean word length, shares of symbols,
    repeated lines and repeated windows), robustly per language and source; a squared Mahalanobis distance beyond the
    ``confidence`` quantile rejects. Groups under ``least`` rows are pooled by language or judged with a larger group;
    where there is none, the base rules decide alone. A null text counts as empty, null languages and sources are groups,
    repeated rows count each; other columns are not read.
    """
    rows = materialise(_described(docs, []), "quality-described")
    return _judge(rows, core, steps, confidence, least).select("doc_id", *STATISTICS, "base_failed", "distance", "kept")


def good_documents(docs: DataFrame, core: float = 0.75, steps: int = 4, confidence: float = 1 - 1e-12, least: int = 60) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns; texts are described once and never shuffled for the verdict."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = materialise(_described(docs, [row]), "quality-described")
    return _judge(rows, core, steps, confidence, least).filter("kept").select("_row.*")


def rejections(docs: DataFrame, core: float = 0.75, steps: int = 4, confidence: float = CONFIDENCE, least: int = 60) -> DataFrame:
    """Per ``lang`` and ``source``: ``n`` documents that pass the base rules and have a distance, the share ``rejected`` and,
    as ``by_`` each transformed statistic, the share that this statistic rejects even if taken alone."""
    rows = materialise(_described(docs, [F.col("lang"), F.col("source")]), "quality-described")
    judged = _judge(rows, core, steps, confidence, least).filter("distance IS NOT NULL")
    limit, names = math.sqrt(chi2_quantile(confidence)), ("word_length", "symbols", "dup_lines", "repeat_words")
    alone = []
    for i, name in enumerate(names):
        deviation = F.sqrt(sum((F.col(f"l{i}{j}") * F.col(f"l{i}{j}") for j in range(i + 1)), F.lit(0.0)))
        beyond = F.abs(F.col(f"x{i}") - F.col(f"m{i}")) > limit * deviation
        alone.append(F.avg(beyond.cast("int")).alias(f"by_{name}"))
    return judged.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("kept")).cast("int")).alias("rejected"), *alone)

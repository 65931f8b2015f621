"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import n_words, null_key, salted_join, text_of
from barframe.session import materialise

CAP = 2.0
RANK_BITS = 40
DIGIT_BITS = 10


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to one row per source with ``source`` and ``source_size``.

    Sources by code point (null last) take the weights in turn. ``share`` of all sizes is split by weight, no source
    beyond ``cap`` times its size, the excess going to the others by weight. Sorted by size per weight, the sources that
    reach their cap come first, so one running sum finds the level at which the rest shares. One row per source is all
    that ever stands in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    leveled = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    shared = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least("_cap", F.coalesce(F.col("_w") * shared, F.col("_cap")))
    return leveled.withColumn("target", target).drop("_w", "_cap", "_level")


def measure(size: Column) -> Column:
    """Inclusion weight of a document: grows with the logarithm of its size (4 to about 40, so few distinct values)."""
    return (F.lit(4) + F.floor(F.log2(size + 1))).cast("int")


def _rate(levels: DataFrame, cap: float) -> DataFrame:
    """Per source the factor c with sum(min(cap, c * measure) * size) = target, from sums per measure."""
    down = Window.partitionBy("_key").orderBy(F.col("_q").desc())
    above = F.coalesce(F.sum("_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_words") * F.col("_q")).over(down.rowsBetween(0, Window.unboundedFollowing))
    c = (F.col("target") - above * F.lit(cap)) / rest
    tried = levels.withColumn("_c", F.when(rest > 0, c))
    fits = F.when(F.col("_c") * F.col("_q") <= cap, F.struct(-F.col("_q"), "_c"))
    return tried.groupBy("_key").agg(F.min(fits)["_c"].alias("_c"))


def plan(sized: DataFrame, weights: Sequence[float], share: float, seed: int, cap: float = CAP) -> DataFrame:
    """One row per source: what decides about its documents (see ``mix``). ``sized``: ``doc_id``, ``_key``, ``source``, ``size``."""
    levels = materialise(
        sized.groupBy("_key", "source", measure(F.col("size")).alias("_q")).agg(F.sum("size").alias("_words")), "mix-levels"
    )
    sizes = levels.groupBy("_key", "source").agg(F.sum("_words").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, cap), "mix-targets")
    rates = _rate(levels.join(targets.select("_key", "target"), "_key"), cap)
    copies = F.least(F.lit(cap), F.coalesce(F.col("_c"), F.lit(cap)) * F.col("_q"))
    certain = levels.join(rates, "_key").groupBy("_key").agg(
        F.first("_c").alias("_c"), F.sum(F.floor(copies) * F.col("_words")).alias("_certain")
    )
    state = materialise(
        targets.join(certain, "_key").withColumn("_open", F.col("target") - F.col("_certain"))
        .withColumn("_prefix", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")),
        "mix-state",
    )
    drawn = salted_join(sized.select("doc_id", "_key", "size"), state.select("_key", "_c"), ["_key"], ["doc_id", "size"])
    ranks = materialise(drawn.select("_key", "size", _rank(cap, seed).alias("_rank")).filter("_rank IS NOT NULL"), "mix-ranks")
    # The first ranks whose sizes fill what is open: one digit of the rank after the other, so that no task ever holds
    # a source's documents; each round sums per digit and keeps the digit in which the sum crosses the open amount.
    for shift in range(RANK_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        rows = salted_join(ranks, state.select("_key", "_prefix"), ["_key"], ["_rank", "size"])
        inside = rows.filter(F.shiftright("_rank", shift + DIGIT_BITS) == F.col("_prefix"))
        sums = inside.groupBy("_key", F.shiftright("_rank", shift).alias("_digit")).agg(F.sum("size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_digit"))
        sums = sums.withColumn("_upto", upto).join(state.select("_key", "_open", "_before"), "_key")
        crossed = F.col("_before") + F.col("_upto") >= F.col("_open")
        first = F.min(F.when(crossed, F.struct("_digit", (F.col("_before") + F.col("_upto") - F.col("_sum")).alias("b"), "_sum")))
        found = sums.groupBy("_key").agg(first.alias("_f"))
        state = state.join(found, "_key", "left")
        # A source with too little to fill the open amount takes all of its ranks.
        state = state.withColumn("_prefix", F.coalesce("_f._digit", F.lit((1 << RANK_BITS - shift) - 1)))
        state = state.withColumn("_last", F.coalesce("_f._sum", F.lit(0))).withColumn("_before", F.coalesce("_f.b", "_before"))
        state = materialise(state.drop("_f"), "mix-state")
    nearer = F.col("_before") + F.col("_last") - F.col("_open") < F.col("_open") - F.col("_before")
    last = F.when((F.col("_last") == 0) | nearer, F.col("_prefix")).otherwise(F.col("_prefix") - 1)
    return materialise(state.select("_key", "source_size", "target", "_c", last.alias("_last_rank")), "mix-plan")


def _copies(cap: float) -> Column:
    return F.least(F.lit(cap), F.coalesce(F.col("_c"), F.lit(cap)) * measure(F.col("size")))


def _rank(cap: float, seed: int) -> Column:
    """Pareto rank, null where no part copy is due: odds of a uniform number over odds of inclusion, on an integer scale."""
    part = _copies(cap) - F.floor(_copies(cap))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    ratio = u / (1 - u) * ((1 - part) / part)
    return F.when(part > 0, F.floor(ratio / (1 + ratio) * F.lit(float(1 << RANK_BITS))).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", null_key("source").alias("_key"), "source", n_words(text_of()).cast("long").alias("size"))


def _decide(sized: DataFrame, chosen: DataFrame, seed: int, cap: float) -> DataFrame:
    joined = salted_join(sized, chosen, ["_key"], ["doc_id", "size"])
    drawn = F.coalesce(_rank(cap, seed) <= F.col("_last_rank"), F.lit(False)).cast("int")
    return joined.withColumn("copies", (F.floor(_copies(cap)) + drawn).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 17, cap: float = CAP) -> DataFrame:
    """Copies that a mix takes of each document: ``doc_id, size, source_size, target, copies, taken``.

    Sizes are word counts. A document is due min(``cap``, c * measure) copies, where c makes its source meet the target
    in expectation. Whole copies are certain; the fraction is an inclusion probability p, and documents are ranked by
    (u / (1 - u)) / (p / (1 - p)) with u a uniform number from the document's id and the seed. The sample is the first
    ranks until the source's open words are filled, the last rank only if that comes nearer. Equal ids share their draw,
    so reruns agree. Null texts and texts without words have size 0 and are taken for nothing; a null source is a source.
    """
    sized = materialise(_sized(docs), "mix-sizes")
    decided = _decide(sized, plan(sized, weights, share, seed, cap), seed, cap)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return decided.select("doc_id", "size", "source_size", "target", "copies", taken)


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 17, cap: float = CAP
) -> DataFrame:
    """The documents themselves, each as often as ``mix`` takes it; only the plan (a row per source) is joined to the texts."""
    sized = materialise(_sized(docs), "mix-sizes")
    chosen = plan(sized, weights, share, seed, cap)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    rows = rows.select("_row", "doc_id", null_key("source").alias("_key"), n_words(text_of()).cast("long").alias("size"))
    copies = _decide(rows, chosen, seed, cap).filter("copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")

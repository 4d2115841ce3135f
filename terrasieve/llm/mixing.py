"""Mixing sources to target weights, with DataFrame operations only.

Each source's share of tokens p becomes a weight p**a / sum(p**a). At a = 1 the mixture is the
corpus, at a = 0 all sources weigh the same. The exponent is bisected to the largest one whose
weights reach the target entropy, then raised, if need be, to the least one under which no
source repeats more than the repetition limit (relative to the source that repeats least).
Halving goes four steps at a time: one aggregation over the sources tries 15 exponents.

The weights are realised as permutations of documents in blocks. A source's stream is its
documents in an order drawn by hash anew for each pass; the budget says how many tokens of the
stream are taken, so a source goes through whole passes and a part of the last one. Block b of
the mixture takes from every source its weighted share of the block's tokens, and within a
block the documents of all sources stand in hash order. Without a budget, the least one is used
under which every document appears (the source that repeats least passes once).

Running totals of tokens never need a source in one task: a source's stream is cut into hash
ranges of about ``RANGE_ROWS`` documents, totals of ranges are summed before, and each range
counts on from there.

Tokens are words at ASCII white space. Null text has none: such a document takes no room, and
follows the one before it. A null source is a source of its own. Repeated rows each take their
place. An empty table gives an empty result. Columns besides ``doc_id``, ``text`` and
``source`` are ignored (``mix`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_rank, words

TARGET_ENTROPY = 0.95
MAX_REPETITION = 1.5
BLOCK_TOKENS = 1_000_000
RANGE_ROWS = 4096
GROUP_RANGES = 4096
SEED = 17
ROUNDS = 8


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def source_tokens(counted: DataFrame) -> DataFrame:
    """``source, n_docs, n_tokens, p`` (share of tokens; the number of sources only)."""
    by = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    return by.withColumn("p", F.col("n_tokens") / F.lit(total) if total else F.lit(0.0))


def _try(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the exponent, the entropy of its weights as a part of the greatest
    possible, and the most that a source repeats relative to the one that repeats least."""
    tried = shares.where("p > 0").select("p", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    w, r = F.pow("p", F.col("a")), F.pow("p", F.col("a") - 1)
    sums = tried.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * F.log("p")).alias("l"), F.count("*").alias("n"), (F.max(r) / F.min(r)).alias("rep"))
    out = []
    for s in sums.collect():  # one row for each exponent tried
        entropy = math.log(s.z) - s.l / s.z
        out.append((s.a, entropy / math.log(s.n) if s.n > 1 else 1.0, s.rep))
    return sorted(out)


def _bisect(shares: DataFrame, holds, upper: bool) -> float:
    """The end of the exponents in [0, 1] at which ``holds`` changes: it holds up to the result
    (``upper``) or from the result on."""
    low, high = 0.0, 1.0
    (_, *at0), (_, *at1) = _try(shares, [0.0, 1.0]) or [(0.0, 1.0, 1.0)] * 2
    if upper and (holds(*at1) or not holds(*at0)):
        return 1.0 if holds(*at1) else 0.0
    if not upper and holds(*at0):
        return 0.0
    for _ in range(ROUNDS):
        for a, *seen in _try(shares, [low + (high - low) * k / 16 for k in range(1, 16)]):
            if holds(*seen) == upper:
                low = max(low, a)
            else:
                high = min(high, a)
    return low if upper else high


def exponent(shares: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION) -> float:
    even = _bisect(shares, lambda h, r: h >= target_entropy, True)
    spare = _bisect(shares, lambda h, r: r <= max_repetition, False)
    return max(even, spare)


def weights(shares: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """``source, n_docs, n_tokens, p, weight, quota``: quota is the tokens to take of each."""
    shares = shares.withColumn("w", F.when(F.col("p") > 0, F.pow("p", F.lit(a))).otherwise(0.0))
    total = shares.agg(F.sum("w").alias("z"), F.max(F.when(F.col("p") > 0, F.col("n_tokens") / F.col("w"))).alias("scale")).first()
    out = shares.withColumn("weight", F.col("w") / F.lit(total.z) if total.z else F.lit(0.0))
    # weight * (scale * z) is n_tokens for the source that repeats least, and more for others.
    all_once = F.ceil(F.col("w") * F.lit(total.scale or 0.0) - 1e-6)
    taken = F.ceil(F.col("weight") * F.lit(float(budget))) if budget is not None else F.greatest(all_once, F.col("n_tokens"))
    return out.select("source", "n_docs", "n_tokens", "p", "weight", F.coalesce(taken, F.lit(0)).cast("long").alias("quota"))


def _tokens_before(ranges: DataFrame) -> DataFrame:
    """``__held, epoch, range, before`` of ``ranges (__held, epoch, range, n)``: the tokens of a
    source's stream before each of its ranges. Totals of groups of ranges are added up first, so
    that a source with most of the documents has no long list in one task."""
    ranges = ranges.withColumn("group", F.floor(F.col("range") / GROUP_RANGES))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = ranges.groupBy("__held", "epoch", "group").agg(F.sum("n").alias("m"))
    groups = groups.select("__held", "epoch", "group", F.coalesce(F.sum("m").over(earlier("__held").orderBy("epoch", "group")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(earlier("__held", "epoch", "group").orderBy("range")), F.lit(0))
    out = ranges.select("__held", "epoch", "group", "range", inside.alias("inside")).join(groups, ["__held", "epoch", "group"])
    return out.select("__held", "epoch", "range", (F.col("base") + F.col("inside")).alias("before"))


def placements(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, weight, epoch, block, position, n_tokens, __row``: where each document
    stands in the mixture; a row for each time it does. ``__row`` tells repeated rows apart."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text")).alias("n_tokens"), _row_key().alias("__row"))
    counted = materialise(counted, "mixing-tokens")
    shares = materialise(source_tokens(counted), "mixing-sources")
    a = exponent(shares, target_entropy, max_repetition)
    plan = materialise(weights(shares, a, budget), "mixing-weights").withColumnRenamed("source", "__source")
    # How often a source is begun. A source without tokens passes once.
    passes = F.when(F.col("weight") > 0, F.ceil(F.col("quota") / F.col("n_all"))).otherwise(F.lit(1 if budget is None else 0))
    plan = plan.withColumnRenamed("n_tokens", "n_all").select("*", passes.cast("long").alias("passes"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS)).cast("long").alias("n_ranges"))
    stream = counted.join(plan, F.col("source").eqNullSafe(F.col("__source"))).where("passes > 0").drop("__source")
    stream = stream.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("epoch"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "__row", "epoch", F.lit(seed)), 1)
    stream = stream.withColumn("key", key).withColumn("range", F.floor(F.col("key") / (2.0**63) * F.col("n_ranges")).cast("long"))
    held = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    stream = materialise(stream.withColumn("__held", held), "mixing-stream")
    before = _tokens_before(stream.groupBy("__held", "epoch", "range").agg(F.sum("n_tokens").alias("n")))
    within = Window.partitionBy("__held", "epoch", "range").orderBy("key", "doc_id", "__row").rowsBetween(Window.unboundedPreceding, -1)
    stream = stream.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, ["__held", "epoch", "range"])
    stream = stream.withColumn("at", F.col("before") + F.col("inside"))
    taken = stream.where((F.col("at") < F.col("quota")) | ((F.col("weight") == 0) | (F.col("n_all") == 0)) | ((F.col("n_tokens") == 0) & (F.col("at") <= F.col("quota")) & (F.col("epoch") == 0)))
    share = F.greatest(F.col("weight") * F.lit(float(block_tokens)), F.lit(1.0))
    taken = taken.withColumn("block", F.floor(F.when(F.col("weight") > 0, F.col("at") / share).otherwise(F.col("range"))).cast("long"))
    place = Window.partitionBy("block").orderBy("key", "doc_id", "__row")
    return taken.withColumn("position", F.row_number().over(place).cast("long")).select("doc_id", "source", F.round("weight", 9).alias("weight"), "epoch", "block", "position", "n_tokens", "__row")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with all their columns.

    Rows that agree in id, text and source have taken their places together: each of k such rows
    stands for a k-th of them, rounded down, and what is left of the division goes to
    the one of them whose columns have the least hash. So the result has a row for each placement.
    """
    placed = placements(docs, **how).groupBy(F.col("doc_id").alias("__a"), F.col("__row").alias("__b")).agg(F.count("*").alias("__t"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__all"), F.col("doc_id").cast("long").alias("__id"), _row_key().alias("__key"), row_rank(docs).alias("__rank"))
    copies = own.groupBy(F.col("__id").alias("__c"), F.col("__key").alias("__d")).agg(F.count("*").alias("__k"))
    times = placed.join(copies, F.col("__a").eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__d"))).select("__a", "__b", F.floor(F.col("__t") / F.col("__k")).cast("int").alias("__n"), (F.col("__t") % F.col("__k")).cast("int").alias("__left"))
    rows = own.join(times, F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__key") == F.col("__b")))
    left = rows.where("__left > 0").groupBy("__id", "__key").agg(F.min_by("__all", "__rank").alias("__all"), F.max("__left").alias("__n"))
    every = rows.select("__all", "__n").unionByName(left.select("__all", "__n")).where("__n > 0")
    every = every.select("__all", F.explode(F.array_repeat(F.lit(0), F.col("__n"))))
    return every.select(*[F.col("__all").getField(c).alias(c) for c in docs.columns])

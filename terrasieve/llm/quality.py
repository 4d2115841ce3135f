"""Quality rules learned as a decision list, with DataFrame operations only.

Statistics of every text come from column expressions. Labelled rows are binned at quantiles of
the statistics, and sequential covering learns from counts: one grouped count over the rows that
a rule covers so far gives, for every statistic and threshold, how many low and good rows a
further condition would leave. The condition of greatest gain joins the rule; the rule is then
cut back to the prefix that does best on rows kept aside, and is taken if it is precise there.
Rows that a rule covers leave, and the next rule is grown. What reaches the driver is a table of
statistics by bins, of fixed size. The list becomes one ordered conditional expression.

Null text has no words: it fails the base rule. Null ``doc_id`` is judged, never learned from.
Labels that are null are skipped, of conflicting ones the least counts. Without labels of both
classes the list is empty. Repeated rows each give a row; an empty table gives an empty result.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, texts, words

SHINGLE = 8
STATISTICS = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "mark_rate", "digit_rate", "word_length", "distinct_rate", "log_words")
GRID = 24  # thresholds from the quantiles of low rows, and as many from those of all rows
MAX_RULES, MAX_CONDITIONS, LEAST_ROWS, LEAST_PRECISION = 8, 3, 5, 0.9


def repeated_words(w: Column, size: int = SHINGLE) -> Column:
    """Words that stand in a window of ``size`` words found twice or more in the text."""

    def count(h: Column) -> Column:
        def covered(at: Column) -> Column:
            own = F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size))))
            return F.aggregate(own, F.lit(0), lambda a, b: a + b)

        def twice(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            picked = F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"])), lambda p: p.isNotNull())
            return let(F.array_sort(picked), covered)

        found = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), twice)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(0)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - size + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and ``STATISTICS`` of every row."""
    t, w = F.col("text"), F.col("w")
    marks = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    counted = texts(docs).select("doc_id", "text", words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = counted.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        marks(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        marks("[A-Z]").alias("n_upper"),
        marks("[!?]").alias("n_marks"),
        marks("[0-9]").alias("n_digits"),
        F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).alias("n_distinct"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    rates = [per("n_symbols", "n_words"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), per("n_upper", "word_chars"), per("n_marks", "n_words"), per("n_digits", "word_chars"), per("word_chars", "n_words"), per("n_distinct", "n_words"), F.log1p("n_words")]
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[r.alias(s) for s, r in zip(STATISTICS, rates, strict=True)])


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # value >= limit, else value < limit
    limit: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c >= self.limit if self.above else c < self.limit

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    steps = [(k + 0.5) / GRID for k in range(GRID)]
    low, every = (r.approxQuantile(list(STATISTICS), steps, 0.002) for r in (rows.where("low = 1"), rows))
    return {s: sorted({*a, *b}) for s, a, b in zip(STATISTICS, low, every, strict=True)}


def _bin(statistic: str, limits: list[float]) -> Column:
    """How many of the limits a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda t: t <= F.col(statistic)))


def _histogram(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(statistic, bin) to (low rows, good rows)."""
    seen = rows.select(F.posexplode("bins").alias("s", "bin"), "low").groupBy("s", "bin").agg(F.sum("low").alias("p"), F.count("*").alias("n")).collect()
    return {(r.s, r.bin): (r.p, r.n - r.p) for r in seen}


def _best(hist: dict[tuple[int, int], tuple[int, int]], limits: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of greatest FOIL gain and the low and good rows that it leaves."""
    everything = [v for (s, _), v in hist.items() if s == 0]
    p0, n0 = sum(p for p, _ in everything), sum(n for _, n in everything)
    best, found = 1e-9, (None, p0, n0)
    if not p0:
        return found
    for s, name in enumerate(STATISTICS):
        p = n = 0
        for b in range(len(limits[name])):  # rows of bins 0..b lie below limit b
            dp, dn = hist.get((s, b), (0, 0))
            p, n = p + dp, n + dn
            for above, q, m in ((True, p0 - p, n0 - n), (False, p, n)):
                if q >= LEAST_ROWS and (q, m) != (p0, n0):
                    gain = q * (math.log2(q / (q + m)) - math.log2(p0 / (p0 + n0)))
                    if gain > best:
                        best, found = gain, (Condition(name, above, limits[name][b]), q, m)
    return found


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for low quality, in order. ``stats`` is what ``statistics`` returns, written."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("low"))
    rows = stats.select("doc_id", *STATISTICS).join(known, "doc_id").withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0)
    rows = materialise(rows, "quality-labelled")
    if {r.low for r in rows.select("low").distinct().collect()} != {0, 1}:
        return []
    limits = _thresholds(rows)
    bins = [_bin(s, limits[s]) for s in STATISTICS]
    rows = materialise(rows.select("*", F.array(*bins).alias("bins")), "quality-binned")
    rules: list[Rule] = []
    open_ = F.lit(True)
    for _ in range(MAX_RULES):
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            condition, _, bad = _best(_histogram(rows.where(~F.col("aside") & open_ & covers(rule))), limits)
            if condition is None:
                break
            rule += (condition,)
            if not bad:
                break
        if not rule:
            break
        # Prune: every prefix of the rule on the rows kept aside, in one pass.
        told = rows.where(F.col("aside") & open_).agg(*[f.alias(f"{name}{k}") for k in range(1, len(rule) + 1) for name, f in (("p", F.count_if(covers(rule[:k]) & (F.col("low") == 1))), ("n", F.count_if(covers(rule[:k]) & (F.col("low") == 0))))]).first()
        worth = {k: (told[f"p{k}"] - told[f"n{k}"]) / max(1, told[f"p{k}"] + told[f"n{k}"]) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: (worth[k], -k))
        rule, p, n = rule[:k], told[f"p{k}"], told[f"n{k}"]
        if p < 1 or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(rule)
        open_ = open_ & ~covers(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(covers(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and verdict of every row; ``rule`` is the number of the rule that fired."""
    stats = materialise(statistics(docs), "quality-statistics")
    rules = learn(stats, labels)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")

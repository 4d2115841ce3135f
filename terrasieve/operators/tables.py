"""Small reports: counts by class, gaps between arms, orders, mappings, long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crosstab(rows: DataFrame, group: str, column: str, values: list) -> DataFrame:
    """``group`` and a column of counts for each value, zeros included."""
    out = rows.groupBy(group).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])
    return out


def fold_table(rows: DataFrame, fold: str, label: str, least: int = 1) -> DataFrame:
    """``fold, n, n_pos, n_neg, usable``: a fold is usable with both classes often enough."""
    out = rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("n_pos"))
    out = out.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    return out.withColumn("usable", (F.col("n_pos") >= least) & (F.col("n_neg") >= least))


def frequent_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values but null and empty ones (ties: the lower value)."""
    known = rows.where(F.coalesce(F.length(F.col(column).cast("string")), F.lit(0)) > 0)
    return known.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def arm_gap(rows: DataFrame, arm: str, a: str, b: str, value: str, factor: float = 2.0) -> DataFrame:
    """One row: means of two arms, the pooled deviation sqrt((var a + var b) / 2), the gap in
    units of it, and whether the gap exceeds the greater deviation and a multiple of it."""
    own = lambda name: F.when(F.col(arm) == name, F.col(value))
    stats = rows.agg(
        F.avg(own(a)).alias("mean_a"),
        F.avg(own(b)).alias("mean_b"),
        F.var_samp(own(a)).alias("var_a"),
        F.var_samp(own(b)).alias("var_b"),
    )
    gap = F.col("mean_a") - F.col("mean_b")
    pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    noise = F.sqrt(F.greatest("var_a", "var_b"))
    return stats.select(
        "mean_a",
        "mean_b",
        gap.alias("gap"),
        pooled.alias("pooled_sd"),
        F.try_divide(gap, pooled).alias("effect"),
        (F.abs(gap) > noise).alias("over_spread"),
        (F.abs(gap) > factor * noise).alias("over_noise"),
    )


def seed_text(rows: DataFrame, arm: str, seed: str, value: str, digits: int = 4) -> DataFrame:
    """``arm, n_seeds, mean, sd, per_seed``: ``seed:mean`` of each seed in order."""
    seeds = rows.groupBy(arm, seed).agg(F.avg(value).alias("m"))
    each = F.array_sort(F.collect_list(F.struct(F.col(seed).alias("s"), F.col("m").alias("m"))))  # a row per seed
    text = F.array_join(F.transform(each, lambda x: F.concat(x["s"].cast("string"), F.lit(":"), F.format_string(f"%.{digits}f", x["m"]))), ";")
    return seeds.groupBy(arm).agg(F.count("*").alias("n_seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), text.alias("per_seed"))


def against_references(summary: DataFrame, method: str, metric: str, references: dict[str, float]) -> DataFrame:
    """``method, reference, delta``: a row for each method and named reference value."""
    known = F.array(*[F.struct(F.lit(k).alias("reference"), F.lit(float(v)).alias("value")) for k, v in references.items()])
    out = summary.select(method, metric, F.explode(known).alias("r"))
    return out.select(method, F.col("r.reference").alias("reference"), (F.col(metric) - F.col("r.value")).alias("delta"))


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric, mean, sd`` of the metrics over the rows of each key."""
    long = wide.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def mapped(value: Column, known: dict, default: str | None = None) -> Column:
    """A fixed mapping; other values become the default."""
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def canonical(names: list[str], aliases: dict[str, str], drop: str = "none") -> list[str]:
    """Names without aliases, in order and once each; unknown ones are an error."""
    out = []
    for name in (n.strip().lower() for n in names):
        if name == drop:
            continue
        if name not in aliases and name not in aliases.values():
            raise ValueError(f"unknown: {name}")
        out.append(aliases.get(name, name))
    return list(dict.fromkeys(out))


def in_order(rows: DataFrame, column: str, order: list) -> DataFrame:
    """``rows`` of a summary with ``position``: values in the order given, others after them."""
    place = mapped_place(F.col(column), order)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(place, F.col(column))))


def mapped_place(value: Column, order: list) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair]), value), F.lit(len(order)))


def farthest(rows: DataFrame, group: list[str], key: str, d: str) -> DataFrame:
    """Of each group the row farthest out (the lower key on ties)."""
    best = F.max(F.struct(F.col(d), (-F.col(key)).alias("low"))).alias("b")
    return rows.groupBy(*group).agg(best).select(*group, (-F.col("b.low")).alias(key), F.col(f"b.{d}").alias(d))


def weighted_loss(log: DataFrame, run: list[str], loss: str, n: str) -> DataFrame:
    return log.groupBy(*run).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def top_class_accuracy(logits: DataFrame, item: str, label: str, target: str, logit: str) -> DataFrame:
    """One row: how often the class of the greatest logit (the lower one on ties) is the target."""
    best = F.max(F.struct(F.col(logit), (-F.col(label)).alias("low")))["low"]
    each = logits.groupBy(item).agg((-best).alias("c"), F.max(target).alias("t"))
    return each.agg(F.avg((F.col("c") == F.col("t")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def disjoint_parts(rows: DataFrame, key: str, part: str) -> DataFrame:
    """``a, b, shared``: for each pair of parts that share ids, how many."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("p")).where(F.size("p") > 1)  # a set of parts
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return parts.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("shared"))


def unequal_sets(rows: DataFrame, key: str, part: str, n_parts: int) -> DataFrame:
    """Ids that some parts have and others lack, with how many have them."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") < n_parts)

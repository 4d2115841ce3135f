"""Checks as data: a row per rule with its number of violations, all from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_valid


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n``: how many rows break each rule; a rule that is null for a row is broken."""
    one = rows.agg(*[F.count_if(F.coalesce(~c, F.lit(True))).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("v")).select("v.rule", "v.n")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def spread_groups(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand in more than one part: leakage between folds."""
    return rows.groupBy(group).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")


def check(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` if no rule is broken, else an error that names those that are."""
    broken = {r.rule: r.n for r in violations(rows, rules).where("n > 0").collect()}
    if broken:
        raise ValueError(f"quality rules are broken: {broken}")
    return rows


def final_set_rules(rows: DataFrame, cluster: str, label: str, key: str, n_clusters: int, most_gap: int = 1) -> DataFrame:
    """``rule, n`` of a set ready for training: labels and clusters in their domains, ids unique,
    both classes in every cluster, and class counts per cluster within ``most_gap``."""
    domain = violations(rows, {"label is 0 or 1": F.col(label).isin(0, 1), "cluster in domain": F.col(cluster).between(0, n_clusters - 1), "id is there": F.col(key).isNotNull()})
    twice = repeated_keys(rows, [key]).agg(F.count("*").alias("n")).select(F.lit("id is unique").alias("rule"), "n")
    counts = rows.groupBy(cluster).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    seen = counts.agg(
        F.count_if((F.col("p") == 0) | (F.col("q") == 0)).alias("one"),
        F.count_if(F.abs(F.col("p") - F.col("q")) > most_gap).alias("gap"),
        (n_clusters - F.count("*")).alias("none"),
    )
    per = [("both classes in a cluster", "one"), ("counts of a cluster are close", "gap"), ("every cluster is there", "none")]
    clusters = seen.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("long").alias("n")) for r, c in per])).alias("v")).select("v.rule", "v.n")
    return domain.unionByName(twice).unionByName(clusters)


def common_set_rules(rows: DataFrame, key: str, part: str, n_parts: int, valid: str, label: str) -> DataFrame:
    """``rule, n`` of outputs that must agree: every id in all parts and once in each, every row
    valid, one label for each id."""
    by = rows.groupBy(key).agg(F.count_distinct(part).alias("parts"), F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    ids = by.agg(F.count_if(F.col("parts") < n_parts).alias("a"), F.count_if(F.col("n") > F.col("parts")).alias("b"), F.count_if(F.col("labels") > 1).alias("c"))
    per = [("id is in every part", "a"), ("id is once in a part", "b"), ("id has one label", "c")]
    out = ids.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).alias("n")) for r, c in per])).alias("v")).select("v.rule", "v.n")
    return out.unionByName(violations(rows, {"row is valid": F.col(valid)}))


def prediction_rules(rows: DataFrame, model: str, fold: str, key: str, p: str, label: str, n_folds: int) -> DataFrame:
    """``model, rule, n`` of predictions: folds and labels in their domains, probabilities from 0
    to 1, and ids once in a fold."""
    rules = {
        "fold in domain": F.col(fold).between(0, n_folds - 1),
        "probability in range": F.col(p).between(0, 1),
        "label is 0 or 1": F.col(label).isin(0, 1),
    }
    one = rows.groupBy(model).agg(*[F.count_if(F.coalesce(~c, F.lit(True))).alias(k) for k, c in rules.items()])
    each = one.select(model, F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in rules])).alias("v")).select(model, "v.rule", "v.n")
    twice = repeated_keys(rows, [model, fold, key]).groupBy(model).agg(F.count("*").alias("n"))
    models = rows.select(model).distinct().join(twice, model, "left").select(model, F.lit("id is once in a fold").alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
    return each.unionByName(models)


def statistics_rules(stats: DataFrame) -> DataFrame:
    """``rule, n`` of channel statistics ``mean, sd``: finite, and a deviation above 0."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return violations(stats, {"mean is finite": finite("mean"), "sd is finite": finite("sd"), "sd is positive": F.col("sd") > 0})


def negative_rules(rows: DataFrame, key: str, factors: list[str], label: str = "label", times: str = "times", ratios: tuple[str, ...] = ("ratio", "mean_p")) -> DataFrame:
    """``rule, n`` of reliable negatives that have the columns (else an error): ids that are there
    and unique, real factors, label 0, scored at least once, ratios from 0 to 1."""
    require_columns(rows, [key, *factors, label, times, *ratios])
    rules = {"id is there": F.col(key).isNotNull(), "label is 0": F.col(label) == 0, "scored at least once": F.col(times) > 0}
    rules |= {f"{f} is real": is_valid(F.col(f).cast("double")) for f in factors}
    rules |= {f"{r} is from 0 to 1": F.col(r).between(0, 1) for r in ratios}
    twice = repeated_keys(rows.where(F.col(key).isNotNull()), [key]).agg(F.lit("id is unique").alias("rule"), F.count("*").alias("n"))
    return violations(rows, rules).unionByName(twice)


def flat_folds_pass(rows: DataFrame, key: str, group: str, fold: str, label: str, n_folds: int) -> DataFrame:
    """``passed`` and what it is made of: every fold is there and has both classes, ids are in one
    fold, and so are groups."""
    folds = rows.groupBy(fold).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    both = folds.agg(((F.count("*") == n_folds) & F.coalesce(F.bool_and((F.col("p") > 0) & (F.col("q") > 0)), F.lit(False))).alias("folds_whole"))
    ids = repeated_keys(rows, [key]).agg((F.count("*") == 0).alias("ids_once"))
    groups = spread_groups(rows, group, fold).agg((F.count("*") == 0).alias("groups_whole"))
    out = both.join(ids, F.lit(True)).join(groups, F.lit(True))  # one row each
    return out.withColumn("passed", F.col("folds_whole") & F.col("ids_once") & F.col("groups_whole"))


def log_rules(logs: DataFrame, columns: list[str], losses: list[str], epoch: str = "epoch") -> DataFrame:
    """``rule, n`` of training logs that have the columns (else an error): losses that are there,
    finite and not below 0, and epochs from 0 on. A loss of labels 0 and 1 can't be negative."""
    require_columns(logs, columns)
    rules = {"epoch is not negative": F.col(epoch) >= 0}
    for c in losses:
        rules |= {f"{c} is finite": ~F.isnan(c) & (F.abs(c) < float("inf")), f"{c} is not negative": F.col(c) >= 0}
    return violations(logs, rules)


def require_columns(rows: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """``rows`` if they have the columns (``exact``: these, in this order), else an error."""
    if exact and rows.columns != columns:
        raise ValueError(f"columns are {rows.columns}, not {columns}")
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return rows

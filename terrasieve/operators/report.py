"""Roll-ups of fold rows to seeds and methods, comparisons, ranks, logs and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import verdict


def fold_to_method(rows: DataFrame, method: str, seed: str, fold: str, metric: str) -> DataFrame:
    """Folds are averaged to seeds, seeds to methods: a mean of means. A null method is a group
    of its own. The spread over seeds is the sample deviation, null for one seed."""
    folds = rows.groupBy(method, seed, fold).agg(F.avg(metric).alias("m"))
    seeds = folds.groupBy(method, seed).agg(F.avg("m").alias("mean"), F.min("m").alias("worst"), F.max("m").alias("best"), F.count("*").alias("n_folds"))
    return seeds.groupBy(method).agg(
        F.count("*").alias("n_seeds"),
        F.sum("n_folds").alias("n_fold_rows"),
        F.avg("mean").alias("mean_seed"),
        F.stddev_samp("mean").alias("sd_seed"),
        F.stddev_pop("mean").alias("sd_seed_pop"),
        F.min("worst").alias("worst_fold"),
        F.max("best").alias("best_fold"),
    )


def wide_summary(rows: DataFrame, method: str, fold: str, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, median, least and greatest of each metric over folds, and the
    folds where the first metric is worst and best (the lower fold on ties)."""
    folds = rows.groupBy(method, fold).agg(*[F.avg(m).alias(m) for m in metrics])
    stats = [f for m in metrics for f in (F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"sd_{m}"), F.percentile(m, F.lit(0.5)).alias(f"median_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"))]
    worst = F.min(F.struct(metrics[0], fold))[fold].alias("worst_fold_id")
    best = F.min(F.struct((-F.col(metrics[0])).alias("m"), fold))[fold].alias("best_fold_id")
    return folds.groupBy(method).agg(*stats, worst, best)


def against_baseline(summary: DataFrame, method: str, baseline: str, mean: str, sd: str, factor: float) -> DataFrame:
    """Difference of each method to a baseline row, the noise gate (a multiple of the greater
    deviation) and the verdict."""
    base = F.broadcast(summary.where(F.col(method) == baseline).select(F.col(mean).alias("__mean"), F.col(sd).alias("__sd")).limit(1))
    out = summary.join(base, F.lit(True), "left")
    out = out.withColumn("delta", F.col(mean) - F.col("__mean")).withColumn("gate", F.greatest(F.col(sd), F.col("__sd")) * factor)
    return out.withColumn("verdict", verdict(F.col("delta"), F.col("gate"), F.col(method) == baseline)).drop("__mean", "__sd")


def ranks(summary: DataFrame, orders: dict[str, Column]) -> DataFrame:
    """Competition ranks of a summary (a row per method): equal values share the best rank."""
    return summary.select("*", *[F.rank().over(Window.orderBy(c)).alias(f"rank_{name}") for name, c in orders.items()])


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last in order. The greatest row is found by an aggregate, so
    rows are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def still_to_do(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a result; null keys match each other."""
    cond = [jobs[k].eqNullSafe(done[k]) for k in keys]
    return jobs.join(done.select(*keys), cond, "left_anti")


def pivot(rows: DataFrame, index: list[str], column: str, values: list, value: Column) -> DataFrame:
    return rows.groupBy(*index).pivot(column, values).agg(value)


def scaled(summary: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Columns of a summary scaled to [0, 1]; a constant column is 0.5, True inverts."""
    out = []
    for c, invert in columns.items():
        low, high = (f(c).over(Window.partitionBy()) for f in (F.min, F.max))
        v = F.when(high == low, 0.5).otherwise(F.try_divide(F.col(c) - low, high - low))
        out.append((F.when(high == low, 0.5).otherwise(1 - v) if invert else v).alias(f"scaled_{c}"))
    return summary.select("*", *out)


def early_stopping(log: DataFrame, run: str, step: str, score: str, patience: int) -> DataFrame:
    """``run, last_step, best_step, best``: a run ends at its first step that is ``patience``
    steps in a row without a score above the best before it (or at its last step)."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("i", F.row_number().over(w)).withColumn("up", before.isNull() | (F.col(score) > before))
    rows = rows.withColumn("at", F.max(F.when(F.col("up"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("stop", F.min(F.when(F.col("i") - F.col("at") >= patience, F.col("i"))).over(Window.partitionBy(run)))
    ran = rows.where(F.col("stop").isNull() | (F.col("i") <= F.col("stop")))
    return ran.groupBy(run).agg(F.max(step).alias("last_step"), F.max(F.struct(score, (-F.col("i")).alias("i"), step))[step].alias("best_step"), F.max(score).alias("best"))


def job_grid(models: DataFrame, rates: DataFrame, seeds: DataFrame, folds: DataFrame, scratch: str = "scratch") -> DataFrame:
    """Every model, rate, seed and fold; the scratch model has one null rate and comes first."""
    pre = models.where(F.col("model") != scratch).crossJoin(rates)
    own = models.where(F.col("model") == scratch).withColumn("rate", F.lit(None).cast("double"))
    jobs = own.unionByName(pre).crossJoin(seeds).crossJoin(folds)
    order = Window.orderBy((F.col("model") != scratch).cast("int"), "model", F.col("rate").asc_nulls_first(), "seed", "fold")
    return jobs.withColumn("job", F.row_number().over(order))


def guess_lines(rows: DataFrame, groups: list[str], label: str) -> DataFrame:
    """``groups, n_classes, guess_loss, guess_accuracy``: what guessing at random among the classes
    of each group comes to, the line that a model has to beat."""
    n = rows.groupBy(*groups).agg(F.count_distinct(label).alias("n_classes"))
    return n.select("*", F.ln("n_classes").alias("guess_loss"), F.try_divide(F.lit(1.0), F.col("n_classes")).alias("guess_accuracy"))


def efficiency(rows: DataFrame, method: str, fraction: str, metric: str, train_n: str) -> DataFrame:
    """``method, fraction, mean, sd, n, mean_train_n``: what a method reaches with a share of the
    labels (sample deviation over runs)."""
    stats = F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"), F.avg(train_n).alias("mean_train_n")
    return rows.groupBy(method, fraction).agg(*stats)


def reference_row(rows: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """The first row, by order, whose name is the value; no row if there is none."""
    return rows.where(F.col(name) == value).orderBy(order).limit(1)


def count_map(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group, counts``: how often each value is in a group, as a map in the order of values. For
    values of a small domain."""
    each = rows.groupBy(group, value).agg(F.count("*").alias("__n"))
    return each.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "__n")))).alias("counts"))


def coerced_metrics(rows: DataFrame, keys: list[str], rate: str, order: list[str]) -> DataFrame:
    """Fold metrics from files: the rate as a number (null where it is none), and of rows that
    share keys and rate the last."""
    held = rows.withColumn(rate, F.trim(F.col(rate)).try_cast("double"))
    return keep_last(held, [*keys, rate], order)

"""Ranking and classification metrics of scored rows: ``y`` is 0 or 1, ``s`` the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import RANGE_ROWS, running_totals


def by_score(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Positives and negatives of each group and distinct score: what the curves need, and
    already small where scores repeat."""
    return scored.groupBy(*groups, "s").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def roc_auc(scored: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, n_pos, n_neg, auc`` by mid-ranks; null where one class is missing."""
    counted = running_totals(by_score(scored, groups), groups, "s", [], {"below": F.col("neg")})
    # Of the negatives, those below count 1 and those that tie count a half.
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    out = counted.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"))
    return out.select(*groups, "n_pos", "n_neg", F.try_divide("won", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def average_precision(scored: DataFrame, groups: list[str], key: str) -> DataFrame:
    """``groups, ap``: mean over the positives of precision at their place, by score from the top
    and ``key``; null without positives. Where very many rows share a score and keys are numbers,
    rows of one score are counted by ranges of the key, so that no task has to sort them all."""
    most = by_score(scored, groups).agg(F.max(F.col("pos") + F.col("neg"))).first()[0] or 0
    if most > RANGE_ROWS and dict(scored.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        counted = _tied(scored, groups, key)
    else:
        counted = running_totals(scored, groups, "s", [key], {"hits": F.col("y"), "place": F.lit(1)}, descending=True)
    out = counted.groupBy(*groups).agg(F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("place"))).alias("total"), F.sum("y").alias("n"))
    return out.select(*groups, F.try_divide("total", "n").alias("ap"))


def _tied(scored: DataFrame, groups: list[str], key: str) -> DataFrame:
    """``groups, y, hits, place``: what comes before a score, and by key within it."""
    before = running_totals(by_score(scored, groups), groups, "s", [], {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}, descending=True)
    names = [*groups, "s"]
    before = before.select(*[F.col(c).alias(f"__{c}") for c in names], (F.col("tp") - F.col("pos")).alias("__tp"), (F.col("n") - F.col("pos") - F.col("neg")).alias("__n"))
    inner = running_totals(scored, names, key, [], {"hits": F.col("y"), "place": F.lit(1)})
    held = inner.join(before, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    return held.select(*groups, "y", (F.col("hits") + F.col("__tp")).alias("hits"), (F.col("place") + F.col("__n")).alias("place"))


def _curve(scored: DataFrame, groups: list[str]) -> DataFrame:
    counted = running_totals(by_score(scored, groups), groups, "s", [], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    total = scored.groupBy(*groups).agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    cond = [counted[g].eqNullSafe(total[g]) for g in groups]
    return counted.join(total, cond).select(*[counted[g] for g in groups], "s", "tp", "fp", "n_pos", "n_neg")


def roc_points(scored: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, kind, threshold, tpr, fpr``: a point per distinct score, and the two ends
    (``kind`` none and all), whose thresholds are null."""
    inner = _curve(scored, groups).select(*groups, F.lit("score").alias("kind"), F.col("s").alias("threshold"), F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0)).alias("tpr"), F.coalesce(F.try_divide("fp", "n_neg"), F.lit(0.0)).alias("fpr"))
    ends = scored.select(*groups).distinct()
    for kind, value in (("none", 0.0), ("all", 1.0)):
        inner = inner.unionByName(ends.select(*groups, F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("threshold"), F.lit(value).alias("tpr"), F.lit(value).alias("fpr")))
    return inner


def pr_points(scored: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, kind, threshold, precision, recall``; nothing predicted has precision 1."""
    inner = _curve(scored, groups).select(*groups, F.lit("score").alias("kind"), F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0)).alias("recall"))
    ends = scored.select(*groups).distinct()
    return inner.unionByName(ends.select(*groups, F.lit("none").alias("kind"), F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def confusion_columns(y: Column, predicted: Column) -> dict[str, Column]:
    one = lambda a, b: F.count_if((y == a) & (predicted == b))
    return {"tn": one(0, 0), "fp": one(0, 1), "fn": one(1, 0), "tp": one(1, 1)}


def confusion(scored: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    """Counts at a threshold; a score equal to it is predicted positive."""
    predicted = (F.col("s") >= threshold).cast("int")
    return scored.groupBy(*groups).agg(*[c.alias(k) for k, c in confusion_columns(F.col("y"), predicted).items()])


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from counts; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in (tp, fp, fn, tn))
    return {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def binary_metrics(scored: DataFrame, groups: list[str], key: str, threshold: float) -> DataFrame:
    counts = confusion(scored, groups, threshold).select(*groups, "tn", "fp", "fn", "tp", *[c.alias(k) for k, c in rates().items()])
    return counts.join(roc_auc(scored, groups).select(*groups, "auc"), groups).join(average_precision(scored, groups, key), groups)


def best_f1(scored: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, threshold, f1``: of the distinct scores, 0, 0.5 and 1 the threshold of greatest
    F1, the one closest to 0.5 of those within 1e-8 or so (then the lower one); 0.5 and null for
    one class."""
    ends = scored.groupBy(*groups).agg(F.sum("y").cast("long").alias("n_pos"), F.count("*").alias("n"))
    extra = ends.select(*groups, F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("s"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    counts = by_score(scored, groups).unionByName(extra).groupBy(*groups, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    curve = running_totals(counts, groups, "s", [], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True).join(ends, groups)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), F.lit(0.0))
    curve = curve.select(*groups, "s", "n_pos", "n", F.round(f1, 8).alias("f1"))
    best = curve.groupBy(*groups, "n_pos", "n").agg(F.max(F.struct("f1", -F.abs(F.col("s") - 0.5), (-F.col("s")).alias("low"))).alias("b"))
    one = (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n"))
    return best.select(*groups, F.when(one, 0.5).otherwise(-F.col("b.low")).alias("threshold"), F.when(~one, F.col("b.f1")).alias("f1"))


def top_k_accuracy(logits: DataFrame, item: str, label: str, target: str, logit: str, ks: tuple[int, ...]) -> DataFrame:
    """``k, accuracy``: how often the target is among the k greatest logits (ties: lower class)."""
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(logit), label))
    hits = logits.withColumn("place", place).where(F.col(label) == F.col(target))
    wide = hits.agg(*[F.avg((F.col("place") <= k).cast("double")).alias(str(k)) for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("accuracy")) for k in ks])).alias("r")).select("r.k", "r.accuracy")


def normalised_confusion(pairs: DataFrame, true: str, predicted: str, classes: int) -> DataFrame:
    """``true, predicted, n, share``: the most frequent classes, shares of each true class."""
    top = pairs.groupBy(true).count().orderBy(F.desc("count"), true).limit(classes).select(F.col(true).alias("c"))
    known = F.broadcast(top)  # one row per class asked for
    grid = top.select(F.col("c").alias(true)).crossJoin(F.broadcast(top.select(F.col("c").alias(predicted))))
    seen = pairs.join(known, pairs[true] == known["c"]).drop("c").groupBy(true, predicted).agg(F.count("*").alias("n"))
    full = grid.join(seen, [true, predicted], "left").na.fill({"n": 0})
    total = F.sum("n").over(Window.partitionBy(true))
    return full.select(true, predicted, "n", F.coalesce(F.try_divide("n", total), F.lit(0.0)).alias("share"))


def fixed_confusion(pairs: DataFrame, true: str, predicted: str, classes: list) -> DataFrame:
    """``true, predicted, n, share`` for given classes, whether they occur or not: shares of each
    true class, 0 for one without rows. Other classes are left out."""
    listed = F.array(*[F.lit(c) for c in classes])
    grid = pairs.sparkSession.range(1).select(F.explode(listed).alias(true)).select(true, F.explode(listed).alias(predicted))
    seen = pairs.where(F.col(true).isin(classes) & F.col(predicted).isin(classes)).groupBy(true, predicted).agg(F.count("*").alias("n"))
    full = grid.join(seen, [true, predicted], "left").na.fill({"n": 0})
    return full.select(true, predicted, "n", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(true))), F.lit(0.0)).alias("share"))

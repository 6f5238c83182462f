"""Quality of predictions, overall and by group, and comparisons of classes.

Predictions are rows with a 0/1 ``label`` and a probability ``p``. Everything is
a few grouped sums; nothing is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions.arrays import lit

BINS = 1024


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = A.ratio(tp, tp + fp), A.ratio(tp, tp + fn)
    return {
        "accuracy": A.ratio(tp + tn, n), "precision": precision, "recall": recall, "f1": A.ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": A.ratio(fp, fp + tn), "false_negative_rate": A.ratio(fn, fn + tp),
        "sure_share": A.ratio(F.col("sure"), n), "sure_accuracy": A.ratio(F.col("sure_right"), F.col("sure")),
    }


def _sums(threshold: float, sure: tuple[float, float]) -> list[Column]:
    said, is_ = F.col("p") >= threshold, F.col("label") == 1
    certain = (F.col("p") >= sure[1]) | (F.col("p") <= sure[0])
    return [
        F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn"), F.count_if(~said & ~is_).alias("tn"),
        F.count_if(certain).alias("sure"), F.count_if(certain & (said == is_)).alias("sure_right"),
    ]


def metrics(predictions: DataFrame, threshold: float = 0.5, sure: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """One row of counts and rates. An empty table has counts and rates of 0."""
    m = predictions.agg(*_sums(threshold, sure))
    return m.select("tp", "fp", "fn", "tn", *[v.alias(k) for k, v in _rates().items()])


def metrics_by(predictions: DataFrame, columns: list[str], least: int = 1, threshold: float = 0.5, sure: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """Counts and rates by each column on its own, and overall, in one pass.

    ``breakdown`` names the column, ``value`` its value; overall rows have
    ``all``. Groups of fewer than ``least`` rows are left out.
    """
    sums = _sums(threshold, sure)
    keyed = predictions.select("label", "p", F.explode(F.array(F.struct(F.lit("all").alias("breakdown"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("breakdown"), F.col(c).cast("string").alias("value")) for c in columns])).alias("k"))
    m = keyed.select("label", "p", "k.*").groupBy("breakdown", "value").agg(*sums).filter(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= least)
    return m.select("breakdown", "value", "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in _rates().items()])


def length_class(words: Column) -> Column:
    return F.when(words < 50, "short").when(words < 200, "medium").otherwise("long")


def auc(predictions: DataFrame) -> DataFrame:
    """Area under the curve: the share of pairs in order, ties counting half.

    Probabilities are summed up by bins first, so that ranks within a bin are all that a
    task needs; 0.5 without both classes.
    """
    p = predictions.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    p = p.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int"))
    bins = p.groupBy("bin").agg(F.sum("neg").alias("n"))  # BINS rows
    below = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("lower", inside).join(F.broadcast(below), "bin")  # BINS rows
    won = F.sum(F.col("pos") * (F.col("below") + F.col("lower") + F.col("neg") / 2))
    out = p.agg(won.alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select(A.ratio(F.col("w"), F.col("pos") * F.col("neg"), 0.5).alias("auc"), F.coalesce("pos", F.lit(0)).alias("n_positive"), F.coalesce("neg", F.lit(0)).alias("n_negative"))


def best_weights(predictions: DataFrame, first: str, second: str, steps: int = 10) -> DataFrame:
    """The F1 of each weighting of two probabilities, the best one marked."""
    w = F.explode(F.array(*[lit(k / steps) for k in range(1, steps)]))
    q = predictions.select("label", F.col(first).alias("a"), F.col(second).alias("b"), w.alias("weight"))
    q = q.select("weight", "label", (F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b")).alias("p")).groupBy("weight").agg(*_sums(0.5, (0.2, 0.8)))
    q = q.select("weight", _rates()["f1"].alias("f1"))
    best = q.agg(F.max_by("weight", F.struct("f1", -F.col("weight"))).alias("best"))  # a row by weighting
    return q.crossJoin(F.broadcast(best)).select("weight", "f1", (F.col("weight") == F.col("best")).alias("is_best"))


def disagreements(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """Rows on which two probabilities decide differently, and which of them is right."""
    a, b = F.col(first) >= 0.5, F.col(second) >= 0.5
    return predictions.filter(a != b).withColumns({"first_right": a == (F.col("label") == 1), "second_right": b == (F.col("label") == 1)})


def compare_classes(features: DataFrame, names: list[str]) -> DataFrame:
    """Means of each feature by label, effect size, and Welch's t with a stepped p-value."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])
    g = features.select("label", F.inline(rows)).groupBy("feature").agg(
        *[f(F.when(F.col("label") == k, F.col("x"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))]
    )
    diff, pooled = F.col("m0") - F.col("m1"), F.sqrt((F.col("v0") + F.col("v1")) / 2)
    se = F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    t = F.when((F.col("n0") > 0) & (F.col("n1") > 0) & (se > 0), diff / se).otherwise(lit(0))
    d = F.when(pooled > 0, diff / pooled).otherwise(lit(0))
    p = F.when(F.abs(t) > 10, lit(0.0001)).when(F.abs(t) > 5, lit(0.001)).when(F.abs(t) > 3, lit(0.01)).when(F.abs(t) > 2, lit(0.05)).otherwise(lit(0.1))
    return g.select("feature", F.col("m0").alias("mean_0"), F.col("m1").alias("mean_1"), F.col("n0").alias("n_0"), F.col("n1").alias("n_1"), d.alias("effect"), t.alias("t"), p.alias("p_value"))

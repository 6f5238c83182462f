"""Calibration of probabilities by isotonic regression over bins.

Scores are summed up by bins of equal width, so that any number of rows becomes at
most BINS of these. The fitted share of a bin is the greatest of the least means
that runs of bins around it have, which pooling neighbours in the wrong order gives as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions.arrays import lit

BINS = 50


def bin_of(p: Column, bins: int = BINS) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(p * bins))).cast("int")


def fit_isotonic(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """``bin``, ``n``, ``positive``, ``centre`` (mean score), ``observed`` and ``calibrated``
    shares of label 1, which never fall from bin to bin. Empty bins have no row;
    rows without a score or a label don't take part."""
    known = predictions.filter(F.col("p").isNotNull() & ~F.isnan("p") & F.col("label").isin(0, 1))
    b = known.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positive"), F.avg("p").alias("centre"))
    # One row with at most ``bins`` elements, whatever the number of rows.
    a = b.agg(F.sort_array(F.collect_list(F.struct("bin", "n", "positive", "centre"))).alias("b"))
    upto = lambda k: F.transform(F.sequence(F.lit(0), F.size("b")), lambda i: A.total_by(F.slice("b", 1, i), lambda x: x[k]))
    a = a.filter(F.size("b") > 0).withColumns({"n": upto("n"), "y": upto("positive")})
    mean = lambda j, k: (F.get("y", k + 1) - F.get("y", j)) / (F.get("n", k + 1) - F.get("n", j))

    def fitted(i: Column) -> Column:
        least = lambda j: F.array_min(F.transform(F.sequence(i, F.size("b") - 1), lambda k: mean(j, k)))
        return F.array_max(F.transform(F.sequence(F.lit(0), i), least))

    a = A.fenced(a.select(F.transform("b", lambda x, i: F.struct(x["bin"].alias("bin"), x["n"].alias("n"), x["positive"].alias("positive"), x["centre"].alias("centre"), (x["positive"] / x["n"]).alias("observed"), fitted(i).alias("calibrated"))).alias("c")))
    return a.select(F.inline("c"))


def calibrated(scores: DataFrame, fit: DataFrame, p_col: str = "p") -> DataFrame:
    """``scores`` with ``calibrated``: on the line between the neighbouring bins' means,
    level beyond the outermost; null without a score or a fit."""
    knots = F.sort_array(F.collect_list(F.struct(F.col("centre").alias("x"), F.col("calibrated").alias("y"))))
    k = F.broadcast(fit.agg(knots.alias("_knots")))  # a row of at most BINS knots
    p = F.col(p_col)
    low = F.element_at(F.filter("_knots", lambda v: v["x"] <= p), -1)
    high = F.get(F.filter("_knots", lambda v: v["x"] > p), 0)
    between = low["y"] + (p - low["x"]) / (high["x"] - low["x"]) * (high["y"] - low["y"])
    out = F.when(p.isNull() | F.isnan(p) | (F.size("_knots") == 0), lit(float("nan"))).when(F.exists("_knots", lambda v: v["x"] <= p), F.when(F.exists("_knots", lambda v: v["x"] > p), between).otherwise(low["y"])).otherwise(F.get("_knots", 0)["y"])
    return scores.join(k).withColumn("calibrated", F.nullif(out, lit(float("nan")))).drop("_knots")

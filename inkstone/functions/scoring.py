"""Scores and probabilities as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.arrays import lit


class Baseline(NamedTuple):
    mean: float
    std: float
    low: float
    high: float


#: What is usual in human writing (fixed values).
BASELINES = {
    "sentence_length_cv": Baseline(0.55, 0.15, 0.25, 0.85),
    "hapax_ratio": Baseline(0.48, 0.08, 0.30, 0.65),
    "burstiness": Baseline(0.15, 0.12, -0.10, 0.40),
    "zipf_slope": Baseline(-1.0, 0.15, -1.3, -0.7),
    "ttr_normalized": Baseline(0.42, 0.10, 0.25, 0.60),
    "sentence_entropy": Baseline(2.8, 0.4, 1.8, 3.8),
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(lit(low), F.least(lit(high), x))


def normalize(x: Column, low: float, high: float) -> Column:
    """Place of x between low and high, from 0 to 1; a half if they are equal."""
    return lit(0.5) if low == high else clamp((x - lit(low)) / lit(high - low))


def gaussian(x: Column, mean: float, std: float) -> Column:
    z = (x - lit(mean)) / lit(std)
    return F.exp(-z * z / 2)


def range_penalty(x: Column, b: Baseline) -> Column:
    over = F.when(x < b.low, (lit(b.low) - x) / lit(2 * b.std)).when(x > b.high, (x - lit(b.high)) / lit(2 * b.std)).otherwise(lit(0))
    return F.least(lit(1), over)


def human_likelihood(x: Column, b: Baseline) -> Column:
    """Near the mean is likely; outside the range either way is penalised."""
    return gaussian(x, b.mean, b.std) * (1 - range_penalty(x, b) * 0.5)


def z_score(x: Column, mean: float, std: float) -> Column:
    return lit(0) if std == 0 else (x - lit(mean)) / lit(std)


def sigmoid(x: Column, k: float = 1.0, middle: float = 0.5) -> Column:
    return 1 / (1 + F.exp(lit(-k) * (x - lit(middle))))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the score interval."""
    n = F.greatest(lit(1), n)
    below = 1 + lit(z * z) / n
    center = (p + lit(z * z) / (2 * n)) / below
    margin = lit(z) * F.sqrt((p * (1 - p) + lit(z * z) / (4 * n)) / n) / below
    return F.greatest(lit(0), center - margin), F.least(lit(1), center + margin)


def ladder(x: Column, steps: list[tuple[float, object]], last) -> Column:
    """The value of the first step whose bound lies above x."""
    out = F
    for bound, value in steps:
        out = out.when(x < lit(bound), F.lit(value))
    return out.otherwise(F.lit(last))


def verdict_label(p: Column) -> Column:
    return ladder(p, [(0.2, "Human"), (0.35, "Probably Human"), (0.5, "Possibly Mixed"), (0.65, "Possibly AI"), (0.8, "Probably AI")], "AI")


def verdict_confidence(p: Column) -> Column:
    return ladder(p, [(0.2, "high"), (0.35, "moderate"), (0.65, "low"), (0.8, "moderate")], "high")


def probability_band(p: Column) -> Column:
    return ladder(p, [(0.15, "very-low"), (0.30, "low"), (0.45, "moderate-low"), (0.55, "uncertain"), (0.70, "moderate-high"), (0.85, "high")], "very-high")


def length_factor(words: Column) -> Column:
    return ladder(words, [(20, 0.3), (50, 0.5), (100, 0.7), (200, 0.85), (500, 0.95)], 1.0)


def combine_log_odds(ps: list[Column], weights: list[float]) -> Column:
    """Weighted mean of log odds, as a probability."""
    total = sum(weights)
    s = lit(0)
    for p, w in zip(ps, weights):
        q = clamp(p, 0.001, 0.999)
        s = s + F.log(q / (1 - q)) * lit(w)
    return 1 / (1 + F.exp(-s / lit(total)))


#: Raw and calibrated probabilities, joined by straight lines (fixed values).
KNOTS = ((0.0, 0.05), (0.2, 0.15), (0.4, 0.35), (0.5, 0.50), (0.6, 0.65), (0.8, 0.85), (1.0, 0.95))


def calibrate(p: Column, knots=KNOTS) -> Column:
    out = F
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when((p >= lit(x0)) & (p <= lit(x1)), lit(y0) + (p - lit(x0)) / lit(x1 - x0) * lit(y1 - y0))
    return out.otherwise(p)


def platt(x: Column, a: float = 1.0, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(lit(a) * x + lit(b))))

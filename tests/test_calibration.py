"""Isotonic calibration against pooling adjacent violators."""

import random

import pytest

from inkstone.operators import calibration


def pooled(bins):
    """Blocks of bins in order, joined while a later one's mean is lower."""
    out = []
    for _, n, y in bins:
        out.append([n, y, 1])
        while len(out) > 1 and out[-2][1] / out[-2][0] > out[-1][1] / out[-1][0]:
            n2, y2, k2 = out.pop()
            out[-1] = [out[-1][0] + n2, out[-1][1] + y2, out[-1][2] + k2]
    return [y / n for n, y, k in out for _ in range(k)]


def test_bins_are_pooled_and_scores_put_on_the_line(spark):
    r = random.Random(4)
    rows = [(p, int(r.random() < p * p)) for p in (r.random() for _ in range(900))] + [(1.0, 1), (0.0, 0), (None, 1), (float("nan"), 1), (0.5, None), (0.5, 7)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "p double, label int, n int")
    fit = calibration.fit_isotonic(df)
    got = sorted(fit.collect(), key=lambda x: x["bin"])
    assert sum(x["n"] for x in got) == 902
    assert [x["calibrated"] for x in got] == pytest.approx(pooled([(x["bin"], x["n"], x["positive"]) for x in got]))
    assert len({x["calibrated"] for x in got}) < len(got)
    a, b = got[10], got[11]
    mid = (a["centre"] + b["centre"]) / 2
    scores = spark.createDataFrame([(0, mid), (1, -1.0), (2, 2.0), (3, None), (4, float("nan"))], "i int, p double")
    out = {x["i"]: x["calibrated"] for x in calibration.calibrated(scores, fit).collect()}
    assert out[0] == pytest.approx((a["calibrated"] + b["calibrated"]) / 2) and out[1] == got[0]["calibrated"] and out[2] == got[-1]["calibrated"]
    assert out[3] is None and out[4] is None


def test_without_rows(spark):
    df = spark.createDataFrame([], "p double, label int")
    assert calibration.fit_isotonic(df).collect() == []
    assert [x["calibrated"] for x in calibration.calibrated(spark.createDataFrame([(0.5,)], "p double"), calibration.fit_isotonic(df)).collect()] == [None]

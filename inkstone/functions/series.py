"""Statistics of sequences of words and numbers, within a row.

Positions or pairs are sorted by word, so that what belongs to a word stands
together, and one pass over the array gives the statistic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions.arrays import lit

STEP = 50  # words between the points of a growth curve


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def fit(points: Column) -> Column:
    """Sums of a straight-line fit: n, x, y, xy, xx, yy."""
    zero = F.struct(*[A.zero().alias(k) for k in ("n", "x", "y", "xy", "xx", "yy")])
    return F.aggregate(
        points,
        zero,
        lambda a, p: F.struct(
            (a["n"] + 1).alias("n"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"),
            (a["xy"] + p["x"] * p["y"]).alias("xy"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["yy"] + p["y"] * p["y"]).alias("yy"),
        ),
    )


def exact_std(a: Column) -> Column:
    """Population deviation of whole numbers from exact sums; 0 if empty."""
    n, s, q = A.size(a), A.total(a), A.total_by(a, lambda x: x.cast("double") * x)
    return A.ratio(F.sqrt(n * q - s * s), n)


def exact_skewness(a: Column, m: Column, std: Column) -> Column:
    """Adjusted skewness; 0 for fewer than three values or without deviation."""
    n = A.size(a)
    cubes = A.total_by(a, lambda x: F.pow((x - m) / std, lit(3)))
    return F.when((F.size(a) >= 3) & (std > 0), cubes * n / ((n - 1) * (n - 2))).otherwise(lit(0))


def placed(tokens: Column) -> Column:
    """Words with their positions from 0, sorted by word."""
    return F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))


def sorted_grams(tokens: Column, n: int) -> Column:
    """Runs of n words and their places from 0 (``g``, ``i``), sorted. Strings that end in the
    place are sorted, which costs far less than structs; no word holds the sign between."""
    marked = F.transform(A.ngrams(tokens, n), lambda g, i: F.concat(g, F.lit("\u0000"), F.lpad(i.cast("string"), 10, "0")))
    return F.transform(F.sort_array(marked), lambda x: F.struct(F.substring_index(x, "\u0000", 1).alias("g"), F.right(x, F.lit(10)).cast("int").alias("i")))


def returns(p: Column) -> Column:
    """Of ``placed`` words: the gap to the word's next place, null at its last."""
    return F.zip_with(p, A.shifted(p), lambda x, y: F.when(x["w"] == y["w"], y["i"] - x["i"]))


def burstiness_of_returns(gaps: Column) -> Column:
    """Mean over the words that return of (deviation - mean) / (deviation + mean) of their gaps."""
    names = ("k", "s", "q", "total", "words")

    def end(a: Column) -> Column:
        mean, std = a["s"] / a["k"], F.sqrt(a["k"] * a["q"] - a["s"] * a["s"]) / a["k"]
        back = a["k"] > 0
        total = a["total"] + F.when(back, (std - mean) / (std + mean)).otherwise(lit(0))
        return F.struct(*[A.zero().alias(x) for x in names[:3]], total.alias("total"), (a["words"] + back.cast("double")).alias("words"))

    def step(a: Column, g: Column) -> Column:
        more = F.struct((a["k"] + 1).alias("k"), (a["s"] + g).alias("s"), (a["q"] + g.cast("double") * g).alias("q"), a["total"].alias("total"), a["words"].alias("words"))
        return F.when(g.isNull(), end(a)).otherwise(more)

    return F.aggregate(gaps, F.struct(*[A.zero().alias(x) for x in names]), step, lambda a: A.ratio(a["total"], a["words"]))


def transitions(tokens: Column) -> Column:
    """Ends of runs among the sorted pairs of neighbours: 0 where the same pair
    follows, 1 where another one of the same first word does, 2 otherwise."""
    pairs = F.sort_array(A.lagged_pairs(tokens, lambda x, y: F.struct(x.alias("a"), y.alias("b"))))
    return F.zip_with(pairs, A.shifted(pairs), lambda x, y: F.when(y.isNull() | (x["a"] != y["a"]), 2).when(x["b"] != y["b"], 1).otherwise(0))


def pair_ends(pairs: Column, firsts: Column) -> Column:
    """``transitions`` of sorted pairs joined by a space, which sorts before all signs of words, and their first words."""
    last = lambda i: F.get(firsts, i + 1).isNull() | (F.get(firsts, i + 1) != F.get(firsts, i))
    return F.transform(pairs, lambda x, i: F.when(last(i), 2).when(F.get(pairs, i + 1) != x, 1).otherwise(0))


def words_of_pairs(ends: Column) -> Column:
    """Where each first word's pairs begin and end (``a``, ``b``) among sorted ones, from their ``transitions``."""
    at = F.filter(F.transform(ends, lambda e, i: F.when(e == 2, i + 1)), lambda i: i.isNotNull())
    return A.let(at, lambda at: F.transform(at, lambda b, j: F.struct(F.coalesce(F.get(at, j - 1), F.lit(0)).alias("a"), b.alias("b"))))


def transition_sums(ends: Column) -> Column:
    """``pairs``: sum over distinct pairs of count times its logarithm;
    ``bits``: sum over first words of the entropy of what follows; ``states``: first words."""
    names = ("c", "t", "own", "pairs", "bits", "states")

    def step(a: Column, e: Column) -> Column:
        c, t = a["c"] + 1, a["t"] + 1
        x = F.when(e > 0, c * F.log2(c)).otherwise(lit(0))
        own, last = a["own"] + x, e == 2
        none = lit(0)
        return F.struct(
            F.when(e > 0, none).otherwise(c).alias("c"), F.when(last, none).otherwise(t).alias("t"), F.when(last, none).otherwise(own).alias("own"),
            (a["pairs"] + x).alias("pairs"), (a["bits"] + F.when(last, F.log2(t) - own / t).otherwise(none)).alias("bits"), (a["states"] + last.cast("double")).alias("states"),
        )

    return F.aggregate(ends, F.struct(*[A.zero().alias(x) for x in names]), step)


def growth(p: Column, n: Column) -> Column:
    """Points ``position``, ``n_types`` after every STEP words and at the end.

    First places and points are sorted together: a point's rank less the points
    before it is the number of words seen by then."""
    before = F.concat(F.array(_none("string")), F.transform(p, lambda x: x["w"]))
    firsts = F.zip_with(p, before, lambda x, w: F.when(w.isNull() | (w != x["w"]), F.struct((x["i"] + 1).alias("p"), F.lit(0).alias("k"))))
    firsts = F.filter(firsts, lambda x: x["p"].isNotNull())
    points = F.when(n > 0, F.array_distinct(F.concat(F.when(n >= STEP, F.sequence(F.lit(STEP), n, F.lit(STEP))).otherwise(F.array().cast("array<int>")), F.array(n)))).otherwise(F.array().cast("array<int>"))
    both = F.sort_array(F.concat(firsts, F.transform(points, lambda x: F.struct(x.alias("p"), F.lit(1).alias("k")))))
    marks = F.filter(F.transform(both, lambda x, j: F.struct(x["p"].alias("p"), x["k"].alias("k"), j.alias("j"))), lambda x: x["k"] == 1)
    return F.transform(marks, lambda m, c: F.struct(m["p"].alias("position"), (m["j"] - c).alias("n_types")))


def fit_logs(points: Column) -> Column:
    """``fit`` of pairs x, y of numbers, in natural logarithms."""
    return fit(F.transform(points, lambda p: F.struct(F.log(p["x"].cast("double")).alias("x"), F.log(p["y"].cast("double")).alias("y"))))


def slope(f: Column) -> Column:
    return (f["n"] * f["xy"] - f["x"] * f["y"]) / (f["n"] * f["xx"] - f["x"] * f["x"])


def reach(a: Column, n: Column, s: Column) -> Column:
    """n times the range of the running sums of deviations, of n whole numbers with sum s."""
    zero = F.struct(lit(0).alias("c"), lit(float("-inf")).alias("high"), lit(float("inf")).alias("low"))

    def step(acc: Column, x: Column) -> Column:
        c = acc["c"] + n * x - s
        return F.struct(c.alias("c"), F.greatest(acc["high"], c).alias("high"), F.least(acc["low"], c).alias("low"))

    return F.aggregate(a, zero, step, lambda acc: acc["high"] - acc["low"])

"""Statistics of one row's array, as column expressions.

Nothing here explodes or shuffles: a document's statistics stay in its row.
Arrays that an expression needs several times should be columns of their own, so
that they are computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def zero() -> Column:
    return F.lit(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, zero(), lambda acc, x: acc + x.cast("double"))


def total_by(a: Column, f) -> Column:
    return F.aggregate(a, zero(), lambda acc, x: acc + f(x).cast("double"))


def size(a: Column) -> Column:
    return F.size(a).cast("double")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(lit(otherwise))


def mean(a: Column) -> Column:
    return ratio(total(a), size(a))


def moment(a: Column, k: int) -> Column:
    """Central moment of order k, over n; 0 for an empty array."""
    def pick(acc):
        m = acc["s"] / acc["n"]
        if k == 2:
            raw = acc["s2"] / acc["n"] - m * m
        elif k == 3:
            raw = acc["s3"] / acc["n"] - lit(3) * m * acc["s2"] / acc["n"] + lit(2) * m * m * m
        else:
            raw = acc["s4"] / acc["n"] - lit(4) * m * acc["s3"] / acc["n"] + lit(6) * m * m * acc["s2"] / acc["n"] - lit(3) * m * m * m * m
        return F.when(acc["n"] > 0, raw).otherwise(zero())

    start = F.struct(zero().alias("n"), zero().alias("s"), zero().alias("s2"), zero().alias("s3"), zero().alias("s4"))

    def step(acc, x):
        d = x.cast("double")
        return F.struct((acc["n"] + 1).alias("n"), (acc["s"] + d).alias("s"), (acc["s2"] + d * d).alias("s2"), (acc["s3"] + d * d * d).alias("s3"), (acc["s4"] + d * d * d * d).alias("s4"))

    return F.aggregate(a, start, step, pick)


def var_pop(a: Column) -> Column:
    """Population variance; tiny negative rounding is cut to 0."""
    return F.greatest(zero(), moment(a, 2))


def std_pop(a: Column) -> Column:
    return F.sqrt(var_pop(a))


def cv(a: Column) -> Column:
    """Coefficient of variation, 0 for fewer than two values or a zero mean."""
    return F.when(F.size(a) >= 2, ratio(std_pop(a), mean(a))).otherwise(zero())


def burstiness(a: Column) -> Column:
    s, m = std_pop(a), mean(a)
    return F.when(F.size(a) >= 2, ratio(s - m, s + m)).otherwise(zero())


def uniformity(a: Column) -> Column:
    return F.when(F.size(a) >= 2, lit(1) - F.least(lit(1), cv(a) / lit(0.8))).otherwise(lit(0.5))


def shifted(a: Column, by: int = 1) -> Column:
    """a from its element ``by`` on."""
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def head(a: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def lagged_pairs(a: Column, f, by: int = 1) -> Column:
    """f(earlier, later) for all elements ``by`` apart."""
    return F.zip_with(head(a, F.size(a) - by), shifted(a, by), f)


def with_run_counts(df: DataFrame, **of: str) -> DataFrame:
    """Adds columns with the counts of the distinct values of array columns.

    Each step is a projection of its own: an array that is sorted or compared
    in one expression would be sorted again for each use of it.
    """
    df = df.withColumns({f"_s_{k}": F.sort_array(c) for k, c in of.items()})

    def ends(s: Column) -> Column:
        same = F.zip_with(shifted(s), s, lambda y, x: y.isNull() | (x != y))
        return F.filter(F.transform(same, lambda end, i: F.when(end, i + 1)), lambda p: p.isNotNull())

    df = df.withColumns({f"_e_{k}": ends(F.col(f"_s_{k}")) for k in of})
    df = df.withColumns({k: F.zip_with(F.col(f"_e_{k}"), F.concat(F.array(F.lit(0)), F.col(f"_e_{k}")), lambda x, y: x - y) for k in of})
    df = df.withColumns({k: F.filter(k, lambda c: c.isNotNull()) for k in of})
    return df.drop(*[f"_{x}_{k}" for k in of for x in "se"])


def run_ends(s: Column, key: str) -> Column:
    """Where runs of equal keys in a sorted array of structs end, from 1."""
    same = F.zip_with(shifted(s), s, lambda y, x: y.isNull() | (x[key] != y[key]))
    return F.filter(F.transform(same, lambda end, i: F.when(end, i + 1)), lambda p: p.isNotNull())


def runs(s: Column, ends: Column, f) -> Column:
    """f(first element, length) of each run; ``ends`` should be a column of its own."""
    before = F.concat(F.array(F.lit(0)), ends)
    return F.filter(F.zip_with(before, ends, lambda a, b: F.when(b.isNotNull(), f(F.get(s, a), b - a))), lambda x: x.isNotNull())


def fenced(df: DataFrame) -> DataFrame:
    """The same rows, of which a later filter is not moved below this point.

    The optimizer moves filters through projections by putting the columns'
    expressions in their place, which would compute a long chain of statistics
    once more for every mention of each step.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once. An expression that a lambda mentions
    is otherwise computed again for each element the lambda sees."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entropy_bits(counts: Column, n: Column) -> Column:
    """Shannon entropy of counts that sum to n."""
    return let(n, lambda n: -total_by(F.filter(counts, lambda c: c > 0), lambda c: (c / n) * F.log2(c / n)))


def percentile(a: Column, p: float) -> Column:
    """Linear interpolation between the order statistics; 0 if empty."""
    s = F.sort_array(a)
    at = lit(p / 100) * (size(a) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    x, y = F.get(s, low).cast("double"), F.get(s, high).cast("double")
    return F.when(F.size(a) > 0, F.when(low == high, x).otherwise(x * (high - at) + y * (at - low))).otherwise(zero())


def skewness(a: Column) -> Column:
    """Adjusted coefficient over the population deviation; 0 below three values."""
    n, s = size(a), std_pop(a)
    return F.when((F.size(a) >= 3) & (s > 0), n / ((n - 1) * (n - 2)) * n * moment(a, 3) / (s * s * s)).otherwise(zero())


def kurtosis(a: Column) -> Column:
    """Adjusted excess coefficient over the population deviation; 0 below four values."""
    n, v = size(a), var_pop(a)
    z4 = n * moment(a, 4) / (v * v)
    return F.when((F.size(a) >= 4) & (v > 0), n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * z4 - lit(3) * (n - 1) * (n - 1) / ((n - 2) * (n - 3))).otherwise(zero())


def gini(a: Column) -> Column:
    s = let(size(a), lambda n: F.transform(F.sort_array(a), lambda x, i: (lit(2) * (i + 1) - n - 1) * x))
    return ratio(total(s), size(a) * total(a))


#: Values of a block of running sums; each is copied as often as its block is long at most.
BLOCK = 64


def running(a: Column) -> Column:
    """Sums of the first 0, 1, 2, ... values: of blocks first, then of what is before each block."""
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    inner = F.transform(starts, lambda i: F.aggregate(F.slice(a, i, BLOCK), F.array(zero()), lambda acc, x: append(acc, x.cast("double"))))

    def joined(inner: Column) -> Column:
        before = F.aggregate(inner, F.array(zero()), lambda acc, b: append(acc, F.element_at(b, -1)))
        return let(before, lambda s: F.flatten(F.transform(inner, lambda b, j: F.transform(F.slice(b, 2, BLOCK), lambda x: x + F.get(s, j)))))

    return F.concat(F.array(zero()), let(inner, joined))


def window_variances(a: Column, w: int) -> Column:
    """Population variance of each complete window of w values."""
    starts = F.when(F.size(a) >= w, F.sequence(F.lit(1), F.size(a) - (w - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: var_pop(F.slice(a, i, w)))


def autocorrelation(a: Column, m: Column, v: Column, lag: int) -> Column:
    """Of values with mean m and variance v; 0 where undefined."""
    products = lagged_pairs(a, lambda x, y: (x - m) * (y - m), lag)
    return F.when((F.size(a) > lag) & (v > 0), total(products) / (size(a) * v)).otherwise(zero())


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces."""
    out = tokens
    for k in range(1, n):
        out = F.zip_with(head(out, F.size(tokens) - k), shifted(tokens, k), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(F.size(tokens) >= n, out).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeated values."""
    return let(F.size(F.array_intersect(a, b)), lambda n: ratio(n.cast("double"), (F.size(a) + F.size(b) - n).cast("double")))


def times_in(a: Column, x: Column) -> Column:
    """How often x stands in an array, without a lambda."""
    return F.size(a) - F.size(F.array_remove(a, x))


def cosine(a: Column, b: Column) -> Column:
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    return ratio(dot, F.sqrt(total_by(a, lambda x: x.cast("double") * x)) * F.sqrt(total_by(b, lambda x: x.cast("double") * x)))

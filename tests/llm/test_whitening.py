import math
from fractions import Fraction

import numpy as np
import pytest

from inkstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)


def brute(rows):
    """Whole numbers, sums and covariance by exact fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, size = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(size)]
    v = np.array([[float(Fraction(sum((n * r[a] - s[a]) * (n * r[b] - s[b]) for r in x), n**3)) for b in range(size)] for a in range(size)])
    return x, n, s, v


def test_against_exact_fractions(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), [float(c) for c in r.normal(0, 0.2, 12) * np.linspace(0.5, 3, 12)]) for k in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(500, None), (501, [math.nan] * 12), (502, [math.inf] + [0.0] * 11), (503, [None] + [0.0] * 11), (504, []), (505, [1.0, 2.0])]
    got = whitening.whiten_vectors(table(spark, rows + bad).repartition(5)).collect()
    x, n, s, v = brute(rows)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:8], w[:, ::-1][:, :8]
    assert len(got) == 8 * len(rows) and {g["n"] for g in got} == {n}
    exact = {i: sum((n * a - b) ** 2 for a, b in zip(row, s)) for (i, _), row in zip(rows, x)}
    assert all(g["deviation"] == exact[g["vec_id"]] and g["deviation_exact"] == str(exact[g["vec_id"]]) for g in got)
    white = {i: (np.array(row) - np.array(s) / n) @ w / np.sqrt(e) for (i, _), row in zip(rows, x)}
    for k in range(8):
        pairs = [(g["whitened"], white[g["vec_id"]][k]) for g in got if g["component"] == k + 1]
        sign = math.copysign(1, pairs[0][0] * pairs[0][1])
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-8
        assert {round(g["explained"] / (e[k] / np.trace(v)), 9) for g in got if g["component"] == k + 1} == {1.0}
    assert len({g["identity_error"] for g in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_residues_give_the_whole_scatter():
    r = np.random.default_rng(1)
    x = r.integers(-(10**9), 10**9, (20000, 5))
    moduli = whitening.primes(6)
    got = whitening.reconstruct(whitening.residue_scatter(x, moduli), moduli)
    wide = np.concatenate((np.ones((len(x), 1), dtype=object), x.astype(object)), axis=1)
    assert (got == wide.T @ wide).all()
    assert all(all(p % k for k in range(2, 1025)) for p in moduli)


@pytest.mark.parametrize("scale", [10, 10**9, 2**61])
def test_squares_of_any_size(scale):
    d = np.random.default_rng(2).integers(-scale, scale, (50, 9))
    assert whitening.square_sums(d) == [sum(int(v) ** 2 for v in row) for row in d]
    assert whitening.square_sums(d.astype(object)) == whitening.square_sums(d)


def test_flat_and_single_and_large(spark):
    got = whitening.whiten_vectors(table(spark, [(1, [1.0, 2.0, 3.0])])).collect()
    assert [(g["component"], g["n"], g["deviation"], g["whitened"], g["explained"], g["identity_error"]) for g in got] == [(k, 1, 0, None, 0.0, None) for k in (1, 2, 3)]
    got = whitening.whiten_vectors(table(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0])])).collect()
    first = sorted((g["vec_id"], g["whitened"], g["explained"]) for g in got if g["component"] == 1)
    assert [(i, abs(w), e) for i, w, e in first] == [(1, 1.0, 1.0), (2, 1.0, 1.0)] and first[0][1] == -first[1][1]
    assert {g["whitened"] for g in got if g["component"] == 2} == {None}
    # 1024 * 1e30 is beyond 2^52, which stands for it.
    got = whitening.whiten_vectors(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()
    assert {g["deviation"] for g in got} == {None} and {g["deviation_exact"] for g in got} == {str(2**104)}


def test_nothing_usable(spark):
    assert whitening.whiten_vectors(table(spark, [])).count() == 0
    assert whitening.whiten_vectors(table(spark, [(1, None), (2, [])])).count() == 0

"""Whitening of embeddings from an exact scatter matrix.

Entries become whole numbers. Each partition multiplies them in residues of
several primes, by ordinary matrix products that stay below 2^53 and so are
exact; sums of residues are reduced, and the Chinese remainder theorem gives the whole
sums of products, whatever the number of rows and the order of adding. The
covariance's eigenvectors then come from double precision.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import bounded_batches

SCALE, SHIFT = 1024, 100000
#: Rows in a product; a product of residues below 2^20 over 2^13 rows is below 2^53.
BLOCK = 1 << 13
TOP = 1 << 20
REDUCERS = 16
COMPONENTS = 8


def primes(count: int, below: int = TOP) -> list[int]:
    """The largest primes below a bound, from the top."""
    is_prime = np.ones(below, dtype=bool)
    is_prime[:2] = False
    for k in range(2, int(below**0.5) + 1):
        if is_prime[k]:
            is_prime[k * k :: k] = False
    return np.flatnonzero(is_prime)[::-1][:count].tolist()


def whole(c: np.ndarray) -> np.ndarray:
    """Entries as whole numbers; those beyond 2^52 count as that."""
    return np.clip(np.floor(SCALE * c), -(2.0**52), 2.0**52).astype(np.int64) + SHIFT


def vectors_of(col: pa.Array, size: int) -> np.ndarray:
    """A list column whose rows all have ``size`` entries, as doubles."""
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, size)


def residue_scatter(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """For each modulus, the sum over rows of the outer products of (1, x)."""
    wide = np.concatenate((np.ones((len(x), 1), dtype=np.int64), x), axis=1)
    out = np.zeros((len(moduli), wide.shape[1], wide.shape[1]), dtype=np.int64)
    for a in range(0, len(wide), BLOCK):
        for k, p in enumerate(moduli):
            r = np.mod(wide[a : a + BLOCK], p).astype(np.float64)
            out[k] = (out[k] + (r.T @ r).astype(np.int64)) % p
    return out


def reconstruct(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The whole numbers, of either sign, that have these residues (as objects)."""
    product = reduce(lambda a, b: a * b, moduli)
    total = np.zeros(residues.shape[1:], dtype=object)
    for r, p in zip(residues, moduli):
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total %= product
    return np.where(total > product // 2, total - product, total)


def square_sums(d: np.ndarray) -> list[int]:
    """Exact sums of the squares of each row's whole numbers, of any size."""
    if d.dtype == object:
        return [sum(int(v) * int(v) for v in row) for row in d]
    most = int(np.abs(d).max(initial=0))
    if most * most * max(1, d.shape[1]) < 1 << 63:
        return (d * d).sum(1).tolist()
    high, low = d >> 31, d & ((1 << 31) - 1)
    total = [0] * len(d)
    for a, b, shift in ((high, high, 62), (high, low, 32), (low, low, 0)):  # sums of 32-bit halves, which doubles can't hold
        ab = a * b
        top, rest = (ab >> 31).sum(1).tolist(), (ab & ((1 << 31) - 1)).sum(1).tolist()
        total = [t + (((x << 31) + y) << shift) for t, x, y in zip(total, top, rest)]
    return total


class Whitening:
    """``n`` rows with sums ``s`` and exact scatter; components as columns."""

    def __init__(self, scatter: np.ndarray, components: int = COMPONENTS):
        self.n = int(scatter[0, 0])
        self.s = scatter[0, 1:]
        n, size = self.n, len(self.s)
        exact = n * scatter[1:, 1:] - np.outer(self.s, self.s)
        # A quotient of whole numbers is rounded once, however large they are.
        v = np.array([[int(a) / (n * n) for a in row] for row in exact], dtype=np.float64).reshape(size, size)
        trace = int(sum(exact[k, k] for k in range(size))) / (n * n)
        e, w = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")[: min(components, size)]
        self.e, w = e[order], w[:, order]
        self.w = w * np.where(w[np.abs(w).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
        #: Components of no variance, beside the rounding of the matrix.
        self.flat = self.e <= trace * size * 1e-15
        self.explained = np.where(self.flat, 0.0, self.e / trace) if trace else np.zeros(len(order))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in 64 bits where these hold it, else as objects."""
        most = max([self.n * int(np.abs(x).max(initial=0))] + [abs(int(v)) for v in self.s])
        if most < 1 << 62:
            return self.n * x - self.s.astype(np.int64)
        return self.n * x.astype(object) - self.s

    def whiten(self, d: np.ndarray) -> np.ndarray:
        """Rows by component; NaN for a component without variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (d.astype(np.float64) / self.n) @ self.w / np.sqrt(np.maximum(self.e, 0))
        out[:, self.flat] = np.nan
        return out


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    inf = F.lit(float("inf"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == inf))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad)


def _reduced(df: DataFrame, run, width: int) -> np.ndarray | None:
    """Sums of the partitions' arrays of ``width`` longs: each reducer adds up
    the arrays of its partitions as they come, and the driver gets REDUCERS of them."""
    parts = df.mapInArrow(run, "slot int, data binary").repartition(REDUCERS, "slot")

    def add(batches):
        total, some = np.zeros(width, dtype=np.int64), False
        for b in batches:
            for x in b.column(1).to_pylist():
                total += np.frombuffer(x, dtype=np.int64)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    got = parts.mapInArrow(add, "data binary").collect()
    return sum(np.frombuffer(r["data"], dtype=np.int64) for r in got) if got else None


def _one(array: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    slot = TaskContext.get().partitionId() % (REDUCERS * 64)
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([array.tobytes()], pa.binary())], names=["slot", "data"])


def fit_whitening(usable: DataFrame, size: int, rows: int, largest: float, components: int = COMPONENTS) -> Whitening:
    """From all rows; the number of primes follows from how many rows there are
    and from their largest entry."""
    bound = min(SCALE * largest, 2.0**52) + SHIFT + 1
    need, moduli, product = 2 * (rows + 1) * int(bound) ** 2, [], 1
    for p in primes(64):
        if product > need:
            break
        moduli.append(p)
        product *= p
    shape = (len(moduli), size + 1, size + 1)

    def run(batches):
        total, some = np.zeros(shape, dtype=np.int64), False
        p = np.array(moduli)[:, None, None]
        for b in batches:
            total = (total + residue_scatter(whole(vectors_of(b.column(0), size)), moduli)) % p
            some = some or b.num_rows > 0
        if some:
            yield _one(total)

    total = _reduced(usable.select("v"), run, shape[0] * shape[1] * shape[2]).reshape(shape)
    return Whitening(reconstruct(total % np.array(moduli)[:, None, None], moduli), components)


def identity_error(usable: DataFrame, model: Whitening, size: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity,
    over the components that have variance; None without any. Partitions are
    centred by their own means and joined pairwise."""
    shared = usable.sparkSession.sparkContext.broadcast(model)
    live = int((~model.flat).sum())
    if not live:
        return None

    def joined(a, b):
        if a is None or not b[0]:
            return b if a is None else a
        (na, ma, ca), (nb, mb, cb) = a, b
        d, n = mb - ma, na + nb
        return n, ma + d * (nb / n), ca + cb + np.outer(d, d) * (na * nb / n)

    def pack(part):
        n, m, c = part
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate((m, c.ravel())).tobytes()], pa.binary())], names=["n", "data"])

    def unpack(n, data):
        x = np.frombuffer(data, dtype=np.float64)
        return n, x[:live], x[live:].reshape(live, live)

    def run(batches):
        total, use = None, ~shared.value.flat
        for b in batches:
            x = whole(vectors_of(b.column(0), size))
            for k in range(0, len(x), BLOCK):
                w = shared.value.whiten(shared.value.deviations(x[k : k + BLOCK]))[:, use]
                m = w.mean(0)
                total = joined(total, (len(w), m, (w - m).T @ (w - m)))
        if total is not None:
            yield pack(total)

    def add(batches):
        total = None
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total = joined(total, unpack(n, data))
        if total is not None:
            yield pack(total)

    kind = "n long, data binary"
    got = usable.select("v").mapInArrow(run, kind).repartition(REDUCERS).mapInArrow(add, kind).collect()
    total = None
    for r in got:  # REDUCERS rows at most
        total = joined(total, unpack(r["n"], r["data"]))
    return float(np.abs(total[2] / total[0] - np.eye(live)).max())


def whiten_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``, ``deviation_exact`` for each usable row and component.

    Left out: vectors that are null or empty, hold a null or a non-finite
    entry, or are of another length than most (of lengths as frequent, than
    the longest). ``deviation`` is null where a long can't hold it,
    ``deviation_exact`` has it as text. A component without variance has a
    null ``whitened`` and explains 0; without any variance the error is null.
    Components of equal variance are any of their plane's. Repeated rows count
    and come out each; null ids stay. Without usable rows nothing comes out.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = _usable(vectors, id_col, vector_col).filter(F.size("v") > 0)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    each = usable.select(F.size("v").alias("size"), F.array_max(F.transform("v", F.abs)).alias("most"))
    lengths = each.groupBy("size").agg(F.count("*").alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    size, rows, largest = lengths[0]
    usable = usable.filter(F.size("v") == size)
    model = fit_whitening(usable, size, rows, largest, components)
    error = identity_error(usable, model, size)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        k = len(model.e)
        for b in batches:
            x = whole(vectors_of(b.column(1), size))
            for a in range(0, len(x), BLOCK):
                d = model.deviations(x[a : a + BLOCK])
                sums, m = square_sums(d), len(d)
                w = model.whiten(d).ravel()
                fits = [s if s < 1 << 63 else None for s in sums]
                twice = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(a, m).take(pa.array(twice)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, dtype=np.int64)),
                        pa.array(fits, pa.int64()).take(pa.array(twice)),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(model.explained, m)),
                        pa.array([error] * (m * k), pa.float64()),
                        pa.array([str(s) for s in sums], pa.string()).take(pa.array(twice)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return usable.select("id", "v").mapInArrow(run, schema)

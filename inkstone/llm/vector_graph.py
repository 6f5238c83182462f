"""Near-duplicate vectors by a robust-pruned flat proximity graph.

0. Bit-equal vectors are merged into one, which carries the number of its rows.
1. Centres are fitted on a bounded sample; every vector joins the shards of
   its nearest centres, so shards overlap. A shard beyond a bound is split.
2. Each shard builds a graph on its members: candidates by similarity and some
   at random, pruned so that no kept neighbour is much nearer to another kept
   one, and made symmetric. A maximum spanning tree is added, so that near-equal
   vectors, however many, all stay connected.
3. A vector's lists from all its shards are united. Each shard is then searched
   with the united lists: every vector asks the shards of its nearest centres, by greedy
   search from the shard's medoid that goes on through all vectors in range.
4. Links are verified in double precision and counted where their target is at home,
   so none counts twice; a task hands on one row for each query that found
   something, which carries the count and a representative of what it is linked to.
5. Recall is audited by row against brute force, on a bounded sample of all vectors. Below
   the wanted recall all vectors are compared in blocks, or the search is widened where
   they are too many for that; if that doesn't do, an error is raised.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.components import connected_components, smallest_reachable
from inkstone.llm.scratch import Scratch

SAMPLE = 20_000  # vectors that centres are fitted on
MOST_CENTRES = 4096
PER_CENTRE = 400
MEMBER_OF = 3  # shards
ASKS = 6  # shards
SHARD = 1500  # home vectors of a shard beyond which it is split
QUERIES = 2000  # by search task
DEGREE, NEAR, RANDOM, ALPHA, BEAM = 16, 48, 12, 1.2, 24
AUDIT = 512  # vectors
EXACT = 1 << 18  # vectors up to which all are compared if recall is too low
EXACT_BLOCK = 4096
TIE = 1e-3  # distances below are noise of single precision
SLACK = 1e-4


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Fixed-size binaries of doubles as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float64).reshape(-1, dim)


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str, scratch: Scratch) -> DataFrame:
    """``row`` (a number of its own for each), ``id``, ``dim``, ``v``, the
    components as doubles, and ``key``, a digest of ``v``; both are null for a
    vector that can't be compared."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33
        for b in batches:
            dims, blobs, keys = [], [], []
            for x in b.column(1).to_pylist():
                v = None if x is None or None in x else np.asarray(x, dtype=np.float64)
                good = v is not None and v.size > 0 and bool(np.isfinite(v).all())
                if good:
                    top = np.abs(v).max()
                    good = top > 0
                dims.append(len(v) if good else 0)
                blobs.append((v / top / np.linalg.norm(v / top) + 0.0).tobytes() if good else None)  # no negative zeros
                keys.append(hashlib.blake2b(blobs[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + b.num_rows)), b.column(0), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary()), pa.array(keys, pa.binary())], names=["row", "id", "dim", "v", "key"])
            n += b.num_rows

    return scratch.keep(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).mapInArrow(run, f"row long, id {kind}, dim int, v binary, key binary"))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Directions of k clusters of unit vectors."""
    r = np.random.default_rng(seed)
    k = min(k, len(sample))
    c = sample[r.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(sample), 2048)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        c[used] = np.add.reduceat(sample[order], first)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def spanning_tree(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a maximum spanning tree of similarities; among equal ones the
    latest is gone on from, so that copies form a chain and not a star."""
    n = len(s)
    best, parent, todo = s[0].copy(), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    best[0], todo[0] = -3, False
    child = np.empty(n - 1, dtype=np.int64)
    for k in range(n - 1):
        i = child[k] = best.argmax()
        best[i], todo[i] = -3, False
        near = todo & (s[i] >= best - 1e-6)
        parent[near] = i
        np.maximum(best, s[i], out=best, where=near)
    return child, parent[child]


def build_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors ``x``."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    r = np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    cand = np.argpartition(-s, near - 1, axis=1)[:, :near]
    cand = np.concatenate((cand, r.integers(0, n, (n, RANDOM))), axis=1)
    np.fill_diagonal(s, 1)
    row = np.arange(n)[:, None]
    sim = s[row, cand]
    order = np.argsort(-sim, axis=1)
    cand, sim = cand[row, order], sim[row, order]
    gap = np.sqrt(np.maximum(0, 2 - 2 * sim))
    gap[gap < TIE] = 0
    alive = cand != row
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    kept = np.full((n, DEGREE), -1, dtype=np.int64)
    for k in range(DEGREE):
        some = alive.any(1)
        first = alive.argmax(1)
        pick = np.where(some, cand[np.arange(n), first], -1)
        kept[:, k] = pick
        if not some.any():
            break
        between = np.sqrt(np.maximum(0, 2 - 2 * s[np.maximum(pick, 0)[:, None], cand]))
        between[between < TIE] = 0
        alive &= ALPHA * between > gap
        alive[np.arange(n), first] = False
    a, b = np.repeat(np.arange(n), DEGREE), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    child, parent = spanning_tree(s)
    a, b = np.concatenate((a, child, parent)), np.concatenate((b, parent, child))
    both = np.unique(np.concatenate((np.stack((a, b), 1), np.stack((b, a), 1))), axis=0)
    # of the links towards a vector the nearest stay, beside its own
    score = s[both[:, 0], both[:, 1]]
    order = np.lexsort((-score, both[:, 0]))
    both = both[order]
    first = np.searchsorted(both[:, 0], np.arange(n + 1))
    rank = np.arange(len(both)) - first[both[:, 0]]
    own = np.isin(both[:, 0] * n + both[:, 1], a * n + b)
    both = both[own | (rank < 2 * DEGREE)]
    first = np.searchsorted(both[:, 0], np.arange(n + 1))
    return [both[first[i] : first[i + 1], 1] for i in range(n)]


def range_search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row of x) with a similarity of at least ``least`` that the
    graph leads to: greedy from the medoid, then through everything in range."""
    n = len(x)
    width = max(1, max((len(v) for v in lists), default=0))
    table = np.full((n, width), -1, dtype=np.int64)
    for i, v in enumerate(lists):
        table[i, : len(v)] = v
    medoid = int((x @ x.mean(0)).argmax())
    qs, xs = [], []
    for at in range(0, len(queries), 512):
        q = queries[at : at + 512]
        m = len(q)
        seen = np.zeros((m, n), dtype=bool)
        seen[:, medoid] = True
        ids = np.full((m, BEAM), -1, dtype=np.int64)
        sims = np.full((m, BEAM), -3.0, dtype=x.dtype)
        done = np.ones((m, BEAM), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0] = medoid, q @ x[medoid], False
        inside = np.zeros((m, n), dtype=bool)
        ahead = np.zeros((m, n), dtype=bool)  # in range and not expanded

        def expand(who, nodes):
            """Unseen neighbours of nodes, and their similarities."""
            nb = table[nodes]
            new = nb >= 0
            new &= ~seen[who[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(new)
            to = nb[r, c]
            flat = who[r] * n + to
            flat, keep = np.unique(flat, return_index=True)
            r, c, to = r[keep], c[keep], to[keep]
            seen[who[r], to] = True
            s = np.einsum("ij,ij->i", x[to], q[who[r]])
            hit = s >= least
            inside[who[r[hit]], to[hit]] = True
            ahead[who[r[hit]], to[hit]] = True
            return r, c, to, s

        inside[:, medoid] = ahead[:, medoid] = sims[:, 0] >= least
        while True:
            who = np.flatnonzero(~done.all(1))
            if not len(who):
                break
            best = np.where(done[who], -4, sims[who]).argmax(1)
            nodes = ids[who, best]
            done[who, best] = True
            ahead[who, nodes] = False
            r, c, to, s = expand(who, nodes)
            more = np.full((len(who), width), -3.0, dtype=x.dtype)
            names = np.full((len(who), width), -1, dtype=np.int64)
            more[r, c], names[r, c] = s, to
            every, known = np.concatenate((sims[who], more), 1), np.concatenate((ids[who], names), 1)
            flags = np.concatenate((done[who], names < 0), 1)
            top = np.argpartition(-every, BEAM - 1, axis=1)[:, :BEAM]
            row = np.arange(len(who))[:, None]
            sims[who], ids[who], done[who] = every[row, top], known[row, top], flags[row, top]
        while True:
            who = np.flatnonzero(ahead.any(1))
            if not len(who):
                break
            nodes = ahead[who].argmax(1)
            ahead[who, nodes] = False
            expand(who, nodes)
        a, b = np.nonzero(inside)
        qs.append(a + at)
        xs.append(b)
    if not qs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(qs), np.concatenate(xs)


def _assigned(rows: DataFrame, dim: int, centres, most: int) -> DataFrame:
    """``row``, ``v``, ``copies`` and the nearest centres, nearest first."""

    def run(batches):
        for b in batches:
            v = _matrix(b.column(1), dim)
            s = v @ centres.value.T
            k = min(most, s.shape[1])
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * k + 1, k), pa.int32()), pa.array(top.ravel(), pa.int32()))], names=["row", "v", "copies", "near"])

    return rows.select("row", "v", "copies").mapInArrow(run, "row long, v binary, copies long, near array<int>")


def _summed(asking: np.ndarray, own: np.ndarray, copies: np.ndarray, q: np.ndarray, x: np.ndarray) -> pa.Table:
    """Of links (query, row of ``own``) a row for each vector: its links, by
    the copies of their targets, and the smallest row it is linked to."""
    names, at = np.unique(np.concatenate((asking[q], own[x])), return_inverse=True)
    low = names[smallest_reachable(len(names), at[: len(q)], at[len(q) :])]
    n = np.bincount(at[: len(q)], weights=copies[x], minlength=len(names)).astype(np.int64)
    return pa.table({"row": pa.array(names, pa.int64()), "links": pa.array(n, pa.int64()), "other": pa.array(low, pa.int64())})


def _compared(own: DataFrame, n: int, dim: int, least: float, scratch: Scratch) -> DataFrame:
    """What ``_found`` gives, by comparing all n vectors in blocks."""
    blocks = -(-n // EXACT_BLOCK)
    side = own.select("row", "v", "copies", F.expr(f"cast(pmod(xxhash64(row, 2), {blocks}) as int)").alias("k"))
    every = F.explode(F.expr(f"sequence(0, {blocks - 1})"))
    held = side.select(every.alias("i"), F.col("k").alias("j"), "row", "v", "copies")
    ask = side.select(F.col("k").alias("i"), every.alias("j"), "row", "v", F.lit(None).cast("long").alias("copies"))

    def compare(table: pa.Table) -> pa.Table:
        is_query = table.column("copies").is_null().to_numpy()
        v, rows = _matrix(table.column("v"), dim), table.column("row").to_numpy()
        mine, theirs, own, asking = v[~is_query], v[is_query], rows[~is_query], rows[is_query]
        copies = table.column("copies").drop_null().to_numpy()
        out = [_summed(asking, own, copies, *[np.zeros(0, dtype=np.int64)] * 2)]
        for at in range(0, len(theirs) if len(mine) else 0, 512):
            q, x = np.nonzero(theirs[at : at + 512] @ mine.T >= least)
            q += at
            keep = own[x] != asking[q]
            if keep.any():
                out.append(_summed(asking, own, copies, q[keep], x[keep]))
        return pa.concat_tables(out)

    return scratch.keep(held.unionByName(ask).groupBy("i", "j").applyInArrow(compare, "row long, links long, other long"))


def _found(near: DataFrame, dim: int, least: float, asks: int, scratch: Scratch) -> DataFrame:
    """``row``, ``links``, ``other`` (a row it is linked to) by search task."""
    spark = near.sparkSession
    sizes = near.groupBy(F.col("near")[0].alias("c")).agg(F.count("*").alias("n")).collect()  # a row for each centre
    splits = {r["c"]: -(-r["n"] // SHARD) for r in sizes}
    count = near.select(F.explode(F.slice("near", 1, asks)).alias("c")).groupBy("c").count().collect()
    rounds = {r["c"]: -(-r["count"] // QUERIES) for r in count}
    plan = spark.createDataFrame([(c, splits.get(c, 1), rounds.get(c, 1)) for c in {*splits, *rounds}], "c int, splits int, rounds int")
    plan = F.broadcast(plan)  # a row for each of at most MOST_CENTRES centres

    members = near.select("row", "v", "copies", F.posexplode(F.slice("near", 1, MEMBER_OF)).alias("nth", "c")).join(plan, "c")
    members = members.select("c", F.expr("cast(pmod(xxhash64(row), splits) as int)").alias("h"), "row", "v", "copies", (F.col("nth") == 0).alias("home"), "rounds")

    def build(key, table):
        x, rows = _matrix(table.column("v"), dim).astype(np.float32), table.column("row").to_numpy()
        order = np.argsort(rows)
        x, rows = x[order], rows[order]
        lists = build_graph(x, seed=int(key[0].as_py()))
        return pa.table({"row": rows, "nb": pa.array([rows[v].tobytes() for v in lists], pa.binary())})

    shards = scratch.keep(members.select("c", "h", "row", "v").groupBy("c", "h").applyInArrow(build, "row long, nb binary"))
    united = shards.groupBy("row").agg(F.array_join(F.collect_list(F.hex("nb")), "").alias("nb"))  # MEMBER_OF lists
    united = scratch.keep(united.select("row", F.unhex("nb").alias("nb")))
    ask = near.select("row", "v", F.explode(F.slice("near", 1, asks)).alias("c")).join(plan, "c")
    ask = ask.withColumn("k", F.expr("cast(pmod(xxhash64(row, 1), rounds) as int)")).select("c", F.explode(F.expr("sequence(0, splits - 1)")).alias("h"), "k", "row", "v")
    held = members.join(united, "row").select("c", "h", F.explode(F.expr("sequence(0, rounds - 1)")).alias("k"), "row", "v", "copies", "home", "nb")
    both = held.unionByName(ask, allowMissingColumns=True)

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("nb").is_null().to_numpy()
        v, rows = _matrix(table.column("v"), dim), table.column("row").to_numpy()
        mine, theirs = v[~is_query], v[is_query]
        own, asking = rows[~is_query], rows[is_query]
        order = np.argsort(own)
        mine, own = mine[order], own[order]
        home = table.column("home").to_numpy(zero_copy_only=False)[~is_query][order].astype(bool)
        copies = table.column("copies").drop_null().to_numpy()[order]
        blobs = [x for x in table.column("nb").to_pylist() if x is not None]
        lists = []
        for i in order.tolist():
            nb = np.unique(np.frombuffer(blobs[i], dtype=np.int64))
            at = np.minimum(np.searchsorted(own, nb), len(own) - 1)
            lists.append(at[own[at] == nb])
        q = x = np.zeros(0, dtype=np.int64)
        if len(own) and len(asking):
            q, x = range_search(mine.astype(np.float32), lists, theirs.astype(np.float32), least - SLACK)
            keep = home[x] & (own[x] != asking[q])
            q, x = q[keep], x[keep]
            good = np.concatenate([np.einsum("ij,ij->i", theirs[q[i : i + 65536]], mine[x[i : i + 65536]]) >= least for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0, dtype=bool)
            q, x = q[good], x[good]
        return _summed(asking, own, copies, q, x)

    return scratch.keep(both.groupBy("c", "h", "k").applyInArrow(search, "row long, links long, other long"))


def brute_force(rows: DataFrame, dim: int, audited: list[tuple[int, bytes]], least: float) -> dict[int, int]:
    """Links of a few rows against all others, by their copies."""
    names = np.array([r for r, _ in audited], dtype=np.int64)
    q = np.frombuffer(b"".join(v for _, v in audited), dtype=np.float64).reshape(-1, dim)

    def run(batches):
        total = np.zeros(len(names), dtype=np.int64)
        for b in batches:
            hit = _matrix(b.column(1), dim) @ q.T >= least
            hit &= b.column(0).to_numpy()[:, None] != names[None, :]
            total += b.column(2).to_numpy() @ hit
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["row", "n"])

    found = rows.select("row", "v", "copies").mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    return {r["row"]: r["n"] for r in found}


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, recall: float = 0.95) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept``, ``audited_links`` by row.

    Two vectors link when their cosine in double precision is at least
    ``least``. Vectors that are null, empty, zero or hold a null or a non-finite
    component link with nothing, and neither do vectors of different lengths.
    ``component_id`` is the smallest id reachable by links, itself included;
    rows with one id stay rows of their own and link like any others. A row without an
    id has the smallest id of those it is linked to (null if there are none) and
    isn't kept. ``audited_links`` holds the links that brute force
    finds, for the audited rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = clean_vectors(vectors, id_col, vector_col, scratch)
    key = "key" if least <= 1 else "row"  # copies are linked
    classes = scratch.keep(rows.filter("v is not null").groupBy(key).agg(F.min("row").alias("class"), F.count("*").alias("copies")))
    found, audits = [], {}
    merged = rows.filter("v is not null").select("row", "dim", "v").join(classes.select(F.col("class").alias("row"), "copies"), "row")
    merged = scratch.keep(merged)
    for r in merged.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        dim, n = r["dim"], r["n"]
        own = merged.filter(F.col("dim") == dim)
        sample = own.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
        sample = np.frombuffer(b"".join(x["v"] for x in sample), dtype=np.float64).reshape(-1, dim).astype(np.float32)
        centres = fit_centres(sample, min(MOST_CENTRES, max(1, n // PER_CENTRE))).astype(np.float64)
        asks = ASKS
        shared = spark.sparkContext.broadcast(centres)
        picked = own.select("row", "v").orderBy(F.xxhash64("row")).limit(AUDIT).collect()
        audited = [(x["row"], bytes(x["v"])) for x in picked]
        truth = brute_force(own, dim, audited, least)
        asked = F.broadcast(spark.createDataFrame([(a,) for a, _ in audited], "row long"))

        def audit(got):
            """Mean share of their links that the audited vectors with links have."""
            known = {x["row"]: x["links"] for x in got.join(asked, "row").groupBy("row").agg(F.sum("links").alias("links")).collect()}
            shares = [min(known.get(k, 0), v) / v for k, v in truth.items() if v]
            return sum(shares) / len(shares) if shares else 1.0

        while True:
            near = scratch.keep(_assigned(own, dim, shared, max(asks, MEMBER_OF)))
            got = _found(near, dim, least, asks, scratch)
            reached = audit(got)
            if reached >= recall:
                break
            if n <= EXACT:
                got = _compared(own, n, dim, least, scratch)
                break
            if asks >= len(centres):
                raise RuntimeError(f"recall of vectors of {dim} components is {reached:.3f}, not {recall}")
            asks = min(len(centres), 2 * asks)
        found.append(got)
        audits |= truth
    names = rows.select("row", "id", key) if key == "key" else rows.select("row", "id")
    if not found:
        return names.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"), F.lit(None).cast("long").alias("audited_links"))
    names = names.join(classes, key, "left").select("row", "id", "class", "copies")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    counts = every.groupBy(F.col("row").alias("class")).agg(F.sum("links").alias("links"))
    parts = connected_components(every.select(F.col("row").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "class")
    parts = names.filter("class is not null").groupBy("class").agg(F.min("id").alias("low")).join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = parts.groupBy("component").agg(F.min("low").alias("low"))
    parts = parts.select("class", "component").join(lowest, "component").select("class", "low")
    audit_rows = spark.createDataFrame([(int(k), int(v)) for k, v in audits.items()], "class long, audited long")
    out = names.join(counts, "class", "left").join(parts, "class", "left").join(F.broadcast(audit_rows), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        (F.col("audited") + F.col("copies") - 1).alias("audited_links"),
    )

"""Set-similarity self-join of documents on word n-grams.

A document is the set of its distinct word n-grams; two link when their
Jaccard similarity reaches a threshold. The join filters by rare-first
prefixes, lengths, positions and suffixes, and verifies every remaining pair
once on the full sets.

1. One pass over the texts gives each document's set size, a fingerprint of
   its set (equal sets form a class and go on as one), a partition histogram
   of the set, and counts of n-grams by their hash. Any order that all documents
   share is right for prefix filtering; the counts make it rare-first.
2. A second pass deals each class's prefix n-grams to reducers as packed
   arrays. A reducer proposes the pairs of an n-gram's group that pass the length
   and positional filters; a group of more than CROWD classes is listed instead.
3. Proposed pairs pass the suffix filter: counts of both sets in fixed hash
   ranges bound their overlap.
4. Classes get a home, the smallest class among those they are proposed or
   listed with, and the classes of a home and size range form blocks of bounded size.
   A proposed pair or listed group names the pairs of blocks to compare. Each class
   goes once to each pair of blocks that it is needed in, so near copies travel
   together and are never spelt out as pairs, and each pair of classes is
   verified in one pair of blocks only.
5. A task returns, for each class, its number of links and the smallest class
   that its links lead to; the latter are connected over all tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkstone.llm.components import connected_components, smallest_reachable
from inkstone.llm.scratch import Scratch
from inkstone.llm.wordhash import U64, column_bytes, mix, shingle_sets, slices

LEAST_BUCKETS, MOST_BUCKETS = 1 << 22, 1 << 26  # of the n-gram counts: a byte each as broadcast
BUCKET_BYTES = 1 << 14  # of input
BLOCK = 1 << 16
PARTS = 256  # of a set's histogram
FAN = 64  # blocks of counts added up at once
PER_REDUCER = 1_500_000  # prefix n-grams
HOT = 200_000  # occurrences (or HOT_SHARE mean buckets) beyond which an n-gram's group is dealt to several reducers
HOT_SHARE = 8
CROWD = 64  # classes beyond which an n-gram's group is compared in blocks
BLOCK_SETS, BLOCK_NGRAMS = 2048, 1 << 21  # of a block
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27  # of the filter for classes that are compared
TOKENS = 2048  # columns of a product of matrices


def _buckets(docs: DataFrame) -> int:
    """Counts grow with the input, as the plan's statistics give it (if they know it), up to a bound."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 60 else size
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, size // BUCKET_BYTES - 1).bit_length()))


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts on a monotone logarithmic scale that fits a byte."""
    return np.minimum(255, np.round(7 * np.log2(1.0 + counts))).astype(np.uint8)


def _sets(batch: pa.RecordBatch, column: int, size: int):
    data, offs = column_bytes(batch.column(column))
    for a, b in slices(offs):
        yield from shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)


def _print(s: np.ndarray) -> int:
    """64-bit fingerprint of a sorted set."""
    if not len(s):
        return 0
    place = mix(np.arange(1, len(s) + 1, dtype=np.uint64))
    return int((mix(s ^ place).sum(dtype=np.uint64) ^ U64(len(s))).astype(np.int64))


def _prefix(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _wanted(n, m, num: int, den: int):
    """Least intersection of linked sets of sizes n and m."""
    return -(-num * (n + m) // (num + den))


def class_table(docs: DataFrame, id_col: str, text_col: str, size: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """A row for each document (id, text_hash, n, key, parts), and the n-gram counts of buckets."""
    buckets = _buckets(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int32)
        for batch in batches:
            n, key, parts = [], [], []
            for s in _sets(batch, 1, size):
                np.add.at(counts, (s & U64(buckets - 1)).astype(np.int64), 1)
                n.append(len(s))
                key.append(_print(s))
                h = np.bincount((s >> U64(56)).astype(np.int64), minlength=PARTS)
                parts.append(np.minimum(h, 255).astype(np.uint8).tobytes() if len(s) >= 16 else b"")
            empty = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(parts, pa.binary()), pa.nulls(empty, pa.int32()), pa.nulls(empty, pa.binary())],
                names=names,
            )
        blocks = [(i, counts[i * BLOCK : (i + 1) * BLOCK]) for i in range(buckets // BLOCK)]
        blocks = [(i, zlib.compress(c.astype(np.int64).tobytes(), 1)) for i, c in blocks if c.any()]
        k = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())],
            names=names,
        )

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = ["id", "text_hash", "n", "key", "parts", "block", "counts"]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    both = scratch.keep(source.mapInArrow(run, f"id {kind}, text_hash long, n long, key long, parts binary, block int, counts binary"))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, dtype=np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), dtype=np.int64)
        counts = pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())
        return pa.table({"block": table.column("block").slice(0, 1), "counts": counts, "at": table.column("at").slice(0, 1)})

    tables, k = both.filter("block is not null").select("block", "counts", F.spark_partition_id().alias("at")), max(1, both.rdd.getNumPartitions())
    first = True
    while first or k > 1:
        k = -(-k // FAN)
        tables = tables.withColumn("at", F.expr(f"cast(at div {FAN} as int)")).groupBy("block", "at").applyInArrow(add, "block int, counts binary, at int")
        first = False
    levels = np.zeros(buckets, dtype=np.uint8)
    for r in tables.collect():  # buckets / BLOCK rows
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = _level(np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64))
    return both.filter("block is null").select("id", "text_hash", "n", "key", "parts"), levels


def _prefixes(docs: DataFrame, text_col: str, size: int, num: int, den: int, levels, reducers: int, hot_from: float) -> DataFrame:
    """Packed prefix n-grams: reducer, and arrays of token, row, position; of key and set size by row."""

    def run(batches):
        lv = levels.value
        many = np.maximum(1, np.ceil(2 ** (np.arange(256) / 7) / hot_from)).astype(np.int64)
        last = U64(len(lv) - 1)
        for batch in batches:
            tokens, rows, places, keys, sizes, seen = [], [], [], [], [], set()
            for s in _sets(batch, 0, size):
                if not len(s):
                    continue
                key = _print(s)
                if key in seen:
                    continue
                seen.add(key)
                p = _prefix(len(s), num, den)
                level = lv[(s & last).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:p]
                tokens.append(s[order])
                rows.append(np.full(p, len(keys), dtype=np.int32))
                places.append(np.arange(p, dtype=np.int32))
                keys.append(key)
                sizes.append(len(s))
            if not keys:
                continue
            token, row, place = map(np.concatenate, (tokens, rows, places))
            key, n = np.array(keys, dtype=np.int64), np.array(sizes, dtype=np.int32)
            salts = many[lv[(token & last).astype(np.int64)]]
            hot = salts > 1
            to = (token >> U64(32)).astype(np.int64)
            to[hot] += (key[row[hot]] % salts[hot]) * 7919
            to %= reducers
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(reducers + 1))
            out = []
            for r in range(reducers):
                o = order[cut[r] : cut[r + 1]]
                if len(o):
                    used, at = np.unique(row[o], return_inverse=True)
                    out.append((r, (token[o] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), at.astype(np.int32).tobytes(), place[o].tobytes(), hot[o].tobytes(), key[used].tobytes(), n[used].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32())] + [pa.array([x[k] for x in out], pa.binary()) for k in range(1, 7)],
                names=["reducer", "token", "row", "place", "hot", "keys", "sizes"],
            )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "reducer int, token binary, row binary, place binary, hot binary, keys binary, sizes binary")


def _propose(num: int, den: int):
    """What a reducer makes of its n-grams: rows with ``gid`` null are pairs,
    rows with ``b`` null are members of a listed group."""

    def run(table: pa.Table) -> pa.Table:
        parts = [[], [], [], [], []]
        for t, r, p, h, k, n in zip(*(table.column(c).to_pylist() for c in ("token", "row", "place", "hot", "keys", "sizes"))):
            row = np.frombuffer(r, dtype=np.int32)
            for x, y in zip(parts, (np.frombuffer(t, dtype=np.uint32), np.frombuffer(k, dtype=np.int64)[row], np.frombuffer(n, dtype=np.int32)[row], np.frombuffer(p, dtype=np.int32), np.frombuffer(h, dtype=bool))):
                x.append(y)
        token, key, n, place, hot = map(np.concatenate, parts)
        order = np.lexsort((key, n, token))
        token, key, n, place, hot = (x[order] for x in (token, key, n, place, hot))
        same = (token[1:] == token[:-1]) & (key[1:] == key[:-1])  # copies of one class from several batches
        keep = np.concatenate(([True], ~same))
        token, key, n, place, hot = (x[keep] for x in (token, key, n, place, hot))
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(start, len(token)))
        n, place = n.astype(np.int64), place.astype(np.int64)

        # a listed group stands for all groups with its members; a hot one's members may be in several reducers
        crowd = (count > CROWD) | hot[start]
        total = np.cumsum(np.append(U64(0), mix(key.astype(np.uint64))), dtype=np.uint64)
        gid = (total[start + count] - total[start]).astype(np.int64)
        gid[hot[start]] = token[start][hot[start]].astype(np.int64) | 1 << 40
        groups, first = np.unique(gid[crowd], return_index=True)
        at, many = start[crowd][first], count[crowd][first]
        members = np.repeat(at - np.append(0, many.cumsum()[:-1]), many) + np.arange(many.sum())

        pairs = np.zeros((0, 2), dtype=np.int64)
        left = np.flatnonzero(~np.repeat(crowd, count))
        found, waiting = [pairs], 0
        for apart in range(1, CROWD):
            left = left[left + apart < len(token)]
            left = left[token[left + apart] == token[left]]
            if not len(left):
                break
            i = left[_may(n[left], place[left], n[left + apart], place[left + apart], num, den)]
            found.append(np.stack((np.minimum(key[i], key[i + apart]), np.maximum(key[i], key[i + apart])), 1))
            waiting += len(i)
            if waiting > 1 << 20:
                found, waiting = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table(
            {
                "a": pa.array(np.concatenate((pairs[:, 0], key[members]))),
                "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(members), pa.int64())]),
                "gid": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(np.repeat(groups, many), pa.int64())]),
            }
        )

    return run


def _may(n, p, m, q, num: int, den: int):
    """Length, index-prefix and positional filters; the first set is the smaller."""
    want = _wanted(n, m, num, den)
    index = n - -(-2 * num * n // (num + den)) + 1
    return (den * n >= num * m) & (p < index) & (1 + np.minimum(n - p - 1, m - q - 1) >= want)


def _suffix_filter(num: int, den: int):
    """Keeps pairs whose histograms allow the wanted overlap."""

    def run(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                ok = den * min(n, m) >= num * max(n, m)
                if ok and x and y:
                    x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
                    ok = x.max() == 255 or y.max() == 255 or int(np.minimum(x, y).sum(dtype=np.int64)) >= _wanted(n, m, num, den)
                keep.append(bool(ok))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones, as products of matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edge = np.concatenate(([True], token[1:] != token[:-1]))
    shared = ~(edge & np.append(edge[1:], True))  # n-grams of one set only can't meet
    owner, number = owner[shared], np.cumsum(edge[shared]) - 1
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    hits = np.zeros((len(left), len(right)), dtype=np.float32)
    cuts = np.searchsorted(number, np.arange(0, number[-1] + 1 + TOKENS if len(number) else 0, TOKENS))
    for a, b in zip(cuts[:-1], cuts[1:]):
        o, t = owner[a:b], number[a:b] - number[a]
        x, y = np.zeros((len(left), t[-1] + 1), dtype=np.float32), np.zeros((len(right), t[-1] + 1), dtype=np.float32)
        for m, of in ((x, row), (y, column)):
            own = of[o] >= 0
            m[of[o[own]], t[own]] = 1
        hits += x @ y.T
    return hits


def _linked(side: np.ndarray, key: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of blocks (sides 0 and 1, or 0 only for a block with itself):
    the classes that link, the documents they link to, and the smallest class
    that the links lead to."""
    order = np.argsort(key)
    side, key, copies, sets = side[order], key[order], copies[order], [sets[i] for i in order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    if alone:
        right = left
    size = np.array([len(s) for s in sets])
    hits = _overlaps(sets, left, right)
    links = np.zeros(len(key), dtype=np.int64)
    low = np.arange(len(key))
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        both = hits[at : at + 256].astype(np.int64)
        x, y = np.nonzero((den + num) * both >= num * (size[i][:, None] + size[right][None, :]))
        x, y = i[x], right[y]
        if alone:
            x, y = x[x != y], y[x != y]
        np.add.at(links, x, copies[y])
        if not alone:
            np.add.at(links, y, copies[x])
        low = np.minimum(low, smallest_reachable(len(key), np.concatenate((x, np.arange(len(key)))), np.concatenate((y, low))))
    some = links > 0
    low = smallest_reachable(len(key), np.arange(len(key)), low)
    return key[some], links[some], key[low[some]]


def _compare(num: int, den: int):
    """Links of each pair of blocks; rows come sorted by these."""

    def run(batches):
        held: list = []  # parts of the pair of blocks that a batch's end has cut
        now = None

        def done():
            side, key, copies, sets = ([x for part in held for x in part[k]] for k in range(4))
            return _linked(np.array(side), np.array(key), np.array(copies), sets, num, den)

        for batch in batches:
            p, q = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            side, key, copies = (batch.column(k).to_numpy() for k in (2, 3, 4))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(5).to_pylist()]
            start = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])))) if len(p) else []
            out = []
            for a, b in zip(start, [*start[1:], len(p)]):
                if held and now != (p[a], q[a]):
                    out.append(done())
                    held.clear()
                now = (p[a], q[a])
                held.append((side[a:b], key[a:b], copies[a:b], sets[a:b]))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([done()])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["key", "links", "low"])

    return run


def class_links(docs: DataFrame, text_col: str, classes: DataFrame, levels: np.ndarray, size: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``key``, ``n``, ``copies`` and smallest id ``low`` of every class that isn't empty; and
    ``key``, ``links``, ``low`` of what each pair of blocks found: the
    documents that a class links to in it, and the smallest class they lead to."""
    spark = docs.sparkSession
    sums = classes.agg(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1")), F.sum("n")).first()
    reducers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(sums[0] or 0) // PER_REDUCER))
    hot_from = max(HOT, HOT_SHARE * int(sums[1] or 0) / len(levels))
    packed = _prefixes(docs, text_col, size, num, den, spark.sparkContext.broadcast(levels), reducers, hot_from)
    found = scratch.keep(packed.groupBy("reducer").applyInArrow(_propose(num, den), "a long, b long, gid long"))
    by_key = classes.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("parts").alias("parts"), F.count("*").alias("copies"), F.min("id").alias("low"))
    by_key = scratch.keep(by_key)

    a = by_key.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parts").alias("xa"))
    b = by_key.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("xb"))
    pairs = found.filter("gid is null").select("a", "b").distinct()
    pairs = scratch.keep(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_suffix_filter(num, den), "a long, b long"))
    listed = found.filter("gid is not null").select("gid", F.col("a").alias("key")).distinct()
    need = _needed(pairs, listed, by_key, num, den, scratch)
    scratch.drop(found)
    scratch.drop(pairs)

    dealt = need.join(_sets_of(docs, text_col, size, need.select("key").distinct(), scratch), "key").select("p", "q", "side", "key", "copies", "s").repartition("p", "q").sortWithinPartitions("p", "q")
    return by_key.drop("parts"), scratch.keep(dealt.mapInArrow(_compare(num, den), "key long, links long, low long"))


def _needed(pairs: DataFrame, listed: DataFrame, by_key: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs of blocks ``p``, ``q`` that hold a proposed pair or members of
    one listed group, and the classes they are to compare: ``side``, ``key``, ``copies``."""
    heads = listed.groupBy("gid").agg(F.min("key").alias("home"))
    homes = pairs.select(F.col("a").alias("key"), F.col("a").alias("home")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("home")))
    homes = homes.unionByName(listed.join(heads, "gid").select("key", "home")).groupBy("key").agg(F.min("home").alias("home"))
    # linked sets are of one size range or of neighbouring ones
    who = homes.join(by_key.select("key", "n", "copies"), "key").withColumn("cls", F.floor(F.log("n") / float(np.log(den / num))).cast("int"))
    who = scratch.keep(who)
    sizes = who.groupBy("home", "cls").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_NGRAMS)).cast("int").alias("blocks"))
    who = who.join(sizes.filter("blocks > 1"), ["home", "cls"], "left")
    nth = F.coalesce(F.pmod(F.xxhash64("key"), F.col("blocks")), F.lit(0))
    who = scratch.keep(who.select("key", "copies", "cls", F.xxhash64("home", "cls", nth).alias("block")))

    x = who.select(F.col("key").alias("a"), F.col("block").alias("pa"), F.col("copies").alias("ca"))
    y = who.select(F.col("key").alias("b"), F.col("block").alias("pb"), F.col("copies").alias("cb"))
    met = pairs.join(x, "a").join(y, "b")
    ends = F.explode(F.expr("array(struct(a as key, pa as own, pb as other, ca as copies), struct(b as key, pb as own, pa as other, cb as copies))"))
    met = met.select(ends.alias("e")).select("e.*")
    members = listed.join(who, "key")
    others = members.select("gid", F.col("block").alias("other"), F.col("cls").alias("beside")).distinct()
    crowds = members.join(others, "gid").filter("abs(cls - beside) <= 1").select("key", F.col("block").alias("own"), "other", "copies")
    every = met.unionByName(crowds).distinct()
    return scratch.keep(every.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.expr("cast(own > other as int)").alias("side"), "key", "copies"))


def _sets_of(docs: DataFrame, text_col: str, size: int, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``key`` and its full set ``s``, for the given classes and perhaps some others."""
    sc = docs.sparkSession.sparkContext
    keys = scratch.keep(keys)
    many = keys.count()
    size_of = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * many - 1).bit_length()))
    spot = F.expr(f"pmod(key, {size_of}) + 1")  # Spark's bitmaps number bits from one
    rows = keys.select(F.bitmap_bucket_number(spot).alias("k"), F.bitmap_bit_position(spot).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(size_of // 8, dtype=np.uint8)
    for r in rows:  # size_of / 32768 rows at most
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    wanted = sc.broadcast(bits)

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, blobs = [], []
            for s in _sets(batch, 0, size):
                if not len(s):
                    continue
                k = _print(s)
                p = k % size_of
                if wanted.value[p >> 3] >> (p & 7) & 1 and k not in seen:
                    seen.add(k)
                    keys.append(k)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "s"])

    full = docs.select(F.col(text_col).alias("text")).mapInArrow(sets, "key long, s binary")
    return full.groupBy("key").agg(F.first("s").alias("s"))  # in one shuffle with the join that follows


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``n_links`` for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text
    of fewer words than ``size`` is one shingle; a null or wordless text has
    none, links with nothing and is its own component. Two documents link when
    ``den * intersection >= num * union``. ``component_id`` is the smallest id
    reachable by links, ``n_links`` the number of other rows linked directly. A row with a null id takes part like any other, and
    its component is the smallest id of the others (null if there are none);
    repeated rows link with one another. Other columns are not read, so their
    names may clash with anything. An empty table gives an empty result.

    Sets are compared by 64-bit n-gram hashes, and equal sets are recognised
    by a 64-bit fingerprint of them.
    """
    out = _grouped(docs, id_col, text_col, size, num, den, Scratch(docs.sparkSession, "jaccard"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``id``, ``text_hash``, ``n``, ``component_id``, ``n_links`` and ``component`` (null without words) by row."""
    classes, levels = class_table(docs, id_col, text_col, size, scratch)
    by_key, found = class_links(docs, text_col, classes, levels, size, num, den, scratch)
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("low").alias("b")), scratch)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    each = by_key.join(parts.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    each = scratch.keep(each.select("key", "low", F.coalesce("component", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lowest = each.groupBy("component").agg(F.min("low").alias("component_id"))
    names = each.join(lowest, "component").select("key", "component", "component_id", "n_links")
    shared = classes.filter("n > 0").join(names, "key")
    alone = classes.filter("n = 0").select("*", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    columns = ["id", "text_hash", "n", "component_id", "n_links", "component"]
    return shared.select(*columns).unionByName(alone.select(*columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of ``docs``, as they are, one of each group of linked documents:
    that with the smallest id (of a smaller hash of its text, if ids repeat; a null id comes last).
    Documents without words are in no group, and all stay."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    grouped = scratch.keep(_grouped(docs, id_col, text_col, size, num, den, scratch))
    first = grouped.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("k"))
    keep = first.select(F.col("k.id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.lit(True).alias("_one"))
    empty = grouped.filter("component is null").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(False).alias("_one"))
    keep = scratch.keep(keep.unionByName(empty.distinct()))
    # Row by row, the columns of docs under names that can't clash with those of the join.
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = rows.withColumn("_text", F.xxhash64(f"c{t}"))
    out = rows.join(keep, F.col(f"c{i}").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))
    one = out.filter("_one").withColumn("_nth", nth).filter("_nth = 1")
    columns = [f"c{k}" for k in range(len(docs.columns))]
    return one.select(*columns).unionByName(out.filter("not _one").select(*columns)).toDF(*docs.columns)

"""Perplexity under a class-based bigram model.

A text's words, and an end after each text, form one sequence. Exchange
clustering gives every word of the training texts a class: words begin in
one class (the most frequent ones in classes of their own) and move to the
class in which the classes' bigrams are likeliest. The probability of a word is
that of its class after the class before, times that of the word in its class.

Texts are encoded once, in pieces of some megabytes, as numbers of the piece's
own dictionary. The classes of frequent words, which are few by definition, are
sent to all tasks and exchanged in rounds. All other words meet in buckets of
their hashes, whose number grows with the dictionaries: there a word's counts
from all pieces come together, it is exchanged once, and each piece gets its
class. Nothing that grows with the vocabulary goes through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch
from inkstone.llm.wordhash import LOWER, NOT_SPACE, column_bytes, slices, words

CLASSES = 64
END, REST, OWN = 0, 1, 2  # the end's class, the words' at first, and the first of the frequent words'
UNKNOWN = 255
SHARE = 4096  # a word is frequent if it has this share of the training tokens: at most so many words are
SLICE = 256  # frequent words whose counts are reduced together
ROUNDS = 5
PRIOR = 64.0  # tokens that a class's followers by all classes' frequency weigh
WIDE = 2 * CLASSES  # classes before a word, then classes after it
PIECE = 1 << 22  # bytes of texts that share a dictionary, unless one text is longer
BUCKET = 1 << 15  # words of dictionaries in a bucket, on average
_PACKED = np.dtype([("k", "u1"), ("n", "<u4")])


# ---- texts as numbers -------------------------------------------------------


def encode(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The numbers of all tokens in order, tokens by text, and the distinct words
    by falling count. The end of a text has the number after the last word's."""
    data, offs = column_bytes(col)
    rows, n = len(offs) - 1, len(data)
    low = LOWER[data]
    inside = NOT_SPACE[low]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    before[offs[:-1]] = False
    after[offs[1:]] = False
    start, end = np.flatnonzero(inside & ~before[:n]), np.flatnonzero(inside & ~after[1:]) + 1
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(low[inside].tobytes())])
    coded = words.dictionary_encode()
    local = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(local, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    by_row = np.diff(np.searchsorted(start, offs))
    stream = np.full(len(start) + rows, len(order), dtype=np.uint32)
    stream[np.arange(len(start)) + np.repeat(np.arange(rows), by_row)] = rank[local]
    return stream, by_row + 1, coded.dictionary.take(pa.array(order))


def planes(stream: np.ndarray) -> bytes:
    """First bytes, second bytes, and so on: most of these are zeros, which compress."""
    return stream.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    """A binary column of the pieces of ``data`` between offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


class Piece(NamedTuple):
    """A row of the encoded table."""

    lens: np.ndarray
    held: np.ndarray
    stream: np.ndarray
    words: pa.Array

    def training(self) -> np.ndarray:
        """Which tokens belong to training texts."""
        return np.repeat(~self.held, self.lens)


_FIELDS = ("held", "lens", "stream", "data", "ends")


def _pieces(arrow, first: int = 0):
    """The encoded rows of an Arrow batch whose columns begin at ``first``."""
    for cells in zip(*[arrow.column(first + k) for k in range(5)]):
        held, lens, stream, data, ends = (unpack(c.as_py()) for c in cells)
        yield Piece(np.frombuffer(lens, dtype=np.int64), np.frombuffer(held, dtype=bool), unplanes(stream), _binary(np.frombuffer(ends, dtype=np.int32), data))


def encoded(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """A row for each piece of whole texts: ``batch``, ``ids``, the encoding, and the
    numbers of training tokens, of training texts and of distinct words."""
    kind = docs.schema[id_col].dataType
    held = F.coalesce(F.expr(f"pmod(crc32(cast(`{id_col}` as string)), 7) = 2"), F.lit(False))

    def run(batches):
        for b in batches:
            for first, last in slices(column_bytes(b.column(2))[1], PIECE):
                part = b.slice(first, last - first)
                stream, lens, words = encode(part.column(2))
                ids, held = part.column(0), np.asarray(part.column(1).to_numpy(zero_copy_only=False), dtype=bool)
                data, ends = column_bytes(words)
                cells = [pack(c) for c in (held.tobytes(), lens.astype(np.int64).tobytes(), planes(stream), data.tobytes(), ends.astype(np.int32).tobytes())]
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                sizes = [int(lens[~held].sum()), int((~held).sum()), len(words)]
                yield pa.RecordBatch.from_arrays([listed, *[pa.array([c], pa.binary()) for c in cells], *[pa.array([n], pa.int64()) for n in sizes]], names=["ids", *_FIELDS, "tokens", "texts", "words"])

    schema = f"ids array<{kind.simpleString()}>, " + ", ".join(f"{f} binary" for f in _FIELDS) + ", tokens long, texts long, words long"
    out = docs.select(F.col(id_col), held, F.col(text_col)).mapInArrow(run, schema)
    return scratch.keep(out.withColumn("batch", F.monotonically_increasing_id()))


# ---- buckets of words -------------------------------------------------------


def _dealt(these: pa.Array, buckets: int, whole: list[np.ndarray], more: list[pa.Array] = []) -> tuple[np.ndarray, list[pa.Array]]:
    """Words by buckets of their hashes: the buckets in use, and for each of these the
    words' lengths and bytes, the numbers of ``whole`` (32 bits), and sizes and bytes of ``more``."""
    data, offs = column_bytes(these)
    h = (words(data, offs, np.ones(256, dtype=bool))[0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), dtype=bool), np.diff(h[order]) != 0)))
    bounds = np.concatenate((first, [len(h)]))
    out = []
    for column in (these, *more):
        data, offs = column_bytes(column.take(pa.array(order)))
        out += [_binary(bounds * 4, np.diff(offs).astype(np.int32).tobytes()), _binary(offs[bounds], data.tobytes())]
    for numbers in whole:
        out.append(_binary(bounds * 4, numbers[order].astype(np.int32).tobytes()))
    return h[order][first], out


def _joined(cells: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return np.frombuffer(column_bytes(cells)[0].tobytes(), dtype=kind)


def _met(table: pa.Table, lens: str, data: str) -> tuple[np.ndarray, pa.Array]:
    """The words of a bucket's rows, one after the other, as numbers of its distinct words."""
    sizes = _joined(table.column(lens), np.int32)
    coded = _binary(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), column_bytes(table.column(data))[0].tobytes()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def training_counts(batches: DataFrame, buckets: int, tokens: int) -> DataFrame:
    """For each bucket a row with ``types`` and ``single``: words of training texts, and
    those that occur once; and a row with ``word`` and ``n`` for each frequent word."""

    def run(arrow):
        for a in arrow:
            for b in _pieces(a):
                n = np.bincount(b.stream[b.training()], minlength=len(b.words) + 1)
                there = np.flatnonzero(n[:-1])
                bucket, cells = _dealt(b.words.take(pa.array(there)), buckets, [n[there]])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *cells], names=["bucket", "lens", "data", "n"])

    def add(table: pa.Table) -> pa.Table:
        at, distinct = _met(table, "lens", "data")
        n = np.bincount(at, weights=_joined(table.column("n"), np.int32).astype(np.float64), minlength=len(distinct)).astype(np.int64)
        top = np.flatnonzero(n * SHARE >= tokens)
        none = [None] * len(top)
        return pa.table(
            {
                "types": pa.array([len(n), *none], pa.int64()), "single": pa.array([int((n == 1).sum()), *none], pa.int64()),
                "word": pa.array([None, *distinct.take(pa.array(top)).to_pylist()], pa.binary()), "n": pa.array([None, *n[top].tolist()], pa.int64()),
            }
        )

    rows = batches.select(*_FIELDS).mapInArrow(run, "bucket long, lens binary, data binary, n binary")
    return rows.groupBy("bucket").applyInArrow(add, "types long, single long, word binary, n long")


# ---- exchange ---------------------------------------------------------------


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """Log-likelihood of bigrams of classes, but for a constant of the words' counts."""
    return float(xlogx(n).sum() - xlogx(n.sum(0)).sum() - xlogx(n.sum(1)).sum())


def best_classes(near: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For words with counts of the classes before and after them (rows of
    WIDE), now in classes ``own``: the class in which the bigram counts ``n`` of
    all classes, the word taken out of its own, become likeliest."""
    out = np.empty(len(near), dtype=np.int64)
    for a in range(0, len(near), 512):
        out[a : a + 512] = _best_classes(near[a : a + 512].astype(np.float64), own[a : a + 512], n.astype(np.float64))
    return out


def _best_classes(near: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    at, size = np.arange(len(near)), near[:, :CLASSES].sum(1)
    before, after = near[:, :CLASSES], near[:, CLASSES:]
    gain = np.zeros((len(near), CLASSES))
    for mine, other, cells in ((before, after, n), (after, before, n.T)):
        w, c = np.nonzero(mine)  # only classes that the word has beside it change
        k = mine[w, c]
        base = cells[c]
        base[np.arange(len(w)), own[w]] -= k
        itself = c == own[w]
        base[itself] -= other[w[itself]]
        np.maximum(base, 0, out=base)
        step = xlogx(base + k[:, None]) - xlogx(base)
        used, first = np.unique(w, return_index=True)
        if len(used):
            gain[used] += np.add.reduceat(step, first)
    both = np.broadcast_to(np.diag(n), gain.shape).copy()
    both[at, own] -= before[at, own] + after[at, own]
    np.maximum(both, 0, out=both)
    gain += xlogx(both + before + after) - xlogx(both + before) - xlogx(both + after) + xlogx(both)
    total = np.broadcast_to(n.sum(0), gain.shape).copy()
    total[at, own] -= size
    np.maximum(total, 0, out=total)
    gain -= 2 * (xlogx(total + size[:, None]) - xlogx(total))
    gain[:, END] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[at, best] > gain[at, own] + 1e-9, best, own)


def neighbours(kinds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, the cells of its kind for the classes before and after it;
    the sequence is circular by text, as each begins after an end."""
    prev = np.concatenate(([END], classes[:-1])).astype(np.int64)
    following = np.concatenate((classes[1:], [END])).astype(np.int64)
    return kinds * WIDE + prev, kinds * WIDE + CLASSES + following


def _kinds(b: Piece, frequent: pa.Array) -> np.ndarray:
    """By word of the batch's dictionary and the end: its place among the
    frequent words, or one more for all other words, or two more for the end."""
    place = pc.fill_null(pc.index_in(b.words, value_set=frequent), len(frequent)).to_numpy(zero_copy_only=False)
    return np.concatenate((place, [len(frequent) + 1])).astype(np.int64)


def frequent_neighbours(batches: DataFrame, frequent: pa.Array, classes: np.ndarray) -> np.ndarray:
    """Rows of WIDE counts for each kind of token: the frequent words, all other
    words as one, and the end. Partitions add up their own counts, reducers a slice of the words each."""
    kinds = len(frequent) + 2
    shared = batches.sparkSession.sparkContext.broadcast((frequent, classes))
    slices = -(-kinds // SLICE)

    def run(arrow):
        words, of_kind = shared.value
        total = np.zeros(slices * SLICE * WIDE, dtype=np.int64)
        for a in arrow:
            for b in _pieces(a):
                kind = _kinds(b, words)[b.stream[b.training()]]
                for codes in neighbours(kind, of_kind[kind]):
                    total += np.bincount(codes, minlength=len(total))
        total = total.reshape(slices, -1)
        for k in range(slices):
            there = np.flatnonzero(total[k])
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([there.astype(np.int32).tobytes()], pa.binary()), pa.array([total[k][there].tobytes()], pa.binary())], names=["slice", "cells", "n"])

    def add(arrow):
        sums: dict[int, np.ndarray] = {}
        for a in arrow:
            for k, cells, n in zip(*[c.to_pylist() for c in a.columns]):
                sums.setdefault(k, np.zeros(SLICE * WIDE, dtype=np.int64))[np.frombuffer(cells, dtype=np.int32)] += np.frombuffer(n, dtype=np.int64)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["slice", "n"])

    parts = batches.select(*_FIELDS).mapInArrow(run, "slice int, cells binary, n binary").repartition(slices, "slice")
    out = np.zeros((slices, SLICE, WIDE), dtype=np.int64)
    for r in parts.mapInArrow(add, "slice int, n binary").collect():  # a row for each slice
        out[r["slice"]] = np.frombuffer(r["n"], dtype=np.int64).reshape(SLICE, WIDE)
    return out.reshape(-1, WIDE)[:kinds]


def class_bigrams(near: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES), dtype=np.int64)
    np.add.at(out.T, classes, near[:, :CLASSES])
    return out


def exchange_frequent(batches: DataFrame, frequent: pa.Array, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes by kind and the classes' bigrams. In a round every second
    word may move, so that two words which attract each other don't swap places;
    a round that lowers the likelihood is undone, and is the last."""
    n = len(frequent)
    classes = np.full(n + 2, REST, dtype=np.int64)
    own = min(n, CLASSES - OWN)
    classes[:own] = np.arange(OWN, OWN + own)
    classes[n + 1] = END
    best = None
    for k in range(rounds):
        near = frequent_neighbours(batches, frequent, classes)
        cells = class_bigrams(near, classes)
        value = likelihood(cells)
        if best is not None and value < best[0]:
            break
        best = value, classes, cells
        if not n or k + 1 == rounds:
            break
        may = np.arange(n) % 2 == k % 2
        moved = classes.copy()
        moved[:n][may] = best_classes(near[:n][may], classes[:n][may], cells)
        if (moved == classes).all() and k:
            break
        classes = moved
    return best[1], best[2]


def nearby(b: Piece, kind: np.ndarray, classes: np.ndarray, others: int) -> pa.Array:
    """For each word of a piece's dictionary that isn't frequent: cells of WIDE and their counts."""
    stream = b.stream[b.training()].astype(np.int64)
    rare = (kind == others)[stream]
    codes, n = np.unique(np.concatenate([p[rare] for p in neighbours(stream, classes[kind[stream]])]), return_counts=True)
    packed = np.empty(len(codes), dtype=_PACKED)
    packed["k"], packed["n"] = codes % WIDE, n
    sizes = np.bincount(codes // WIDE, minlength=len(b.words))[: len(b.words)]
    return _binary(np.concatenate(([0], np.cumsum(sizes))) * _PACKED.itemsize, packed.tobytes())


def exchange_others(batches: DataFrame, frequent: pa.Array, classes: np.ndarray, cells: np.ndarray, buckets: int) -> DataFrame:
    """``batch``, ``at``, ``n``, ``class``: for words of each piece that aren't frequent but
    occur in training texts, their places in its dictionary, counts in all
    training texts and classes. Pieces send each bucket its words once."""
    shared = batches.sparkSession.sparkContext.broadcast((frequent, classes, cells))

    def gather(arrow):
        top, of_kind, _ = shared.value
        for a in arrow:
            for place, b in zip(a.column(5).to_pylist(), _pieces(a)):
                kind = _kinds(b, top)
                at = np.flatnonzero(kind[:-1] == len(top))
                near = nearby(b, kind, of_kind, len(top))
                bucket, columns = _dealt(b.words.take(pa.array(at)), buckets, [at], [near.take(pa.array(at))])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), place)), *columns], names=["bucket", "batch", "lens", "data", "sizes", "near", "at"])

    def settle(table: pa.Table) -> pa.Table:
        word, distinct = _met(table, "lens", "data")
        entries = _joined(table.column("near"), _PACKED)
        of_entry = np.repeat(word, _joined(table.column("sizes"), np.int32) // _PACKED.itemsize)
        order = np.argsort(of_entry, kind="stable")
        n, to = np.zeros(len(distinct), dtype=np.int64), np.full(len(distinct), REST, dtype=np.uint8)
        for a in range(0, len(distinct), 4096):
            some = order[slice(*np.searchsorted(of_entry, [a, a + 4096], sorter=order))]
            size = min(4096, len(distinct) - a)
            near = np.bincount((of_entry[some] - a) * WIDE + entries["k"][some], weights=entries["n"][some].astype(np.float64), minlength=size * WIDE).reshape(size, WIDE)
            n[a : a + size] = near[:, :CLASSES].sum(1)
            to[a : a + size] = best_classes(near, np.full(size, REST), shared.value[2])
        at, ends = _joined(table.column("at"), np.int32), np.concatenate(([0], np.cumsum(pc.binary_length(table.column("lens")).to_numpy() // 4)))
        known = n[word] > 0
        left = np.concatenate(([0], np.cumsum(known)))[ends]
        word, at = word[known], at[known]
        return pa.table({"batch": table.column("batch"), "at": _binary(left * 4, at.tobytes()), "n": _binary(left * 8, n[word].tobytes()), "class": _binary(left, to[word].tobytes())})

    rows = batches.select(*_FIELDS, "batch").mapInArrow(gather, "bucket long, batch long, lens binary, data binary, sizes binary, near binary, at binary")
    return rows.groupBy("bucket").applyInArrow(settle, "batch long, at binary, n binary, class binary")


# ---- scores -----------------------------------------------------------------


class Totals(NamedTuple):
    """Of the training texts: tokens, distinct ones, those that occur once."""

    tokens: int
    types: int
    single: int


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.concatenate(([0], np.cumsum(lens)[:-1])))


def with_classes(batches: DataFrame, frequent: pa.Array, counts: np.ndarray, classes: np.ndarray, others: DataFrame, totals: Totals) -> DataFrame:
    """The pieces with ``known``, ``base`` and ``words`` (the logarithms of known
    words' counts) by text, and the class of every token (UNKNOWN for unknown words)."""
    shared = batches.sparkSession.sparkContext.broadcast((frequent, counts, classes))
    kind = batches.schema["ids"].dataType.simpleString()
    names = ("ids", "held", "lens", "known", "base", "words", "classes")

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        top, n_of_kind, class_of_kind = shared.value
        (b,) = (p for a in mine.combine_chunks().to_batches() for p in _pieces(a))
        place = _kinds(b, top)
        n = np.where(place == len(top), 0, n_of_kind[place])
        to = np.where(place == len(top), UNKNOWN, class_of_kind[place]).astype(np.uint8)
        if found.num_rows:
            at = _joined(found.column("at"), np.int32)
            n[at], to[at] = _joined(found.column("n"), np.int64), _joined(found.column("class"), np.uint8)
        tokens = n[b.stream]
        below = np.log10(totals.tokens + totals.types + 1)
        by_text = (_sums((tokens > 0).astype(np.int64), b.lens), _sums(np.log10(tokens + 1.0) - below, b.lens), _sums(np.log10(np.maximum(tokens, 1)), b.lens))
        cells = [b.held.tobytes(), b.lens.tobytes(), *[x.tobytes() for x in by_text], np.where(n > 0, to, UNKNOWN).astype(np.uint8)[b.stream].tobytes()]
        return pa.table([mine.column("ids"), *[pa.array([pack(c)], pa.binary()) for c in cells]], names=names)

    by_batch = batches.select(*_FIELDS, "batch", "ids").groupBy("batch").cogroup(others.groupBy("batch"))
    return by_batch.applyInArrow(run, f"ids {kind}, " + ", ".join(f"{c} binary" for c in names[1:]))


def final_bigrams(classed: DataFrame) -> np.ndarray:
    """Bigrams of the classes of all training tokens."""

    def run(arrow):
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for a in arrow:
            for held, lens, classes in zip(*[map(unpack, c.to_pylist()) for c in a.columns]):
                mine = np.repeat(~np.frombuffer(held, dtype=bool), np.frombuffer(lens, dtype=np.int64))
                to = np.frombuffer(classes, dtype=np.uint8)[mine].astype(np.int64)
                total += np.bincount(np.concatenate(([END], to[:-1])) * CLASSES + to, minlength=len(total)) if len(to) else 0
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["cell", "n"])

    rows = classed.select("held", "lens", "classes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for r in rows:  # at most a row for each pair of classes
        out[r["cell"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


class Model:
    """Logarithms of transitions, less the logarithm of the second class's tokens.

    ``step[c, d]`` is what a known word of class d after class c gets beside the
    logarithm of its count; the last row is for an unknown word before. All
    unknown words are one event, of the training words that occur once.
    """

    def __init__(self, bigrams: np.ndarray, totals: Totals):
        size = bigrams.sum(0).astype(np.float64)
        self.unknown = (totals.single + 1) / (totals.tokens + 2) if totals.tokens else 1.0
        share = size / max(1.0, size.sum())
        after = np.concatenate((bigrams, np.zeros((1, CLASSES))))
        p = (after + PRIOR * share) / (after.sum(1, keepdims=True) + PRIOR)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log10(p) - np.log10(size) + np.log10(1 - self.unknown)
        self.step = np.where(size > 0, step, 0.0)
        self.miss = float(np.log10(self.unknown))

    def scores(self, classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """By text, without the known words' own counts."""
        c = np.where(classes == UNKNOWN, CLASSES, classes).astype(np.int64)
        prev = np.concatenate(([END], c[:-1]))
        each = np.where(c == CLASSES, self.miss, self.step[prev, np.minimum(c, CLASSES - 1)])
        return _sums(each, lens)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` and ``perplexity`` of every row.

    The model learns from rows whose crc32 (of the decimal id) isn't 2 modulo 7;
    a null id isn't held out. Null and empty texts are one end. Repeated
    rows count and come out each. Frequent words of equal counts are taken in
    the order of their bytes, and of classes equally good the first. Without training
    texts every token is unknown and certain (0). An empty table gives none.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "classes")
    batches = encoded(docs, id_col, text_col, scratch)
    tokens, texts, entries = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "texts", "words")]).first()
    buckets = -(-entries // BUCKET) or 1
    seen = scratch.keep(training_counts(batches, buckets, tokens))
    types, single = seen.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "single")]).first()
    totals = Totals(tokens, types + (texts > 0), single + (texts == 1))
    top = seen.filter(F.col("word").isNotNull()).select("word", "n").collect()  # SHARE rows at most
    scratch.drop(seen)
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    frequent = pa.array([bytes(r["word"]) for r in top], pa.binary())
    counts = np.array([r["n"] for r in top] + [0, texts], dtype=np.int64)
    classes, cells = exchange_frequent(batches, frequent, rounds)
    others = exchange_others(batches, frequent, classes, cells, buckets)
    classed = scratch.keep(with_classes(batches, frequent, counts, classes, others, totals))
    scratch.drop(batches)
    shared = spark.sparkContext.broadcast(Model(final_bigrams(classed), totals))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(arrow):
        for a in arrow:
            for k in range(a.num_rows):
                held, lens, known, base, words, classes = (unpack(a.column(c)[k].as_py()) for c in range(1, 7))
                n = np.frombuffer(lens, dtype=np.int64)
                score = np.frombuffer(words, dtype=np.float64) + shared.value.scores(np.frombuffer(classes, dtype=np.uint8), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        a.column(0)[k].values,
                        pa.array(np.frombuffer(held, dtype=bool)),
                        pa.array(n),
                        pa.array(np.frombuffer(known, dtype=np.int64)),
                        pa.array(np.full(len(n), totals.tokens, dtype=np.int64)),
                        pa.array(np.frombuffer(base, dtype=np.float64)),
                        pa.array(score),
                        pa.array(np.power(10.0, np.minimum(-score / n, 300))),
                    ],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return classed.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

"""Verbatim overlap of training documents with a benchmark, by suffix arrays.

Each slice of documents is a shard. A shard's suffix array holds, in sorted
order, the word suffixes that a test window can match at all; every suffix of
every test item is looked up in it by binary search. That gives all places
where a window of the item occurs, and from there the longest verbatim matches
and the share of each document that test items cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.llm.scratch import bounded_batches
from inkstone.llm.wordhash import ALNUM, U64, column_bytes, mix, slices, windows, words

WINDOW = 13
INDEX_BYTES = 32 << 20  # of benchmark text in one broadcast; more goes in several


class TestIndex:
    """Windows of test items, over a vocabulary of their words."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.window = window
        data, offs = column_bytes(pa.array(texts, pa.string()))
        h, _, _, first = words(data, offs, ALNUM)
        self.vocabulary = np.unique(h)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & U64(0xFFFF)).astype(np.int64)] = True
        self.names = ids
        self.items = [np.searchsorted(self.vocabulary, h[a:b]).astype(np.uint32) + 1 for a, b in zip(first[:-1], first[1:])]
        self.shortest = min((min(window, len(x)) for x in self.items if len(x)), default=0)
        found: dict[bytes, list[tuple[int, int]]] = {}
        lengths: dict[bytes, int] = {}
        for i, x in enumerate(self.items):
            w = min(window, len(x))
            for j in range(len(x) - w + 1 if w else 0):
                key = x[j : j + w].astype(">u4").tobytes()
                found.setdefault(key, []).append((i, j))
                lengths[key] = w
        keys = sorted(found)
        self.width = np.array([lengths[k] for k in keys], dtype=np.int64)
        self.at = [found[k] for k in keys]
        low = [k.ljust(4 * window, b"\0") for k in keys]
        high = [(k[:-4] + (int.from_bytes(k[-4:], "big") + 1).to_bytes(4, "big")).ljust(4 * window, b"\0") for k in keys]
        self.low, self.high = (np.array(x, dtype=f"S{4 * window}") for x in (low, high))
        if self.shortest:
            heads = np.array([np.frombuffer(k[: 4 * self.shortest], dtype=">u4") for k in keys], dtype=np.uint64)
            self.heads = np.unique(np.concatenate([windows(mix(x), self.shortest) for x in heads]))

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary from 1; 0 for other words."""
        out = np.zeros(len(h), dtype=np.uint32)
        some = np.flatnonzero(self.maybe[(h & U64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[some])
        hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h[some]
        out[some[hit]] = at[hit] + 1
        return out

    def occurrences(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in a shard at which windows occur, and the windows.
        ``first``: first word of each row, and the number of words at the end."""
        none = np.zeros(0, dtype=np.int64)
        k = self.shortest
        if not k or len(ids) < k:
            return none, none
        end = np.repeat(first[1:], np.diff(first))
        stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], end)
        at = np.flatnonzero(stop - np.arange(len(ids)) >= k)
        if not len(at):
            return none, none
        head = windows(mix(ids.astype(np.uint64)), k)[at]
        place = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        at = at[self.heads[place] == head]
        if not len(at):
            return none, none
        reach = at[:, None] + np.arange(self.window)
        suffix = np.where(reach < end[at][:, None], ids[np.minimum(reach, len(ids) - 1)], 0)
        suffix = np.ascontiguousarray(suffix.astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(suffix, kind="stable")
        array = suffix[order]
        a, b = np.searchsorted(array, self.low), np.searchsorted(array, self.high)
        n = b - a
        which = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return at[order[a[which] + nth]], which


def load_index(bench: DataFrame, id_col: str, text_col: str, window: int = WINDOW, most_bytes: int = INDEX_BYTES) -> list[TestIndex]:
    """Indexes of the benchmark, each over at most ``most_bytes`` of text (or one item)."""
    out, ids, texts, held = [], [], [], 0
    for r in bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        size = len((r["t"] or "").encode())
        if ids and held + size > most_bytes:
            out.append(TestIndex(ids, texts, window))
            ids, texts, held = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        held += size
    return out + [TestIndex(ids, texts, window)]


def _shards(col, indexes):
    """For each shard: its first row, the number of words by row, and for each
    index the ids, positions and windows found."""
    data, offs = column_bytes(col)
    for a, b in slices(offs):
        h, start, end, first = words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ALNUM)
        yield a, b, first, start, end, (lambda h=h, first=first: ((x, ids := x.word_ids(h), *x.occurrences(ids, first)) for x in indexes()))


def _overlaps(col, indexes):
    """Words, hit words and sorted names of items by row of a column."""
    for a, b, first, _, _, found in _shards(col, indexes):
        cover = np.zeros(first[-1] + 1, dtype=np.int64)
        names: dict[int, set[str]] = {}
        for x, _, at, which in found():
            np.add.at(cover, at, 1)
            np.add.at(cover, at + x.width[which], -1)
            row = np.searchsorted(first, at, "right") - 1
            for r, w in set(zip(row.tolist(), which.tolist())):
                names.setdefault(r, set()).update(x.names[i] for i, _ in x.at[w] if x.names[i] is not None)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
        for r in range(b - a):
            yield int(first[r + 1] - first[r]), int(hit[first[r + 1]] - hit[first[r]]), sorted(names.get(r, ()))


def is_contaminated(n_words: int, n_hit: int, one_in: int = 20) -> bool:
    return n_hit > 0 and one_in * n_hit >= n_words


def _reader(docs: DataFrame, bench: DataFrame, item_col: str, bench_text_col: str, window: int):
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(x) for x in load_index(bench, item_col, bench_text_col, window)]
    return lambda: (b.value for b in shared)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` by row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. An item's
    windows are its runs of ``window`` words, or all of it if it is shorter; a
    document word inside any occurrence of a window is hit. A document is
    contaminated if hit words are a twentieth of its words or more. Null and
    empty texts have no words and are clean; items without words match
    nothing; an item with a null id hits words but isn't named; items of
    one id count once. Repeated and null document ids stay as they are; an
    empty benchmark leaves everything clean. Other columns aren't read.
    """
    indexes = _reader(docs, bench, item_col, bench_text_col, window)

    def run(batches):
        for batch in batches:
            rows = list(_overlaps(batch.column(1), indexes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([k for _, k, _ in rows], pa.int64()),
                    pa.array([len(x) for _, _, x in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in rows], pa.string()),
                    pa.array([is_contaminated(n, k) for n, k, _ in rows], pa.bool_()),
                ],
                names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without contaminated ones."""
    indexes = _reader(docs, bench, item_col, bench_text_col, window)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean = [not is_contaminated(n, k) for n, k, _ in _overlaps(batch.column(place), indexes)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every maximal verbatim match of at least a window: ids, first word in the
    item and in the document, number of words, and byte range in the document."""
    indexes = _reader(docs, bench, item_col, bench_text_col, window)
    names = [id_col, "item_id", "item_word", "doc_word", "n_words", "first_byte", "end_byte"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            rows = []
            for a, _, first, start, end, found in _shards(batch.column(1), indexes):
                base = column_bytes(batch.column(1))[1]
                for x, ids, at, which in found():
                    for p, w in zip(at.tolist(), which.tolist()):
                        r = int(np.searchsorted(first, p, "right")) - 1
                        for i, j in x.at[w]:
                            item = x.items[i]
                            if j > 0 and p > first[r] and ids[p - 1] == item[j - 1]:
                                continue  # part of a match that begins earlier
                            n = int(x.width[w])
                            while j + n < len(item) and p + n < first[r + 1] and ids[p + n] == item[j + n]:
                                n += 1
                            rows.append(a + r)
                            shift = int(base[a] - base[a + r])
                            for o, v in zip(out, (x.names[i], j, p - int(first[r]), n, int(start[p]) + shift, int(end[p + n - 1]) + shift)):
                                o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.string()), *(pa.array(o, pa.int64()) for o in out[1:])], names=names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in names[2:])])
    return docs.select(id_col, text_col).mapInArrow(run, schema)

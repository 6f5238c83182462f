"""Document quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are embedded; learned filters of 8 bytes slide over all
of them by 4. Chunks of 512 bytes, overlapping by half, cover the whole text;
each filter's maximum is taken in each chunk. Mean, maximum and minimum over
the chunks go through a hidden layer into one probability. The minimum and the
mean let the network see what is missing in some chunk, such as the variety of
letters of ordinary prose.

The network is fitted by one task on a bounded number of labelled rows, which
it reads as a stream, one epoch after the other; texts are whole and of any
length, and what a step holds is bounded by one text.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch, bounded_batches
from inkstone.llm.wordhash import column_bytes, slices

STEP = 4  # bytes between windows; a window is two steps
HALF = 64  # windows in half a chunk
DIM, FILTERS, HIDDEN = 8, 32, 16
BLOCK = 1024  # half-chunks that are convolved at once
EPOCHS, BATCH, LEAST_STEPS = 6, 48, 240  # of training; so many steps, however few rows there are


class ByteConvNet:
    """``Trainer`` fits it; ``scores`` of rows of bytes."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)),
            "conv": r.normal(0, 0.3, (2 * STEP * DIM, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hid": r.normal(0, 0.15, (3 * FILTERS, HIDDEN)),
            "hid0": np.zeros(HIDDEN),
            "out": r.normal(0, 0.3, HIDDEN),
            "out0": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    @staticmethod
    def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows padded with zero bytes to whole half-chunks; halves by row."""
        n = np.diff(offsets)
        halves = np.maximum(1, -(-n // (HALF * STEP)))
        out = np.zeros(int(halves.sum()) * HALF * STEP, dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum(halves)[:-1])) * HALF * STEP
        shift = np.repeat(at - offsets[:-1], n)
        out[np.arange(len(data)) + shift] = data
        return out, halves

    def _maxima(self, b: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum in each half-chunk, and the window that has it. A
        window of two steps doesn't reach into the next row."""
        p = self.p
        w = np.concatenate((p["conv"][: STEP * DIM], p["conv"][STEP * DIM :]), axis=1)
        total, ends = int(halves.sum()), np.cumsum(halves)
        half, best = np.empty((total, FILTERS), dtype=w.dtype), np.empty((total, FILTERS), dtype=np.int64)
        for first in range(0, total, BLOCK):
            last = min(total, first + BLOCK)
            n = (last - first) * HALF
            a = p["emb"][b[first * HALF * STEP : (last * HALF + 1) * STEP]].reshape(-1, STEP * DIM) @ w
            c = a[:n, :FILTERS].copy()
            c[: len(a) - 1] += a[1 : n + 1, FILTERS:]
            cut = ends[np.searchsorted(ends, first + 1) : np.searchsorted(ends, last, "right")]
            cut = (cut[cut < total] - first) * HALF
            c[cut - 1] -= a[cut, FILTERS:]
            c = c.reshape(-1, HALF, FILTERS)
            half[first:last] = c.max(1)
            best[first:last] = c.argmax(1) + np.arange(first, last)[:, None] * HALF
        return half, best

    def _forward(self, data, offsets, train=False):
        p = self.p
        b, halves = self._layout(data, offsets)
        half, best = self._maxima(b, halves)
        first = np.concatenate(([0], np.cumsum(halves)[:-1]))
        chunks = np.maximum(1, halves - 1)
        start = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        left = np.arange(int(chunks.sum())) + np.repeat(first - start, chunks)
        right = np.minimum(left + 1, np.repeat(first + halves - 1, chunks))
        top = np.maximum(half[left], half[right])
        pooled = np.maximum(top + p["bias"], 0)
        g = np.concatenate(
            (np.add.reduceat(pooled, start) / chunks[:, None].astype(np.float32), np.maximum.reduceat(pooled, start), np.minimum.reduceat(pooled, start)), axis=1
        )
        h = np.tanh(g @ p["hid"] + p["hid0"])
        s = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out0"], -30, 30)))
        if not train:
            return s
        return s, (b, halves, half, best, left, right, pooled, g, h, chunks, start)

    def _gradients(self, data, offsets, target, weight=None):
        """Of the weighted log losses' sum; without weights of their mean."""
        p = self.p
        s, (b, halves, half, best, left, right, pooled, g, h, chunks, start) = self._forward(data, offsets, True)
        d = ((s - target) * (1 / len(target) if weight is None else weight)).astype(np.float32)
        out = {"out": h.T @ d, "out0": d.sum(keepdims=True)}
        dh = d[:, None] * p["out"] * (1 - h * h)
        out |= {"hid": g.T @ dh, "hid0": dh.sum(0)}
        dg = dh @ p["hid"].T
        row = np.repeat(np.arange(len(chunks)), chunks)
        dp = dg[row, :FILTERS] / chunks[row, None].astype(np.float32)
        for part in (1, 2):  # the chunks that gave the maximum and the minimum
            is_best = pooled == g[:, part * FILTERS : (part + 1) * FILTERS][row]
            share = np.add.reduceat(is_best.astype(np.float32), start)
            dp += is_best * (dg[:, part * FILTERS : (part + 1) * FILTERS] / share)[row]
        dp *= pooled > 0
        out["bias"] = dp.sum(0)
        window = np.where(half[left] >= half[right], best[left], best[right])
        last = np.zeros(int(halves.sum()) * HALF + 1, dtype=bool)
        last[np.cumsum(halves) * HALF - 1] = True  # windows of one step, at the rows' ends
        padded = np.concatenate((b, np.zeros(STEP, dtype=np.uint8)))
        conv = np.zeros_like(p["conv"])
        emb = np.zeros((256, DIM), dtype=np.float64)
        for f in range(FILTERS):
            used = np.flatnonzero(dp[:, f])
            at, inverse = np.unique(window[used, f], return_inverse=True)  # chunks share windows
            grad = np.bincount(inverse, weights=dp[used, f], minlength=len(at))
            both = np.stack((grad, np.where(last[at], 0, grad)))
            seen = padded[at[:, None] * STEP + np.arange(2 * STEP)]
            for k in range(2 * STEP):
                by_byte = np.bincount(seen[:, k], weights=both[k // STEP], minlength=256)
                emb += by_byte[:, None] * p["conv"][k * DIM : (k + 1) * DIM, f]
                conv[k * DIM : (k + 1) * DIM, f] = by_byte @ p["emb"]
        emb[0] = 0  # padding
        return s, out | {"conv": conv, "emb": emb.astype(np.float32)}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every byte is read."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        out = [self._forward(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 1 << 18)]
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


class Trainer:
    """Adam on the log loss over a stream of rows; a step is taken after each BATCH of them."""

    def __init__(self, net: ByteConvNet, steps: int, rate: float = 4e-3):
        self.net, self.steps, self.rate, self.done = net, steps, rate, 0
        net.p["emb"][0] = 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}
        self._clear()

    def _clear(self):
        self.rows, self.weight, self.sums = 0, 0.0, {k: np.zeros_like(v) for k, v in self.net.p.items()}

    def feed(self, data: np.ndarray, offsets: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        first = 0
        while first < len(target) and self.done < self.steps:
            last = min(len(target), first + BATCH - self.rows)
            _, grads = self.net._gradients(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], target[first:last], weight[first:last])
            for k, g in grads.items():
                self.sums[k] += g
            self.rows += last - first
            self.weight += float(weight[first:last].sum())
            first = last
            if self.rows == BATCH:
                self._step()

    def _step(self) -> None:
        self.done += 1
        t = self.done
        lr = self.rate * min(1, t / 20) * 0.5 * (1 + np.cos(np.pi * min(1, t / self.steps)))
        for k, g in self.sums.items():
            g = g / self.weight
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.002 * (g * g - self.v[k])
            self.net.p[k] -= (lr * (self.m[k] / (1 - 0.9**t)) / (np.sqrt(self.v[k] / (1 - 0.998**t)) + 1e-7)).astype(np.float32)
        self._clear()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 700) -> DataFrame:
    """``i``, ``h``, ``y``, ``t``: at most ``per_class`` rows of each class with their whole
    texts, drawn by a hash of id and text among the labelled rows of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality", "snappy")
    by_id = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1) and pmod(crc32(cast(i as string)), 3) <> 1")
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("i", "t"))
    known = scratch.keep(texts.select("i", "h").join(by_id.groupBy("i").agg(F.max("y").alias("y")), "i").dropDuplicates(["i", "h"]))
    picked = None
    for k in (0, 1):
        some = known.filter(f"y = {k}").orderBy(F.xxhash64(F.lit("quality"), "i", "h"), "i").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    out = scratch.keep(texts.join(F.broadcast(picked), ["i", "h"]).dropDuplicates(["i", "h"]))  # 2 * per_class rows at most
    scratch.drop(known)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 700) -> ByteConvNet:
    """Fits on at most ``per_class`` labelled rows of each class, whole texts of any length.

    Only ids whose crc32 (of the decimal text) isn't 1 modulo 3 take part. Rows of
    one id and text count once; an id with both labels counts as 1. Both classes
    weigh the same. Without texts of two classes every score is the share of
    label 1 (a half without rows). Ties of the draw go to the smaller id.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    rows, net = sum(sizes.values()), ByteConvNet()
    if len(sizes) < 2:
        net.constant = sizes.get(1, 0) / rows if rows else 0.5
        return net
    steps = max(LEAST_STEPS, EPOCHS * 2 * max(sizes.values()) // BATCH)
    epochs = -(-steps * BATCH // rows)
    share = {y: rows / (2 * n) for y, n in sizes.items()}

    def run(batches):
        trainer = Trainer(ByteConvNet(), steps)
        for b in batches:
            data, offs = column_bytes(b.column(0))
            y = b.column(1).to_numpy()
            w = np.where(y == 1, share[1], share[0])
            for first, last in slices(offs, 1 << 18):
                trainer.feed(data[offs[first] : offs[last]], offs[first : last + 1] - offs[first], y[first:last], w[first:last])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trainer.net.p)], pa.binary())], names=["model"])

    bounded_batches(docs.sparkSession)
    stream = sample.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("e", F.xxhash64("e", "i", "h"), "i")
    net.p = pickle.loads(stream.select("t", "y").mapInArrow(run, "model binary").first()["model"])
    return net


def score_quality(docs: DataFrame, model: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` for each row.

    Null and empty texts get the network's score of no bytes. A null id isn't
    held out. Repeated rows get equal scores; other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.scores(*column_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    held = F.coalesce(F.expr(f"pmod(crc32(cast(`{id_col}` as string)), 3) = 1"), F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held.alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: ByteConvNet, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is at least ``least``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(*column_bytes(batch.column(place))) >= least))

    return docs.mapInArrow(run, docs.schema)

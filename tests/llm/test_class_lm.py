import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import class_lm
from inkstone.llm.scratch import Scratch

SPACE = re.compile("[\x20\x09-\x0d]+")


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(low) if w] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def corpus(prose):
    """Names follow titles, verbs follow names: classes that exchange should find."""
    r = np.random.default_rng(5)
    groups = [[f"{g}{k}" for k in range(30)] for g in ("title", "name", "verb", "thing")]
    docs = []
    for i in range(400):
        words = [groups[k % 4][int(r.integers(30))] for k in range(int(r.integers(4, 60)))]
        docs.append((i, " ".join(words)))
    return docs + [(1000, None), (1001, ""), (1002, "  \t"), (1003, "Title1 NAME2 çédille x"), (None, "title3 name4"), (5, docs[5][1]), (1004, "verb1 " * 40000)]


def score(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_tokens int, batch string")
    return class_lm.score_texts(df.repartition(3), **kw).collect()


def test_counts_and_base_by_brute_force(spark, corpus):
    count = Counter(w for i, t in corpus if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in corpus)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in score(spark, corpus))
    assert got == want


def test_score_is_the_models_by_brute_force(spark, corpus):
    """All steps are told from the classes; the score is then that of plain Python."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    batches = class_lm.encoded(df, "doc_id", "text", scratch)
    count = Counter(w for i, t in corpus if not held(i) for w in tokens(t))
    n = sum(count.values())
    top = sorted((w for w in count if w is not None and count[w] * class_lm.SHARE >= n), key=lambda w: (-count[w], w.encode()))
    frequent = pa.array([w.encode() for w in top], pa.binary())
    classes, cells = class_lm.exchange_frequent(batches, frequent)
    of = dict(zip(top, classes.tolist())) | {None: class_lm.END}
    words = {r["batch"]: p.words.to_pylist() for r in batches.toArrow().to_batches() for r, p in zip(r.select(["batch"]).to_pylist(), class_lm._pieces(r, 1))}
    others = {}
    for r in class_lm.exchange_others(batches, frequent, classes, cells, 3).collect():
        cells = [np.frombuffer(bytes(r[c]), dtype=k).tolist() for c, k in (("at", np.int32), ("n", np.int64), ("class", np.uint8))]
        others |= {words[r["batch"]][i].decode(): (k, c) for i, k, c in zip(*cells)}
    assert {w: k for w, (k, _) in others.items()} == {w: c for w, c in count.items() if w is not None and w not in of}
    of |= {w: c for w, (_, c) in others.items()}
    pairs = Counter((of[a], of[b]) for i, t in corpus if not held(i) for a, b in zip([None] + tokens(t), tokens(t)))
    left, size = Counter(), Counter()
    for (a, b), k in pairs.items():
        left[a] += k
        size[b] += k
    miss = (sum(c == 1 for c in count.values()) + 1) / (n + 2)

    def p(a, b):
        if b not in of:
            return miss
        before = of.get(a)
        share = size[of[b]] / n
        step = (pairs[before, of[b]] + class_lm.PRIOR * share) / (left[before] + class_lm.PRIOR) if before is not None else share
        return (1 - miss) * step * count[b] / size[of[b]]

    want = sorted((str(i), float(sum(math.log10(p(a, b)) for a, b in zip([None] + tokens(t), tokens(t))))) for i, t in corpus)
    got = score(spark, corpus)
    for (i, x), (j, y) in zip(sorted((str(r["doc_id"]), r["score"]) for r in got), want, strict=True):
        assert i == j and x == pytest.approx(y, rel=1e-9)
    # Probabilities of all known words and the unknown one after any word add up to 1.
    for a in ("title1", None, "never seen"):
        assert abs(sum(p(a, b) for b in count) + miss - 1) < 1e-9
    # Classes hold words of one group, and the held-out texts gain from that.
    members = {}
    for w, c in of.items():
        if w and w.rstrip("0123456789") in ("title", "name", "verb", "thing"):
            members.setdefault(c, Counter())[w.rstrip("0123456789")] += 1
    shared = [m for m in members.values() if sum(m.values()) > 1]
    assert sum(max(m.values()) for m in shared) > 0.85 * sum(sum(m.values()) for m in shared) and len(shared) > 10
    out = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.2 * sum(r["n_tokens"] for r in out)


def test_rounds_raise_the_likelihood(spark, corpus):
    batches = class_lm.encoded(spark.createDataFrame(corpus, "doc_id long, text string"), "doc_id", "text", Scratch(spark, "test"))
    words = sorted({w.encode() for _, t in corpus for w in tokens(t) if w and w[0] in "tnv"})
    frequent = pa.array(words, pa.binary())
    values = [class_lm.likelihood(class_lm.exchange_frequent(batches, frequent, k)[1].astype(float)) for k in (1, 2, 5)]
    assert values[0] < values[1] < values[2]


def test_gain_is_the_change_of_likelihood():
    r = np.random.default_rng(4)
    cells = r.integers(0, 50, (class_lm.CLASSES, class_lm.CLASSES))
    cells += cells.T  # as many tokens after a class as in it
    near = np.zeros((1, class_lm.WIDE), dtype=np.int64)
    near[0, r.choice(np.arange(10, class_lm.CLASSES), 5, replace=False)] = 7
    near[0, class_lm.CLASSES + r.choice(np.arange(10, class_lm.CLASSES), 5, replace=False)] = 7
    without = cells.copy()
    cells[:, 3] += near[0, : class_lm.CLASSES]
    cells[3] += near[0, class_lm.CLASSES :]

    def after(b):
        out = without.copy()
        out[:, b] += near[0, : class_lm.CLASSES]
        out[b] += near[0, class_lm.CLASSES :]
        return class_lm.likelihood(out.astype(float))

    assert class_lm.best_classes(near, np.array([3]), cells)[0] == max(range(1, class_lm.CLASSES), key=after)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(2, "a b")], [(k, "x") for k in range(20) if held(k)]])
def test_hardly_anything(spark, docs):
    got = score(spark, docs)
    assert len(got) == len(docs)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    if docs and all(held(i) for i, _ in docs):
        assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in got)


def test_numbers_survive_their_planes():
    x = np.array([0, 1, 255, 256, 70000, 2**31], dtype=np.uint32)
    assert (class_lm.unplanes(class_lm.planes(x)) == x).all() and len(class_lm.unplanes(b"")) == 0

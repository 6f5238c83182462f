import zlib

import numpy as np
import pytest

from inkstone.llm import quality_cnn
from tests.llm.conftest import rows


def corpus(prose, n=240):
    docs, labels = [], []
    for i in range(n):
        good = prose(i, 20 + i % 60)
        bad = [" ".join(w.upper() + "!!" for w in good.split()), " ".join([good.split()[0]] * 60), " | ".join(good.split())][i % 3]
        docs.append((i, good if i % 2 else bad))
        labels.append((i, i % 2))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, prose):
    docs, labels = corpus(prose)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_cnn.train(d, y)
    out = quality_cnn.score_quality(d.selectExpr("*", "1 as quality", "2 as score"), model).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in docs}
    held = [r for r in out if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    kept = quality_cnn.keep_good(d, model)
    assert kept.schema == d.schema and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["predicted"]}


def test_scores_do_not_depend_on_neighbouring_rows():
    r = np.random.default_rng(0)
    texts = [r.integers(1, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 7, 255, 256, 257, 600, 5000, 0)]
    model = quality_cnn.ByteConvNet()

    def scores(rows):
        return model.scores(np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in rows]))))

    together, alone = scores(texts), np.concatenate([scores([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_the_whole_text_counts():
    model = quality_cnn.ByteConvNet()
    long = b"a" * 100_000
    data = np.frombuffer(long + long + b"\xff\x10#@" * 40, dtype=np.uint8)
    s = model.scores(data, np.array([0, len(long), len(data)]))
    assert abs(s[0] - s[1]) > 1e-6


def test_gradients_match_differences():
    r = np.random.default_rng(3)
    texts = [r.integers(1, 256, n).astype(np.uint8).tobytes() for n in (40, 700, 1500)]
    data, offs = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    y = np.array([0, 1, 1], dtype=np.float32)
    model = quality_cnn.ByteConvNet()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model._gradients(data, offs, y)

    def loss():
        s = model._forward(data, offs)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k in ("conv", "bias", "hid", "out", "emb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = model.p[k][at]
        model.p[k][at] = was + 1e-5
        up = loss()
        model.p[k][at] = was - 1e-5
        down = loss()
        model.p[k][at] = was
        assert abs((up - down) / 2e-5 - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), k


def test_odd_rows_and_missing_labels(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 200_000), (3, "z")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_cnn.score_quality(d, quality_cnn.train(d, none)).collect()} == {0.5}
    free = [i for i in range(1, 4) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert free
    ones = spark.createDataFrame([(i, 1) for i in [1, 2, 3, 3, 9]] + [(None, 0), (1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_cnn.score_quality(d, quality_cnn.train(d, ones)).collect()} == {1.0}
    assert quality_cnn.score_quality(d.limit(0), quality_cnn.ByteConvNet()).collect() == []
    assert rows(quality_cnn.score_quality(d, quality_cnn.ByteConvNet()), "doc_id", "held_out")[-1] == (None, False)


def test_a_class_of_long_texts_only_is_learned(spark, prose, monkeypatch):
    monkeypatch.setattr(quality_cnn, "LEAST_STEPS", 40)
    docs = [(i, prose(i, 40)) for i in range(12)] + [(100 + i, "buy now !!! " * 2000) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, quality int")
    model = quality_cnn.train(df, labels)
    assert model.constant is None
    # Without texts of one of the classes there is nothing to tell apart.
    assert quality_cnn.train(df.filter("doc_id < 100"), labels).constant == 1.0
    assert quality_cnn.train(df.limit(0), labels).constant == 0.5


def test_the_end_of_a_very_long_text_is_learned_from(spark, monkeypatch):
    """Texts that differ only behind their first 70,000 characters."""
    monkeypatch.setattr(quality_cnn, "LEAST_STEPS", 60)
    monkeypatch.setattr(quality_cnn, "BATCH", 16)
    docs = [(i, "calm water " * 7_000 + ["good old prose " * 40, "!!! $$$ ### " * 50][i % 2]) for i in range(16)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score_quality(df, quality_cnn.train(df, labels)).collect()}
    assert min(got[i] for i in got if i % 2 == 0) > max(got[i] for i in got if i % 2)


def test_training_does_not_depend_on_the_order_of_rows(spark, prose):
    docs, labels = corpus(prose, 60)
    docs += docs[:9] + [(docs[3][0], "another text of the same id")]
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    one, two = (quality_cnn.labelled_sample(spark.createDataFrame(d, "doc_id long, text string").repartition(n), y, per_class=12) for d, n in ((docs, 2), (docs[::-1], 5)))
    assert rows(one, "i", "h", "y", "t") == rows(two, "i", "h", "y", "t")
    assert rows(one.groupBy("y").count(), "y", "count") == [(0, 12), (1, 12)]

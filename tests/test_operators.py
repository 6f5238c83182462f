"""Operators on small tables, with nulls, ties and odd shapes."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkstone.operators import authorship, evaluation, features, lexical, statistics, training
from inkstone.sources import files, samples, sinks
from inkstone.streaming import documents as stream

TEXTS = [(1, None), (2, ""), (3, " \n "), (4, "One word."), (5, "word " * 60), (None, "A text. Of two sentences."), (6, "Zürich — naïve… “quotes”. Next one! Third? Fourth one here. Fifth, and last of all."), (1, "again")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as words", "'x' as tokens", "2.0 as p")


def test_blank_texts_are_unknown(spark, docs):
    out = {(r["doc_id"], r["words"]): r for r in authorship.analyze(docs).collect()}
    assert len(out) == len(TEXTS)
    for k in (1, 2, 3):
        assert (out[k, 0]["verdict"], out[k, 0]["ai_probability"], out[k, 0]["confidence"]) == ("Unknown", 0, 0)
    assert out[5, 60]["slope"] is None and out[5, 60]["n_sentences"] == 1
    assert all(0 <= r["ai_probability"] <= 1 for r in out.values())
    assert authorship.analyze(docs).filter("ai_probability > 0.99").count() == 0
    assert {r["doc_id"] for r in authorship.findings(docs).collect()} == {1, 4, 5, 6, None}


@pytest.mark.parametrize("operator", [statistics.vocabulary, statistics.sequence_statistics, statistics.adjacent_similarity, features.classic_features, lexical.word_shapes, lexical.readability, statistics.segment_counts])
def test_one_finite_row_for_each_document(docs, operator):
    rows = operator(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(v == v and abs(v) != float("inf") for r in rows for v in r.asDict().values() if isinstance(v, float))
    assert operator(docs.limit(0)).collect() == []


def test_top_words_and_phrases_order_ties(spark):
    df = spark.createDataFrame([(1, "b a c a b d e f g h"), (2, None)], "doc_id long, text string")
    got = [(r["rank"], r["word"], r["n"]) for r in sorted(statistics.top_words(df, 3).collect(), key=lambda r: r["rank"])]
    assert got == [(1, "b", 2), (2, "a", 2), (3, "c", 1)]
    df = spark.createDataFrame([(1, "w x y z. " * 3)], "doc_id long, text string")
    best = min(statistics.repeated_phrases(df).collect(), key=lambda r: r["rank"])
    assert (best["phrase"], best["n"], best["weight"]) == ("w x y z", 3, 12)


def test_metrics(spark):
    data = [(1, 0.9, "a"), (1, 0.4, "a"), (0, 0.6, "b"), (0, 0.1, None), (0, 0.4, "b")]
    p = spark.createDataFrame(data, "label int, p double, g string")
    m = evaluation.metrics(p).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 1, 2) and m["accuracy"] == 0.6 and m["sure_share"] == 0.4 and m["sure_accuracy"] == 1
    by = {(r["breakdown"], r["value"]): r["accuracy"] for r in evaluation.metrics_by(p, ["g"]).collect()}
    assert by == {("all", None): 0.6, ("g", "a"): 0.5, ("g", "b"): 0.5, ("g", None): 1.0}
    assert evaluation.auc(p).first()["auc"] == pytest.approx((3 + 1.5) / 6)
    assert evaluation.auc(p.limit(0)).first()["auc"] == 0.5 and evaluation.metrics(p.limit(0)).first()["f1"] == 0
    two = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.1, 0.6), (1, 0.7, 0.4), (0, 0.2, 0.3)], "label int, a double, b double")
    w = {round(r["weight"], 1): r for r in evaluation.best_weights(two, "a", "b").collect()}
    assert w[0.9]["f1"] == 1 and sum(r["is_best"] for r in w.values()) == 1 and w[0.5]["is_best"] == (w[0.5]["f1"] == 1 and all(w[k / 10]["f1"] < 1 for k in range(1, 5)))
    assert evaluation.disagreements(two, "a", "b").count() == 3


def test_samples(spark):
    long = "w " * 30
    df = spark.createDataFrame([(long, "Human"), (long, "GPT"), ("short", "ai"), (long, "?"), (None, "ai")], "content string, category string")
    got = samples.labelled(df, "s")
    assert sorted(r["label"] for r in got.collect()) == [0, 1] and samples.labelled(df.select("category"), "s").count() == 0
    pairs = spark.createDataFrame([(long, [long, "x", None]), (None, None)], "h string, m array<string>")
    assert sorted(r["label"] for r in samples.paired(pairs, "s", "h", "m").collect()) == [0, 1]
    many = spark.createDataFrame([(f"t{i}", int(i % 4 == 0), f"s{i % 3}") for i in range(400)], "text string, label int, source string")
    assert {r["label"]: r["count"] for r in samples.balance(many).groupBy("label").count().collect()} == {0: 100, 1: 100}
    assert {r["count"] for r in samples.quota(many, ["source"], 7).groupBy("source").count().collect()} == {7}
    train, test = samples.split(many)
    assert train.count() + test.count() == 400 and 40 < test.count() < 120 and train.join(test, "text").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Plain\r\n\r\n\r\n\r\ntext  here")
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i> {\\an8}there\n\n2\n00:00:03,000 --> 00:00:04,000\nyou &amp; me\n\nstray line\n")
    (tmp_path / "c.vtt").write_text("WEBVTT\nKind: captions\n\nNOTE x\n\n00:01.000 --> 00:02.000 align:start\n<v Bob>Hi <b>all</b>\n2\nagain\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>One </w:t></w:r><w:r><w:t xml:space='preserve'>two</w:t></w:r></w:p><w:p w:x='1'><w:numPr><w:t>item</w:t></w:p><w:p></w:p>")
        z.writestr("docProps/core.xml", "<cp:coreProperties><dc:creator>Ann</dc:creator><dc:title>T</dc:title></cp:coreProperties>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_texts(spark, f"file://{tmp_path}").collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a.txt": "Plain\n\ntext here", "b.srt": "Hello there you & me", "c.vtt": "Hi all again", "d.docx": "One two\n\n- item", "e.docx": None, "f.pdf": None}
    assert (got["b.srt"]["cues"], got["c.vtt"]["cues"], got["d.docx"]["facts"]["creator"]) == (2, 1, "Ann")
    one = spark.range(1).select(files.shared_document_id(F.lit("https://docs.example/document/d/AbC_1-x/edit")).alias("a"), files.shared_document_id(F.lit("x")).alias("b")).first()
    assert (one["a"], one["b"]) == ("AbC_1-x", None) and io


def test_reports_and_history(spark):
    df = spark.createDataFrame([(1, "A sentence here. And one more. A third one.")], "doc_id long, text string")
    r, c = authorship.analyze(df), authorship.category_scores(df)
    assert "| Sentence Structure | " in sinks.as_markdown(r, c).first()["report"] and '"verdict"' in sinks.as_json(r).first()["json"] and "Verdict: " in sinks.as_text(r).first()["report"]
    h = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 20)], "id int, timestamp string")
    kept = sinks.add_to_history(h, spark.createDataFrame([(99, "2024-02-01")], "id int, timestamp string"), 5)
    assert sorted(r["id"] for r in kept.collect()) == [16, 17, 18, 19, 99] and sinks.drop_from_history(kept, [99]).count() == 4


def test_classifiers(spark):
    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(140)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    for kind in ("logistic", "svm"):
        out = training.predict(training.fit(df, ["a", "b"], kind), df)
        assert evaluation.metrics(out).first()["accuracy"] > 0.95


def test_streamed_documents_are_analyzed_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    df = spark.createDataFrame([(i, f"Text number {i}. And more of it.", "en", "s", 30) for i in range(10)], stream.SCHEMA)
    df.write.parquet(source)
    stream.analyze_stream(stream.read_documents(spark, source), out, check).awaitTermination(120)
    df.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars").write.mode("append").parquet(source)
    stream.analyze_stream(stream.read_documents(spark, source), out, check).awaitTermination(120)
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [*range(10), *range(100, 110)]
    late = spark.readStream.schema("at timestamp, verdict string, ai_probability double").parquet(str(tmp_path / "in"))
    assert stream.verdicts_over_time(late, "at").isStreaming


def test_rewriting_is_seeded_and_plain(spark):
    from inkstone.operators import rewrite

    df = spark.createDataFrame([(1, "Furthermore, we utilize a plethora of tools. It is good and it does not fail."), (2, None), (3, "  ")], "doc_id long, text string")
    once = {r["doc_id"]: r["text"] for r in rewrite.rewrite(df, "heavy").collect()}
    assert once == {r["doc_id"]: r["text"] for r in rewrite.rewrite(df, "heavy").collect()}
    assert once[2] == once[3] == "" and "utilize" not in once[1] and "tons of" in once[1]


def test_lexical_span_follows_the_token_run(spark):
    from inkstone.operators import categories

    def brute(tokens):
        types, k, found = set(), 0, 0.0
        for t in tokens:
            types.add(t)
            if len(types) / (k + 1) <= 0.72:
                found, k, types = found + 1, 0, set()
            k += 1
        if k:
            found += (1 - len(types) / k) / (1 - 0.72)
        return len(tokens) / max(1, found) if len(tokens) >= 10 else 0

    lists = [["a"] * 30, list("abcdefghij"), list("abcabcabdabcaaab") * 3, list("abc")]
    df = spark.createDataFrame([(x,) for x in lists], "w array<string>")
    got = [r["s"] for r in df.select(categories.lexical_span(F.col("w")).alias("s")).collect()]
    assert got == pytest.approx([brute(x) for x in lists])


def test_categories_of_blank_texts_are_undecided(docs):
    from inkstone.operators import categories

    rows = categories.web_categories(docs).collect()
    assert len(rows) == 6 * len(TEXTS)
    assert all(r["ai_probability"] == 0.5 and r["confidence"] == 0 for r in rows if r["doc_id"] in (2, 3))
    both = {r["doc_id"]: r for r in categories.combined(categories.web_categories(docs), {1: 2.0}).collect()}
    assert 6 in both and 0 <= both[6]["weighted"] <= 1 and both[6]["n_categories"] >= 1 and 2 not in both

import zlib

from inkstone.llm import language_id
from tests.llm.conftest import rows

VOCABULARY = {
    "en": "the and of to in that was with this which from they have been would there their".split(),
    "de": "der die und das nicht mit sich auch eine wurde nach über können zwischen durch".split(),
    "fr": "le la les des une dans pour avec être était cette après où très française".split(),
    "es": "el los las una para con está señor año después también niño corazón más".split(),
}


def sample(n, per=40):
    import random

    r = random.Random(n)
    return [(k * 4 + j, " ".join(r.choice(VOCABULARY[x]) for _ in range(r.randrange(3, per))), x) for k in range(n) for j, x in enumerate(VOCABULARY)]


def test_held_out_texts_are_told_apart(spark):
    data = sample(150)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.languages == ["de", "en", "es", "fr"] and model.families == ["germanic", "romance"]
    truth = {d: x for d, _, x in data}
    out = language_id.identify(df.selectExpr("doc_id", "text", "'xx' as lang", "1 as score"), model).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in truth}
    held = [r for r in out if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_texts_and_nulls(spark):
    model = language_id.train(spark.createDataFrame([*sample(30), (None, "x", "en"), (7, None, "de"), (8, "y", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "es", "fr"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "é"), (5, "the " * 50_000), (None, "the and of"), (5, "der")], "doc_id long, text string")
    out = language_id.identify(df, model)
    got = rows(out, "doc_id", "lang_pred")
    assert [x for _, x in got[:3]] == ["und"] * 3 and got[3][1] != "und" and ("5", "en") in [(str(a), b) for a, b in got]
    assert rows(language_id.keep_languages(df, model, ("en",)), "doc_id")[0] in [(4,), (5,)]
    assert language_id.keep_languages(df, model).schema == df.schema
    assert language_id.identify(df.limit(0), model).collect() == []


def test_without_languages_nothing_is_known(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.train(empty)
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert rows(language_id.identify(df, model), "lang_pred", "score") == [("und", 0.0)]
    one = language_id.train(spark.createDataFrame([(0, "abc", "de"), (1, "abd", "de")], "doc_id long, text string, lang string"))
    assert rows(language_id.identify(df, one), "lang_pred") == [("de",)]


def test_a_language_of_long_texts_only_is_learned(spark, prose):
    docs = [(i, prose(i, 60), "en") for i in range(12)] + [(100 + i, " ".join(["zwischen", "größe", f"wörter{i}"] * 1000), "de") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.languages == ["de", "en"]
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()} == {i: v for i, _, v in docs}

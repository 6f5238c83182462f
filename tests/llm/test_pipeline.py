"""The stages on a small corpus, each against what it should keep."""

import pytest

import corpus_pipeline
from inkstone.llm import decontaminate, mixing
from tests.llm.conftest import rows
from tests.llm.test_language_id import VOCABULARY


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    import random

    r, docs, labels = random.Random(3), [], []
    names = list(VOCABULARY)
    for i in range(400):
        text = " ".join(r.choice(VOCABULARY[names[i % 4]]) for _ in range(r.randrange(30, 60)))
        if i % 8 == 7:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, names[i % 4], f"src{i % 20}", len(text)))
        labels.append((i, int(i % 8 != 7), 0))
    docs += [(1000 + k, docs[k][1], docs[k][2], "src0", docs[k][4]) for k in range(5)]  # copies
    item = prose(77, 20)
    docs += [(2000, item, "en", "src1", len(item)), (3000, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name != "mixing":
            assert docs.schema == schema
    clean = {i for i in range(400) if i % 8 != 7}
    assert len(kept["quality"] & clean) >= 0.97 * len(clean) and len(kept["quality"] & (set(range(400)) - clean)) <= 5
    assert len(kept["language"] & clean) >= 0.97 * len(clean) and 3000 not in kept["language"]
    assert not kept["near_duplicates"] & {1000, 1001, 1002} and {0, 1, 2} & kept["language"] <= kept["near_duplicates"]
    assert kept["decontamination"] == kept["near_duplicates"] - {2000}
    assert kept["mixing"] <= kept["decontamination"]


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    names = ("doc_id", "domain", "lang", "source", "n_tokens", "copies")
    assert rows(out, *names) == rows(docs, *names)
    assert mixing and decontaminate


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_labels_without_documents_and_a_benchmark_without_texts(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").selectExpr("item_id", "cast(null as string) as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

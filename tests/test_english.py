"""Queries that rest on English lists, against their SQL, on texts that hold every entry."""

import duckdb
import pytest

from inkstone.plans import registry
from tests import english
from tests.test_queries import canon

#: Queries whose every column differs somewhere in the table.
VARIED = (
    "cooccurrence_edges cooccurrence_nodes contained_phrases document_trends lexicon_phrase_counts lexicon_stem_counts lexicon_word_counts length_histogram model_features "
    "pattern_counts readability relative_scores repetition_map rewriting_signals segment_counts sentence_scores speech_correction text_coherence tone_features vocabulary vocabulary_growth web_categories word_sequences"
).split()
#: Those with a name of their own in each row, or with counts of what no list holds.
OTHERS = "archaic_style artifact_features category_heads document_analysis formatting inconsistency processing_difficulty repetition_patterns rewriting_traces set_pieces stability_under_rewriting tone_stability word_classes".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("english"))
    spark.createDataFrame(english.rows(), "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", VARIED + OTHERS)
def test_query_gives_the_rows_of_its_sql(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    names = ", ".join(f'"{x}"' for x in columns)
    got = canon(df.select(*columns).collect())
    assert got == canon(c.execute(f"SELECT {names} FROM ({registry.ORACLES[name]})").fetchall())
    if name in VARIED:
        assert [x for k, x in enumerate(columns) if len({r[k] for r in got}) == 1] == []


def test_every_entry_is_there():
    text = "\n".join(t or "" for t in english.texts())
    plain = [e for e in english.entries() if english.PLAIN.fullmatch(e)]
    assert len(plain) > 2000 and sum(e.lower() in text.lower() for e in plain) >= len(plain) - 3

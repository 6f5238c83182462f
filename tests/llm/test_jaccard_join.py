import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import jaccard_join
from inkstone.llm.components import connected_components
from inkstone.llm.scratch import Scratch
from inkstone.llm.wordhash import NOT_SPACE, shingle_sets
from tests.llm.conftest import rows


def shingles(text, size=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(docs):
    """(id, size, component, links) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)), links[i]) for i, (d, _) in enumerate(docs)), key=lambda t: tuple((x is None, x) for x in t))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x0c\r\x1f\xa0", max_size=40), max_size=6))
def test_shingle_sets_have_the_sizes_of_word_sets(texts):
    import pyarrow as pa

    from inkstone.llm.wordhash import column_bytes

    data, offs = column_bytes(pa.array(texts, pa.string()))
    assert [len(s) for s in shingle_sets(data, offs, 5, NOT_SPACE)] == [len(shingles(t)) for t in texts]


def near(text, seed, n):
    ws = text.split(" ")
    for k in range(n):
        ws[(seed * 37 + k * 53) % len(ws)] = f"x{seed}y{k}"
    return " ".join(ws)


@pytest.fixture(scope="module")
def docs(prose):
    out = [(i, prose(i, 30 + 7 * i)) for i in range(12)]
    base = prose(100, 150)
    out += [(50 + i, near(base, i, i % 5)) for i in range(30)]  # near copies at and around the threshold
    out += [(200, out[3][1]), (201, out[3][1].upper()), (4, out[4][1])]  # copies, a repeated row
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "One  two"), (305, "two one"), (None, out[5][1]), (None, None)]
    out += [(400, prose(7, 9000)), (401, near(prose(7, 9000), 3, 2))]  # very long texts
    return out


def test_groups_are_those_of_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as key", "2 as component_id")
    out = jaccard_join.ngram_jaccard_join(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert rows(out, "doc_id", "n_shingles", "component_id", "n_links") == brute(docs)


@pytest.mark.parametrize("crowd, hot, sets", [(2, 200_000, 2048), (64, 2, 2048), (3, 200_000, 4), (2, 2, 4)])
def test_blocks_and_hot_ngrams_find_the_same_links(spark, docs, monkeypatch, crowd, hot, sets):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 0)
    monkeypatch.setattr(jaccard_join, "TOKENS", 7)
    out = jaccard_join.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(out, "doc_id", "n_shingles", "component_id", "n_links") == brute(docs)


def test_one_document_of_each_group_stays_as_it_is(spark, docs):
    df = spark.createDataFrame([(d, t, f"s{i}") for i, (d, t) in enumerate(docs)], "doc_id long, text string, _hash string")
    kept = jaccard_join.drop_near_duplicates(df)
    assert kept.schema == df.schema
    got = kept.collect()
    assert {r["_hash"] for r in got} <= {f"s{i}" for i in range(len(docs))}
    components = {c for _, n, c, _ in brute(docs) if n}
    assert sorted(r["doc_id"] for r in got if shingles(r["text"])) == sorted(components)
    assert sum(not shingles(r["text"]) for r in got) == sum(not shingles(t) for _, t in docs)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.ngram_jaccard_join(df).collect() == []
    assert jaccard_join.drop_near_duplicates(df).collect() == []


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    want = {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 130)} | {300: 300, 301: 300}
    assert {r["node"]: r["component"] for r in got.collect()} == want

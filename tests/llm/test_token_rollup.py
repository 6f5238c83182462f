import os

import pytest

from inkstone.llm import token_rollup
from inkstone.llm.scratch import Scratch
from tests.llm.conftest import rows

KEYS = ("source", "lang", "version", "n_docs", "n_tokens")


def changes(spark, *rows_):
    return spark.createDataFrame(rows_, "source string, lang string, version string, before long, after long")


def test_deltas_batches_and_merges(spark):
    t = token_rollup.TokenRollup(spark, Scratch(spark, "t").root)
    assert t.totals().collect() == []
    assert t.commit("a", changes(spark, ("s", "en", "v1", None, 10), ("s", "en", "v1", None, 5), (None, None, "v1", None, 1)))
    assert t.commit("b", changes(spark, ("s", "en", "v1", 10, 12), ("s", "en", "v2", None, 3)))
    want = [("s", "en", "v1", 2, 17), ("s", "en", "v2", 1, 3), (None, None, "v1", 1, 1)]
    assert rows(t.totals(), *KEYS) == want
    assert not t.commit("a", changes(spark, ("s", "en", "v1", None, 999)))  # replayed
    t.merge("1")
    assert rows(t.totals(), *KEYS) == want and t.committed() == {"a", "b"}
    assert not t.commit("b", changes(spark, ("s", "en", "v1", None, 999)))
    assert t.commit("c", changes(spark, (None, None, "v1", 1, None)))
    t.merge("2")
    assert rows(t.totals(), *KEYS) == want[:2] and t.committed() == {"a", "b", "c"}


def test_a_batch_without_its_marker_does_not_count(spark):
    root = Scratch(spark, "t").root
    t = token_rollup.TokenRollup(spark, root)
    t.commit("a", changes(spark, ("s", "en", "v1", None, 10)))
    os.remove(f"{root.removeprefix('file://')}/batch-a/_SUCCESS")
    assert t.totals().collect() == [] and t.committed() == set()
    assert t.commit("a", changes(spark, ("s", "en", "v1", None, 10)))
    assert rows(t.totals(), *KEYS) == [("s", "en", "v1", 1, 10)]


needs_tokenizers = pytest.mark.skipif(not os.path.isdir(token_rollup.TOKENIZERS), reason="no public tokenizers here")


@needs_tokenizers
def test_white_space_and_letters_without_end(spark):
    import tiktoken

    texts = [" " * 10**7, "a" * 10**7, " \n" * 10**6 + "end", "x" + "\t" * 5000 + "y", "x" + " " * 5000]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["id"]: r["tokens"] for r in token_rollup.count_tokens(df).filter("version <> 'words'").collect()}
    encode = tiktoken.Encoding("own", pat_str=token_rollup.PATTERN, mergeable_ranks=token_rollup.load_ranks(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={}).encode_ordinary
    assert got == {0: 10**7, 1: 10**7 // 4, 2: 2 * 10**6 + 1, 3: len(encode(texts[3])), 4: len(encode(texts[4]))}


@needs_tokenizers
def test_cutting_out_white_space_changes_no_count(monkeypatch):
    import random
    import re

    import tiktoken

    ranks = token_rollup.load_ranks(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken")
    encode, whole = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (token_rollup.PATTERN, r"[\s\S]+"))
    monkeypatch.setattr(token_rollup, "_GAP", re.compile(token_rollup._GAP.pattern.replace("4096", "2")))
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice([" ", "  ", "\n", "\t", "a", "b1", "'s", "!", "é", "\u3000", "\x1c", "\x85", "   ", "zz"]) for _ in range(r.randrange(1, 30)))
        assert token_rollup.count_pieces(encode, whole, text) == len(encode(text)), repr(text)


@needs_tokenizers
def test_totals_are_those_of_counting_anew(spark, prose):
    import tiktoken

    docs = [(i, prose(i, 3 + i), ["en", "de"][i % 2], f"s{i % 3}") for i in range(40)]
    docs += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, "<|endoftext|> a  b", None, None), (None, "x y", "en", "s0"), (5, "é" * 5000, "en", "s1"), (5, "é" * 5000, "en", "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as version", "2 as tokens")
    got = rows(token_rollup.rollup_documents(df), *KEYS)
    codec = tiktoken.Encoding("own", pat_str=token_rollup.PATTERN, mergeable_ranks=token_rollup.load_ranks(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    want = {}
    for _, t, lang, source in docs:
        for v, n in (("byte_bpe_50k", len(codec.encode_ordinary(t or ""))), ("words", len((t or "").split()))):
            if n:
                d, k = want.get((source, lang, v), (0, 0))
                want[(source, lang, v)] = (d + 1, k + n)
    assert got == sorted(((*k, *v) for k, v in want.items()), key=lambda t: tuple((x is None, x) for x in t))
    assert token_rollup.rollup_documents(df.limit(0)).collect() == []

import hashlib
from fractions import Fraction

import duckdb
import pytest

from inkstone.llm import mixing
from tests.llm.conftest import rows


def fill(caps, weights, budget):
    """Exact shares: in proportion to the weights, no more than the caps."""
    out, left = {}, dict(caps)
    while left:
        total = sum(weights[k] for k in left)
        rest = budget - sum(out.values())
        full = [k for k in left if total and left[k] * total <= rest * weights[k]]
        if not full:
            out |= {k: Fraction(rest * weights[k], total) if total else 0 for k in left}
            break
        k = min(full, key=lambda k: Fraction(left[k], weights[k]))
        out[k] = left.pop(k)
    return out


@pytest.mark.parametrize(
    ("caps", "weights", "budget"),
    [({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 3, "c": 2}, 120), ({"a": 0, "b": 7}, {"a": 1, "b": 1}, 5), ({"a": 50, "b": 50}, {"a": 0, "b": 3}, 60), ({"a": 9, "b": 9, "c": 9}, {"a": 1, "b": 1, "c": 1}, 27), ({"a": 1000, "b": 1}, {"a": 1, "b": 999}, 500)],
)
def test_shortages_go_to_siblings(spark, caps, weights, budget):
    df = spark.createDataFrame([("p", k, caps[k], weights[k], budget) for k in caps], "parent string, name string, cap long, weight long, budget long")
    df = df.selectExpr("parent", "name", *[f"cast({c} as decimal(38,0)) as {c}" for c in ("cap", "weight", "budget")])
    got = {r["name"]: r["given"] for r in mixing.share_out(df, ["parent", "budget"], "name").collect()}
    want = fill(caps, weights, budget)
    assert all(abs(got[k] - want[k]) < 1 and got[k] <= caps[k] for k in caps)
    if sum(caps[k] for k in caps if weights[k]) >= budget:
        assert sum(got.values()) == budget


@pytest.fixture(scope="module")
def docs(prose):
    out = [(i, prose(i, 5 + i % 40), ["en", "de", "fr"][i % 3], f"src{i % 17}") for i in range(400)]
    return out + [(1000, None, "en", "src1"), (1001, "", None, None), (1002, "a b", None, "odd"), (None, "a b c", "en", "src1"), (None, "d e", "en", "src1"), (5, "a b c", "en", "src3"), (5, "a b c", "en", "src3"), (1003, "w " * 30_000, "es", "src2")]


def test_rows_are_those_of_sql(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    names = ("doc_id", "domain", "lang", "source", "n_tokens", "copies")
    got = rows(mixing.mix_documents(df.selectExpr("*", "1 as domain", "2 as key", "3 as cap")), *names)
    documents = df.toArrow()  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall()
    assert got == sorted(want, key=lambda t: tuple((x is None, x) for x in t))
    tokens = sum(r[4] * r[5] for r in got)
    total = sum(len((t or "").split()) for _, t, _, _ in docs)
    assert total // 2 <= tokens <= total // 2 + 70_000


def test_the_prefix_follows_the_seeded_order(spark, prose):
    docs = [(i, prose(i, 10), "en", "src1") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = [r["doc_id"] for r in mixing.mix_documents(df).collect()]
    order = sorted(range(50), key=lambda i: hashlib.md5(f"{mixing.SEED}-0-{i}".encode()).hexdigest())
    assert sorted(got) == sorted(order[:25])
    assert mixing.mix_documents(df.limit(0)).collect() == []

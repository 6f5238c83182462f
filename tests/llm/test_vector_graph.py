import numpy as np
import pytest

from inkstone.llm import vector_graph
from tests.llm.conftest import rows


def brute(data):
    good = {}
    for i, (_, v) in enumerate(data):
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.asarray(v, dtype=np.float64)
            good[i] = x / np.linalg.norm(x)
    links = {i: {j for j in good if j != i and i in good and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9} for i in range(len(data))}
    seen, out = {}, []
    for i in range(len(data)):
        todo, part = [i], {i}
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        low = min((data[j][0] for j in part if data[j][0] is not None), default=None)
        out.append((data[i][0], len(links[i]), low, data[i][0] is not None and data[i][0] == low))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(1)
    base = r.normal(size=(260, 16))
    out = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    out += [(1000 + i, (base[5] + r.normal(size=16) * 0.08).astype(np.float32).tolist()) for i in range(60)]  # one large group
    out += [(2000 + i, (base[20 + i] * 3 + r.normal(size=16) * 0.2).astype(np.float32).tolist()) for i in range(20)]
    out += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [1.0] * 15 + [float("nan")]), (3005, [1.0] * 15 + [float("inf")])]
    out += [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, out[7][1]), (7, out[7][1]), (3008, [1e-30] * 16), (3009, [1e30] * 16)]
    return out


def test_links_are_those_of_brute_force(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as row", "2 as id", "3 as n_links")
    out = vector_graph.near_duplicate_vectors(df)
    assert rows(out, "vec_id", "n_links", "component_id", "kept") == brute(data)
    audited = [r for r in out.collect() if r["audited_links"] is not None]
    assert audited and all(r["n_links"] == r["audited_links"] for r in audited)


def test_small_shards_and_tasks_find_nearly_all_links(spark, data, monkeypatch):
    monkeypatch.setattr(vector_graph, "PER_CENTRE", 20)
    monkeypatch.setattr(vector_graph, "SHARD", 30)
    monkeypatch.setattr(vector_graph, "QUERIES", 50)
    out = vector_graph.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    want, got = brute(data), rows(out, "vec_id", "n_links", "component_id", "kept")
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    assert sum(g[1] for g in got) <= sum(w[1] for w in want)


def test_a_graph_leads_to_everything_in_range():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 12))
    x[300:] = x[0] + 0.05 * r.normal(size=(100, 12))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q, found = vector_graph.range_search(x, vector_graph.build_graph(x), x, 0.9)
    true = int((x @ x.T >= 0.9).sum())
    assert len(q) >= 0.95 * true and len(q) <= true


def test_an_empty_table_and_one_without_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_graph.near_duplicate_vectors(df).collect() == []
    df = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert rows(vector_graph.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept") == [(1, 0, 1, True), (None, 0, None, False)]


@pytest.mark.parametrize("noise", [0, 3e-8, 1e-7])
def test_a_graph_leads_to_all_near_equal_vectors(noise):
    r = np.random.default_rng(6)
    x = r.normal(size=(1400, 32))
    x[400:] = x[0] + noise * r.normal(size=(1000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    lists = vector_graph.build_graph(x)
    q, found = vector_graph.range_search(x, lists, x[390:700], 0.9)
    assert len(q) == 10 + 300 * 1001 and max(map(len, lists)) < 80


def test_copies_count_and_a_low_recall_is_made_up_for(spark, data, monkeypatch):
    more = data + [(5000 + i, data[9][1]) for i in range(300)] + [(6000 + i, [2 * x for x in data[12][1]]) for i in range(50)]
    df = spark.createDataFrame(more, "vec_id long, embedding array<float>")
    assert rows(vector_graph.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept") == brute(more)
    whole = vector_graph._found
    monkeypatch.setattr(vector_graph, "_found", lambda *a: whole(*a).filter("row % 3 = 0"))
    monkeypatch.setattr(vector_graph, "EXACT_BLOCK", 100)
    assert rows(vector_graph.near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept") == brute(more)
    monkeypatch.setattr(vector_graph, "EXACT", 0)
    with pytest.raises(RuntimeError, match="recall"):
        vector_graph.near_duplicate_vectors(df)

import re

import pytest

from inkstone.llm import decontaminate
from tests.llm.conftest import rows


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    import hashlib

    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, x in items:
            v = words(x)
            k = min(13, len(v))
            for j in range(len(v) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[j : j + k]:
                        hit |= set(range(p, p + k))
                        names.add(i)
        named = sorted(str(n) for n in names if n is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


@pytest.fixture(scope="module")
def tables(prose):
    items = [(i, prose(900 + i, 20 + i)) for i in range(6)] + [(10, "Short item here"), (11, ""), (12, None), (None, prose(990, 15)), (13, prose(900, 20))]
    docs = [(i, prose(i, 60)) for i in range(5)]
    docs += [
        (20, prose(1, 30) + ", " + items[0][1].upper() + "! " + prose(2, 30)),
        (21, " ".join(items[1][1].split()[4:17])),  # exactly one window
        (22, " ".join(items[1][1].split()[4:16])),  # one word too few
        (23, "a short, item; here b"),
        (24, prose(3, 3000) + " " + " ".join(items[2][1].split()[:13])),  # hit, but not contaminated
        (25, prose(3, 247) + " " + " ".join(items[2][1].split()[:13])),  # 13 of 260 words
        (26, prose(3, 248) + " " + " ".join(items[2][1].split()[:13])),  # 13 of 261
        (27, items[-2][1]), (28, None), (29, ""), (None, items[3][1]), (20, prose(5, 9)), (30, items[0][1] + " " + items[4][1]),
    ]
    return docs, items


def columns(df):
    return rows(df, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_hits_are_those_of_brute_force(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "2 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert columns(decontaminate.contamination(d, b)) == brute(docs, items)


def test_contaminated_documents_go_and_others_stay_whole(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(a, i, t) for i, (a, t) in enumerate(docs)], "doc_id long, nr int, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.remove_contaminated(d, b)
    assert clean.schema == d.schema
    marks = [brute([x], items)[0][-1] for x in docs]
    assert sorted(r["nr"] for r in clean.collect()) == [i for i, m in enumerate(marks) if not m]


def test_longest_matches_reach_as_far_as_texts_agree(spark, tables):
    docs, items = tables
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.longest_matches(d, b).collect()}
    r = got[(20, "0")]
    assert (r["n_words"], r["item_word"], r["doc_word"]) == (20, 0, 30)
    text = docs[5][1].encode()
    assert words(text[r["first_byte"] : r["end_byte"]].decode()) == words(items[0][1])
    assert got[(21, "1")]["n_words"] == 13 and (22, "1") not in got


def test_empty_tables_and_several_indexes(spark, tables, monkeypatch):
    docs, items = tables
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(d, b.limit(0)).collect())
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    real = decontaminate.load_index
    monkeypatch.setattr(decontaminate, "load_index", lambda *a, **k: real(*a[:4], 150))
    assert len(real(b, "item_id", "text", 13, 150)) > 3
    assert columns(decontaminate.contamination(d, b)) == brute(docs, items)

import re
from itertools import permutations

import duckdb

from inkstone.llm import filter_audit
from tests.conftest import DATA

SPACE = re.compile("[\x20\x09-\x0d]+")


def brute(docs, labels):
    """Each order applied to each document, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    by_part = {}
    for i, text, lang in docs:
        text, words = text or "", [w for w in SPACE.split(text or "") if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        by_part.setdefault(lang or "", []).append((i, fails))
    out = {}
    for part, rows in by_part.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [(i, x) for i, x in left if x[f]]
                lost = [i for i, _ in here]
                left = [(i, x) for i, x in left if not x[f]]
                again = sum(x[f] and any(x[g] for g in order[: step - 1]) for _, x in rows)
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in rows)
                removed_by[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), again, alone, sum(i in good for i in lost), sum(i in toxic for i in lost), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = removed_by[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_every_order_agrees_with_applying_the_filters(spark, prose):
    long = prose(3, 150)
    docs = [
        (1, long, "en"), (2, long, "de"), (3, long, None), (3, long, None), (4, None, "en"), (5, "", "en"), (6, " \t\x0b ", ""),
        (7, "AB cd#", "en"), (8, "AB cd#", "en"), (None, "AB cd#", "en"), (None, long, "de"), (9, prose(4, 120) + " |", "de"),
        (10, "same " * 500, "de"), (11, "é ü " * 120, "fr"), (12, "X" * 20, "fr"), (13, "one word", "fr"), (14, long + " ", "en"),
        (15, " ".join(f"w{k}" for k in range(30000)), "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (10, 0, 1)]
    table = spark.createDataFrame([(*d, 5, "x", 2) for d in docs], "doc_id long, text string, lang string, part int, mask string, n int")
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in filter_audit.filter_interactions(table, marks).collect()}
    assert got == brute(docs, labels)


def test_the_query_gives_the_rows_of_its_sql(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    df = filter_audit.filter_interactions(docs, labels)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({filter_audit.ORACLE})").fetchall())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert filter_audit.filter_interactions(some, labels).count() == 600

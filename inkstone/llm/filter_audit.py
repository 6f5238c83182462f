"""How five filters act together, in every order, from one histogram of failures.

Native expressions give each document a mask of the filters that it fails. Masks
are counted by part: 32 cells a part at most, however many documents there are.
What any order of the filters keeps, removes and loses follows from these cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 100, 80, 10


def text_mask(text: Column, words: Column, distinct: Column) -> Column:
    """Bits 1 to 8: the filters A to D, which a text alone decides."""
    fails = [
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_SHARE * words,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_SHARE * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def _masked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id``, ``part``, ``digest`` of the text and ``mask`` of A to D."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    return t.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), n, distinct).alias("mask"))


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by the filters they fail.

    Texts are equal if their SHA-256 digests are. The groups of equal texts
    give their smallest id, which then finds its own row by id and digest, so a
    text of a million copies is a key of the pre-aggregated grouping only.
    """
    scratch = Scratch(docs.sparkSession, "filters")
    rows = scratch.keep(_masked(docs, id_col, text_col, part_col))
    known = rows.filter("id is not null")
    firsts = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).select("part", "mask", "good", "toxic")
    nameless = rows.filter("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))


def audit_orders(cells: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its cells; no part is left out."""
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'before', {before}, 'bit', {bit})")
            before |= bit
    each = by_part.select("part", "cells", F.explode(F.expr(f"array({', '.join(steps)})")).alias("s"))
    mask = lambda c: c["mask"].cast("int")
    before, bit = F.col("s.before"), F.col("s.bit")

    def total(test, value="n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(mask(c)), c[value]).otherwise(0))

    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    # Of the 120 orders, a filter comes first among the k that a document fails in 120 / k.
    share = lambda c: c["n"] * F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.bit_count(mask(c)))
    return each.select(
        "part", "s.filter_order", "s.step",
        total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(mask(c).bitwiseAND(bit) != 0, share(c)).otherwise(0)).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each ``part``, ``filter_order`` and ``step``.

    Null and empty texts fail A only (and E, if a smaller id has such a text).
    Null parts are the empty part. Rows of one id and text are equals: none is
    the other's copy. A row without an id has no label and is no copy, nor are
    others its copies. A document is good or toxic if any of its labels says
    so. An empty table has no parts. Other columns aren't read.
    """
    return audit_orders(failure_cells(docs, labels))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
         coalesce(q, 0) AS good, coalesce(x, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id) USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
p AS (
  SELECT [f1.x, f2.x, f3.x, f4.x, f5.x] AS xs, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND f1.b * f2.b * f3.b * f4.b * f5.b = 1024
    AND len(list_distinct([f1.x, f2.x, f3.x, f4.x, f5.x])) = 5),
s AS (
  SELECT array_to_string(xs, '') AS filter_order, step::INT AS step, xs[step] AS x, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before
  FROM p, range(1, 6) t(step)),
a AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM a"""

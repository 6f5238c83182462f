"""Mixing of sources to target weights, by budgets handed down a tree.

Weights of domains, of languages within a domain and of sources within a
language share out a budget of tokens. A node gets at most what its documents
hold times the largest number of epochs; what it can't use goes to its siblings
by their weights, and only what the siblings can't use either stays with the
ancestors' other branches. Each leaf's share is then met by whole epochs and a
prefix of one more epoch, whose order is seeded. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch

LEVELS = ("domain", "lang", "source")
WORDS = r"[^\x20\x09-\x0D]+"
#: Production parameters of the query: domains by the number in a source's name.
DOMAINS = (("web", 5), ("reference", 12), ("forum", 20))
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "forum": 2}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SHARE, EPOCHS, SEED = (1, 2), 2, "mix-1"


def domain_of(source: Column) -> Column:
    """The domain by the number at the end of a source's name; else ``other``."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int")
    out = F
    for name, below in DOMAINS:
        out = out.when(number < below, name)
    return F.coalesce(out, F.lit("other"))


def _weight(names: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(names == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given`` to siblings with ``cap``, ``weight`` and their parent's
    ``budget``: in proportion to the weights, but no more than the cap.

    Siblings are filled in the order of cap by weight. All whole tokens of the
    budget are given out unless every weighted sibling is full.
    """
    order = [F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf"))), F.col(name)]
    by = Window.partitionBy(*parent).orderBy(*order)
    before, here = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*parent)
    zero = F.lit(0).cast("decimal(38,0)")
    out = nodes.withColumn("_rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), zero))
    out = out.withColumn("_weights", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("_full", F.expr("(weight > 0 or cap = 0) and cap * _weights <= _rest * weight"))
    out = out.withColumn("_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(every), zero))
    out = out.withColumn("_open", F.when(F.col("_full"), zero).otherwise(F.col("weight")))
    out = out.withColumn("_all", F.greatest(F.sum("_open").over(every), F.lit(1)).cast("decimal(20,0)"))
    out = out.withColumn("_to", F.sum("_open").over(here).cast("decimal(20,0)"))
    share = "cast((cast(_rest as decimal(18,0)) * ({0})) div _all as long)"
    out = out.withColumn("given", F.when(F.col("_full"), F.col("cap").cast("long")).otherwise(F.expr(f"{share.format('_to')} - {share.format('_to - _open')}")))
    return out.drop("_rest", "_weights", "_full", "_open", "_all", "_to")


def mix_sources(
    docs: DataFrame,
    domain: Column,
    domain_weights: Mapping[str, int],
    language_weights: Mapping[str, int],
    source_weights: Mapping[str, int] | None = None,
    share: tuple[int, int] = SHARE,
    most_epochs: int = EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``id_col``, ``domain``, ``lang``, ``source``, ``n_tokens``, ``copies`` of every selected document.

    Tokens are ``[^\\x20\\x09-\\x0D]+`` of the text; a null text has none. The budget
    is ``share`` of all tokens. Weights are integers, 1 where none is
    given. A null language or source is named ``none``. In its last epoch
    a leaf takes documents in the order of md5(seed-epoch-id) while the tokens of
    all smaller keys are below the rest of its share, so the last document may
    reach beyond it. Rows with one id (and rows without one) have one key and
    are taken together. ``copies`` counts the epochs that take the document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(domain, F.lit("none")).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("none")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("none")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)).cast("long"), F.lit(0).cast("long")).alias("n_tokens"),
    )
    rows = scratch.keep(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("held")).withColumn("cap", (F.col("held") * most_epochs).cast("decimal(38,0)"))
    leaves = scratch.keep(leaves)

    languages = leaves.groupBy("domain", "lang").agg(F.sum("cap").cast("decimal(38,0)").alias("cap"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").cast("decimal(38,0)").alias("cap"))
    total = leaves.agg(F.sum("held").alias("all"), F.sum("cap").alias("most"))
    budget = F.expr(f"cast(least(most, ({share[0]} * cast(all as decimal(30,0))) div {share[1]}) as decimal(38,0))")
    domains = domains.crossJoin(total.select(budget.alias("budget")))  # a row by domain, one row of totals
    domains = share_out(domains.withColumn("weight", _weight(F.col("domain"), domain_weights)), ["budget"], "domain")
    languages = languages.join(domains.select("domain", F.col("given").cast("decimal(38,0)").alias("budget")), "domain")
    languages = share_out(languages.withColumn("weight", _weight(F.col("lang"), language_weights)), ["domain", "budget"], "lang")
    shares = leaves.join(languages.select("domain", "lang", F.col("given").cast("decimal(38,0)").alias("budget")), ["domain", "lang"])
    shares = share_out(shares.withColumn("weight", _weight(F.col("source"), source_weights or {})), ["domain", "lang", "budget"], "source")
    held = F.greatest(F.col("held"), F.lit(1))
    shares = shares.select(*LEVELS, F.expr("given div greatest(held, 1)").alias("epochs"), (F.col("given") % held).alias("rest"))
    shares = scratch.keep(shares)

    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("epochs").cast("string"), F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = rows.join(shares, list(LEVELS)).withColumn("key", key).withColumn("bin", F.substring("key", 1, 3))
    # Where in its order a leaf's share ends: first by 4096 bins of the key, then within one bin.
    bins = keyed.groupBy(*LEVELS, "rest", "bin").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0).cast("long"))).filter("before < rest")
    cut = bins.groupBy(*LEVELS).agg(F.max(F.struct("bin", "before")).alias("cut"))
    keyed = keyed.join(scratch.keep(cut), list(LEVELS), "left")
    within = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*LEVELS, "key")
    edge = keyed.filter("bin = cut.bin").withColumn("before", F.col("cut.before") + F.sum("n_tokens").over(within) - F.sum("n_tokens").over(peers))
    edge = edge.withColumn("copies", F.col("epochs") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    others = keyed.filter("cut is null or bin <> cut.bin").withColumn("copies", F.col("epochs") + F.when(F.col("bin") < F.col("cut.bin"), 1).otherwise(0))
    columns = [F.col("id").alias(id_col), *LEVELS, "n_tokens", F.col("copies").cast("long").alias("copies")]
    return edge.filter("copies > 0").select(*columns).unionByName(others.filter("copies > 0").select(*columns))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``mix_sources`` with the production parameters."""
    return mix_sources(docs, domain_of(F.col("source")), DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS)


def _sql_share(table: str, parent: str, name: str) -> str:
    return f"""
  SELECT *, CASE WHEN ful THEN cap ELSE rst * upto // alw - rst * (upto - opn) // alw END AS given FROM (
    SELECT *, greatest(sum(opn) OVER (PARTITION BY {parent}), 1)::HUGEINT AS alw,
           (sum(opn) OVER (PARTITION BY {parent} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING))::HUGEINT AS upto FROM (
      SELECT *, CASE WHEN ful THEN 0 ELSE weight END AS opn,
             (budget - coalesce(sum(CASE WHEN ful THEN cap END) OVER (PARTITION BY {parent}), 0))::HUGEINT AS rst FROM (
        SELECT *, (weight > 0 OR cap = 0) AND cap * (sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
               <= (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS ful
        FROM (SELECT *, CASE WHEN weight > 0 THEN cap::DOUBLE / weight ELSE 'inf'::DOUBLE END AS ratio FROM {table}))))"""


def _sql_case(column: str, weights: Mapping[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


_DOMAIN_SQL = "CASE " + " ".join(f"WHEN num < {below} THEN '{name}'" for name, below in DOMAINS) + " ELSE 'other' END"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, {_DOMAIN_SQL} AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, n_tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) AS num,
               coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS n_tokens FROM documents)),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS held, sum(n_tokens)::HUGEINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
dom0 AS (
  SELECT domain, sum(cap)::HUGEINT AS cap, {_sql_case("domain", DOMAIN_WEIGHTS)} AS weight,
         (SELECT least(sum(cap), {SHARE[0]} * sum(held) // {SHARE[1]})::HUGEINT FROM leaf) AS budget
  FROM leaf GROUP BY domain),
dom AS ({_sql_share("dom0", "budget", "domain")}),
lan0 AS (
  SELECT l.domain, l.lang, sum(l.cap)::HUGEINT AS cap, {_sql_case("l.lang", LANGUAGE_WEIGHTS)} AS weight, any_value(dom.given)::HUGEINT AS budget
  FROM leaf l JOIN dom USING (domain) GROUP BY l.domain, l.lang),
lan AS ({_sql_share("lan0", "domain", "lang")}),
src0 AS (SELECT leaf.*, 1 AS weight, lan.given::HUGEINT AS budget FROM leaf JOIN lan USING (domain, lang)),
src AS ({_sql_share("src0", "domain, lang", "source")}),
k AS (
  SELECT d.*, s.given // greatest(held, 1) AS epochs, s.given % greatest(held, 1) AS rest,
         md5('{SEED}-' || (s.given // greatest(held, 1))::VARCHAR || '-' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN src s USING (domain, lang, source)),
c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING)
         - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM k)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE epochs + CASE WHEN before < rest THEN 1 ELSE 0 END > 0"""

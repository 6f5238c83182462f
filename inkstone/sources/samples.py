"""Training samples from tables of many shapes: labelled, paired, one class only.

A sample is ``text``, ``label`` (0 human, 1 machine), ``source``. Draws and
splits are by hashes of the text and a seed, so they are the same at every run and
on every cluster.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column names that are tried in turn, and label texts by meaning (fixed values).
TEXT_COLUMNS = ("text", "content", "sentence", "document", "article", "body")
LABEL_COLUMNS = ("label", "source", "class", "category", "is_ai", "generated")
HUMAN_LABELS = ("human", "real", "authentic", "0")
MACHINE_LABELS = ("ai", "machine", "generated", "chatgpt", "gpt", "llm", "1")


def resolve(df: DataFrame, wanted: str | None, candidates: tuple[str, ...]) -> str | None:
    """The wanted column if there is one of that name, else the first candidate that is there."""
    return next((c for c in ([wanted] if wanted else []) + list(candidates) if c in df.columns), None)


def normal_label(c: Column, mapping: Mapping[str, int] | None = None) -> Column:
    """0 or 1 by the mapping or by what the label says; null if it says neither."""
    text = F.lower(F.trim(c.cast("string")))
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in (mapping or {}).items():
        out = out.when(c.cast("string") == str(k), F.lit(v))
    return out.when(text.isin(*HUMAN_LABELS, "false"), F.lit(0)).when(text.isin(*MACHINE_LABELS, "true"), F.lit(1))


def _words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def labelled(df: DataFrame, source: str, text_col: str | None = None, label_col: str | None = None, mapping: Mapping[str, int] | None = None, least_words: int = 20) -> DataFrame:
    """Samples of a table with a text and a label; others are left out. Without
    such columns there are none."""
    t, y = resolve(df, text_col, TEXT_COLUMNS), resolve(df, label_col, LABEL_COLUMNS)
    if t is None or y is None:
        return df.sparkSession.createDataFrame([], "text string, label int, source string")
    out = df.select(F.col(t).cast("string").alias("text"), normal_label(F.col(y), mapping).alias("label"), F.lit(source).alias("source"))
    return out.filter(F.col("label").isNotNull() & (_words(F.col("text")) >= least_words))


def paired(df: DataFrame, source: str, human_col: str, machine_col: str, least_words: int = 20) -> DataFrame:
    """Two classes from rows that have a text (or a list of texts) of each."""

    def texts(c: str) -> Column:
        return F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c))

    both = F.concat(F.transform(texts(human_col), lambda x: F.struct(x.alias("text"), F.lit(0).alias("label"))), F.transform(texts(machine_col), lambda x: F.struct(x.alias("text"), F.lit(1).alias("label"))))
    return df.select(F.inline(both), F.lit(source).alias("source")).filter(F.col("text").isNotNull() & (_words(F.col("text")) >= least_words))


def one_class(df: DataFrame, source: str, label: int, text_col: str | None = None, least_chars: int = 50) -> DataFrame:
    t = resolve(df, text_col, TEXT_COLUMNS)
    if t is None:
        return df.sparkSession.createDataFrame([], "text string, label int, source string")
    return df.select(F.col(t).cast("string").alias("text"), F.lit(label).alias("label"), F.lit(source).alias("source")).filter(F.length("text") >= least_chars)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_report(samples: DataFrame) -> DataFrame:
    """How many samples each source gave, by label, with their mean length."""
    return samples.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_human"), F.count_if(F.col("label") == 1).alias("n_machine"),
        F.avg(_words(F.col("text"))).alias("mean_words"), F.min(_words(F.col("text"))).cast("long").alias("least_words"), F.max(_words(F.col("text"))).cast("long").alias("most_words"),
    )


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("text"), F.lit(""))))


def quota(samples: DataFrame, by: list[str], most: int | Column, seed: int = 42) -> DataFrame:
    """At most so many samples of each group, drawn by hash.

    Ranks are by bins of the hash: a group's share is cut first by bins whose
    sizes are summed up, and only the bin at the cut is put in order.
    """
    most = F.lit(most) if isinstance(most, int) else most
    s = samples.withColumns({"_key": _draw(seed), "_most": most}).withColumn("_bin", F.substring("_key", 1, 3))
    along = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = s.groupBy(*by, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    s = s.join(bins, [*by, "_bin"]).filter("_before < _most")
    whole = s.filter("_before + _n <= _most")
    cut = s.filter("_before + _n > _most").withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_key"))).filter("_before + _nth <= _most")
    return whole.select(*samples.columns).unionByName(cut.select(*samples.columns))


def balance(samples: DataFrame, seed: int = 42) -> DataFrame:
    """As many samples of either label as the rarer one has."""
    least = samples.groupBy("label").count().agg(F.min("count").alias("_least"))  # one row
    return quota(samples.crossJoin(F.broadcast(least)), ["label"], F.col("_least"), seed).drop("_least")


def split(samples: DataFrame, test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test samples, by a hash of the text: equal texts never part."""
    h = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(100))
    return samples.filter(h >= test_percent), samples.filter(h < test_percent)

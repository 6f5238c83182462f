"""Plain-language rewriting of texts, as augmentation of training data.

Every choice is a hash of the seed, the text and the place, so a text is
rewritten alike at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import category_lists as L
from inkstone.functions import segment


def _chance_of(*parts: Column) -> Column:
    """From 0 to 1, by the hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _chance(seed: str, *parts: Column) -> Column:
    return _chance_of(F.lit(seed), *parts)


def _pick(options: list[str], h: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.floor(h * len(options)).cast("int"))


def _literal(phrase: str) -> str:
    return phrase.replace(".", "[.]")


def _replaced(text: Column, entries: list[tuple[str, str, str]], seed: str, rate: float) -> Column:
    """Replaces phrases (with their pattern and what they become) one after another, each in the texts chosen
    for it. A pattern is tried if the text held its phrase or has been changed."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("spt", (phrase, pattern, to))], F.lit(phrase.lower()).alias("low")) for phrase, pattern, to in entries])
    chosen = F.filter(rows, lambda x: _chance_of(F.concat(F.lit(seed), x["s"]), F.col("_text")) < rate)

    def step(low: Column):
        new = lambda acc, x: F.struct(F.regexp_replace(acc["text"], x["p"], x["t"]).alias("text"), F.lit(True).alias("changed"))
        return lambda acc, x: F.when(acc["changed"] | F.contains(low, x["low"]), new(acc, x)).otherwise(acc)

    start = F.struct(text.alias("text"), F.lit(False).alias("changed"))
    return A.let(F.lower(text), lambda low: F.aggregate(chosen, start, step(low), lambda acc: acc["text"]))


def plainer_phrases(text: Column, rate: float, seed: str) -> Column:
    return _replaced(text, [(phrase, f"(?i){_literal(phrase)}", plain) for phrase, plain in L.PLAINER.items()], seed, rate)


def with_contractions(text: Column, rate: float, seed: str) -> Column:
    return _replaced(text, [(full, rf"(?i)(?<![A-Za-z0-9_]){full}(?![A-Za-z0-9_])", short) for full, short in L.TO_CONTRACTIONS.items()], seed, rate)


def _lower_first(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), s.substr(F.lit(2), F.greatest(F.length(s), F.lit(1))))


def _upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.greatest(F.length(s), F.lit(1))))


def _by_sentence(text: Column, f) -> Column:
    return F.array_join(F.transform(F.split(text, rf"(?<=[.!?])[{segment.SPACE}]+"), f), " ")


def rewrite(docs: DataFrame, intensity: str = "medium", casual: bool = True, seed: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``: plainer phrases, contractions, openers, hedges, split
    sentences and (if casual) personal starts. A null or blank text becomes empty."""
    phrases, contractions, openers, hedges, splits, personal = L.INTENSITIES[intensity]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.withColumn("text", plainer_phrases(F.col("_text"), phrases, seed)).withColumn("text", with_contractions(F.col("text"), contractions, seed))

    def start(options: list[str], rate: float, name: str, ok=lambda s: F.lit(True)):
        def f(s: Column, i: Column) -> Column:
            chance = _chance(seed + name, F.col("_text"), i)
            return F.when((i > 0) & (chance < rate) & ok(s), F.concat(_pick(options, _chance(seed + name + "?", F.col("_text"), i)), _lower_first(s))).otherwise(s)

        return f

    def halves(s: Column, i: Column) -> Column:
        parts = F.split(s, rf",[{segment.SPACE}]*")
        k = F.floor(F.size(parts) / 2).cast("int")
        two = F.concat(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), ", "), F.lit(". "), _upper_first(F.array_join(F.slice(parts, F.greatest(k, F.lit(1)) + 1, F.size(parts)), ", ")))
        return F.when((_chance(seed + "split", F.col("_text"), i) < splits) & (F.length(s) > 100) & (F.size(parts) >= 2), two).otherwise(s)

    d = d.withColumn("text", _by_sentence(F.col("text"), start(L.OPENERS, openers * 0.3, "open")))
    d = d.withColumn("text", _by_sentence(F.col("text"), start(L.HEDGES, hedges * 0.3, "hedge", lambda s: ~F.contains(s, F.lit("?")))))
    d = d.withColumn("text", _by_sentence(F.col("text"), halves))
    if casual:
        d = d.withColumn("text", _by_sentence(F.col("text"), start(L.PERSONAL, personal, "own", lambda s: ~F.lower(s).startswith("i "))))
    return d.select("doc_id", F.when(segment.trim(F.col("_text")) == "", "").otherwise(F.col("text")).alias("text"))

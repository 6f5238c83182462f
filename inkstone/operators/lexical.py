"""Counts of listed words, phrases and patterns in each document.

All of it is counted within the row: a first pass keeps the words that any
list holds, and each list then looks at these only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import lexicons, matching, segment
from inkstone.functions.arrays import lit

_SINGLE = re.compile(r"[a-z0-9_]+")


def _jvm(pattern: str) -> Column:
    """A pattern of the lists as the JVM's: word edges by ASCII words, all white space.
    The lists have edges before and after letters and digits only, so half the test will do."""
    pattern = re.sub(r"(^|\(\?i\)|\|)\\b", r"\1(?<![A-Za-z0-9_])", pattern).replace(r"\d*\b", r"\d*" + segment.EDGE)
    return F.lit(pattern.replace(r"\b", "(?![A-Za-z0-9_])").replace(r"[^aeiou\s]", f"[^aeiou{segment.SPACE}]").replace(r"\s", f"[{segment.SPACE}]"))


def phrase_pattern(phrase: str, stem: bool = False) -> str:
    body = r"\s+".join(re.escape(w).replace(r"\-", "-").replace(r"\;", ";") for w in phrase.split(" "))
    return rf"\b{body}" + (r"\w*\b" if stem else r"\b")


def choice_of_words(pattern: str) -> list[str]:
    """The lower-case words of a pattern that is one ASCII word of any case, or a choice of some, between word edges; else none."""
    found = re.fullmatch(r"\(\?i\)\\b(?:\((?:\?:)?([A-Za-z0-9_|]+)\)|([A-Za-z0-9_]+))\\b", pattern)
    return (found[1] or found[2]).lower().split("|") if found else []


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _long(doc: DataFrame, columns: dict[str, Column]) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("name"), v.cast("long").alias("n")) for k, v in columns.items()]
    return doc.select("doc_id", F.inline(F.array(*rows))).filter("n > 0")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``name``, ``n``, ``n_distinct``: occurrences of each list's single words. Zeros are left out."""
    lists = {name: sorted({w for w in ws if _SINGLE.fullmatch(w)}) for name, ws in {**lexicons.WORDS, **lexicons.PRESENT}.items()}
    every = sorted({w for ws in lists.values() for w in ws})
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), 0)
    d = _text(docs, id_col, text_col).select("doc_id", F.filter(words, lambda w: w.isin(*every)).alias("hits"))  # few of a text's words are listed
    d = d.withColumns({f"l{i}": F.filter("hits", lambda w: w.isin(*ws)) for i, ws in enumerate(lists.values()) if ws})
    rows = [F.struct(F.lit(name).alias("name"), F.size(f"l{i}").cast("long").alias("n"), F.size(F.array_distinct(f"l{i}")).cast("long").alias("n_distinct")) for i, (name, ws) in enumerate(lists.items()) if ws]
    return A.fenced(d.select("doc_id", F.array(*rows).alias("r"))).select("doc_id", F.inline("r")).filter("n > 0")


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``name``, ``n``: occurrences of the lists' phrases, for the lists that have some."""
    t = F.col("low")
    columns = {}
    for name, ws in lexicons.WORDS.items():
        phrases = [w for w in ws if not _SINGLE.fullmatch(w)]
        if phrases:
            columns[name] = sum((matching.times(t, phrase_pattern(w), _jvm(phrase_pattern(w)), t) for w in phrases), F.lit(0))
    return _long(_text(docs, id_col, text_col).select("doc_id", F.lower("text").alias("low")), columns)


def stem_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``name``, ``n``: words that begin with a list's stems, once for each stem they begin with."""

    def by_size(stems: list[str]) -> dict[int, list[str]]:
        return {k: sorted({w for w in stems if len(w) == k}) for k in sorted({len(w) for w in stems})}

    def begins(w: Column, k: int, stems: list[str]) -> Column:
        return F.substring(w, 1, k).isin(*stems)

    every = by_size([w for ws in lexicons.STEMS.values() for w in ws])
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), 0)
    any_of = lambda w: reduce(lambda a, b: a | b, [begins(w, k, ws) for k, ws in every.items()])
    d = _text(docs, id_col, text_col).select("doc_id", F.filter(words, any_of).alias("hits"))

    def times(k: int, stems: list[str]) -> Column:
        return F.size(F.filter("hits", lambda w: begins(w, k, stems)))

    return _long(d, {name: sum((times(k, ws) for k, ws in by_size(stems).items()), F.lit(0)) for name, stems in lexicons.STEMS.items()})


def contained_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``name``, ``n``: how many of a list's phrases the text contains."""
    doc = _text(docs, id_col, text_col).select("doc_id", F.lower("text").alias("low"))
    return _long(doc, {name: sum((F.contains(F.col("low"), F.lit(w)).cast("int") for w in ws), F.lit(0)) for name, ws in lexicons.CONTAINED.items()})


def pattern_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``name``, ``n``: matches of each list's patterns, overlaps within a pattern not counted."""
    every = sorted({w for ps in lexicons.PATTERNS.values() for p in ps for w in choice_of_words(p)})
    doc = _text(docs, id_col, text_col).withColumn("low", F.lower("text"))
    doc = doc.withColumn("hits", F.filter(segment.ascii_words(F.col("text")), lambda w: w.isin(*every)))

    def times(p: str) -> Column:
        words = choice_of_words(p)
        return F.size(F.filter("hits", lambda w: w.isin(*words))) if words else matching.times(F.col("text"), p, _jvm(p), F.col("low"))

    return _long(doc, {name: sum((times(p) for p in ps), F.lit(0)) for name, ps in lexicons.PATTERNS.items()})


def word_shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lengths, syllables, endings and entropy of each document's words (``[a-z'-]`` between word edges)."""
    d = _text(docs, id_col, text_col).select("doc_id", "text", segment.tokens_ext(F.col("text")).alias("w"))
    d = d.withColumns({"k": F.transform("w", F.length), "y": F.transform("w", segment.syllables_ext)})
    d = A.with_run_counts(d, counts="w")
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")

    def share(pred) -> Column:
        return F.size(F.filter("w", pred)) / n

    def chains(at_least: int, pred) -> Column:
        """Words that end a run of at_least or more words of a kind."""
        step = F.aggregate(
            F.col("k"), F.struct(F.lit(0).alias("run"), F.lit(0).alias("n")),
            lambda a, x: F.struct(F.when(pred(x), a["run"] + 1).otherwise(0).alias("run"), (a["n"] + F.when(pred(x) & (a["run"] + 1 >= at_least), 1).otherwise(0)).alias("n")),
            lambda a: a["n"],
        )
        return step.cast("long")

    out = d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), A.mean(F.col("k")).alias("mean_length"), A.std_pop(F.col("k")).alias("std_length"), A.skewness(F.col("k")).alias("skew_length"),
        A.mean(F.col("y")).alias("mean_syllables"), A.std_pop(F.col("y")).alias("std_syllables"),
        (F.size(F.filter("y", lambda x: x == 1)) / n).alias("monosyllabic"), (F.size(F.filter("y", lambda x: x >= 3)) / n).alias("polysyllabic"),
        chains(3, lambda x: x <= 3).alias("short_chains"), chains(2, lambda x: x >= 8).alias("long_clusters"),
        share(lambda x: x.rlike("(?:ed|ing|s|er|est)$")).alias("inflected"), share(lambda x: x.rlike("(?:tion|sion|ness|ment|ity|ism|ist|ize)$")).alias("derived"),
        share(lambda x: (F.length(x) <= 5) & ~x.rlike("(?:ed|ing|ly)$")).alias("roots"), share(lambda x: F.length(x) > 7).alias("longer_than_7"),
        A.entropy_bits(F.col("counts"), F.size("w").cast("double")).alias("entropy"),
        (lit(1) + share(lambda x: (F.length(x) > 3) & x.rlike("^(?:un|re|in|dis|pre|mis)")) + share(lambda x: (F.length(x) > 3) & x.rlike("(?:tion|sion|ness|ment|able|ible|ful|less|ous|ive|ing|ed|ly|er|est)$"))).alias("morphemes"),
    )
    return A.fenced(out)


def readability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ten readability indices of each document; 0 without words or sentences."""
    d = _text(docs, id_col, text_col)
    sentences = F.size(F.filter(F.split("text", "[.!?]+"), lambda s: segment.trim(s) != ""))
    d = d.select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0).alias("w"), sentences.cast("double").alias("s"), F.regexp_count("text", F.lit("[a-zA-Z]")).alias("letters"), F.regexp_count("text", F.lit("[a-zA-Z0-9]")).alias("signs"))
    d = d.withColumn("y", F.transform("w", segment.syllables_ext))
    d = d.select(
        "doc_id", F.size("w").cast("double").alias("n"), "s", "letters", "signs", A.total(F.col("y")).alias("y"), F.size(F.filter("y", lambda x: x >= 3)).alias("poly"),
        *[F.size(F.filter("w", lambda x: F.length(x) > F.lit(k))).alias(f"over{k}") for k in (5, 6, 7)],
    )
    n, s = F.col("n"), F.col("s")
    both = (n > 0) & (s > 0)
    per = n / s

    def index(x: Column, ok: Column = both) -> Column:
        return F.when(ok, x).otherwise(lit(0))

    return d.select(
        "doc_id", n.cast("long").alias("n_words"), s.cast("long").alias("n_sentences"), F.col("y").cast("long").alias("n_syllables"),
        index(lit(206.835) - lit(1.015) * per - lit(84.6) * F.col("y") / n).alias("reading_ease"), index(lit(0.39) * per + lit(11.8) * F.col("y") / n - lit(15.59)).alias("grade"),
        index(lit(0.4) * (per + lit(100) * F.col("poly") / n)).alias("fog"), index(lit(1.0430) * F.sqrt(F.col("poly") * lit(30) / s) + lit(3.1291), s >= 3).alias("smog"),
        index(lit(0.0588) * F.col("letters") / n * 100 - lit(0.296) * s / n * 100 - lit(15.8), n > 0).alias("coleman_liau"), index(lit(4.71) * F.col("signs") / n + lit(0.5) * per - lit(21.43)).alias("automated"),
        index(lit(0.1579) * F.col("over7") / n * 100 + lit(0.0496) * per).alias("dale_chall"), index(per + F.col("over6") * 100 / n).alias("lix"), index(F.col("over6") / s, s > 0).alias("rix"),
        index(lit(0.141) * per + lit(0.086) * F.col("over5") / n * 100 + lit(0.839)).alias("spache"),
    )

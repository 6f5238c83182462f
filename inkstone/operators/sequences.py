"""Each document's words as a sequence: entropies, returns of words, growth of the
vocabulary, transitions and long memory.

Positions are sorted by word within the row, so that a word's returns are
neighbours; every statistic is then one pass over that array. Nothing is
exploded or shuffled. Words are of the convention ``ext``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.functions.lexicons import FUNCTION_WORDS
from inkstone.functions.series import burstiness_of_returns, exact_skewness, exact_std, fit_logs, growth, placed, reach, returns, slope, transition_sums, transitions

_ASCII_WORD = "[A-Za-z0-9_]+"


def letter_bits(t: Column) -> Column:
    """Entropy of the characters of a column. A character beyond 16 bits counts
    once above the line and twice below it."""
    n = (F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("double")
    letters = [F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"]  # most of a text; only the rest is cut into signs
    kinds = F.concat(F.array(*letters), F.array_distinct(F.split(F.regexp_replace(t, "[a-z]+", ""), "")))
    counts = F.transform(F.filter(kinds, lambda c: c != ""), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
    return F.when(n > 0, -A.total_by(F.filter(counts, lambda c: c > 0), lambda c: c / n * F.log2(c / n))).otherwise(lit(0))


def long_word_densities(text: Column) -> Column:
    """Words of five letters or more by character, of each paragraph, blank ones included."""
    parts = F.split(text, rf"\n[{segment.SPACE}]*\n")
    long_words = r"(?<![a-z0-9_])[a-z]{5,}(?![a-z0-9_])"
    return F.transform(parts, lambda p: F.regexp_count(F.lower(p), F.lit(long_words)) / F.greatest(F.length(p) + F.regexp_count(p, F.lit(r"[\x{10000}-\x{10FFFF}]")), F.lit(1)).cast("double"))


def _sequence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("tokens", segment.tokens_ext(F.col("text")))
    return t.withColumns({"n": F.size("tokens"), "placed": placed(F.col("tokens"))})


def word_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of sequence statistics for each document; without enough words they
    are 0, and the Hurst exponent is 0.5."""
    d = _sequence(docs, id_col, text_col)
    content = F.filter(F.transform("tokens", lambda w, i: F.when((F.length(w) > 3) & ~w.isin(*FUNCTION_WORDS), i)), lambda i: i.isNotNull())
    d = d.withColumn("bare", F.regexp_replace(F.lower("text"), f"[{segment.SPACE}]", ""))
    d = d.withColumns(
        {
            "gaps": returns(F.col("placed")), "ends": transitions(F.col("tokens")), "points": growth(F.col("placed"), F.col("n")), "content": content,
            "k": F.transform("tokens", F.length), "lengths": F.transform(segment.sentences_ext(F.col("text")), lambda s: F.regexp_count(s, F.lit(_ASCII_WORD))),
            "densities": long_word_densities(F.col("text")), "letters": letter_bits(F.col("bare")),
        }
    )
    d = A.with_run_counts(d, counts="tokens", by_length="lengths")
    d = d.withColumns({"back": F.filter("gaps", lambda g: g.isNotNull()), "apart": A.lagged_pairs(F.col("content"), lambda x, y: y - x), "ranks": F.sort_array("counts", asc=False), "density": A.mean(F.col("densities"))})
    d = d.withColumns(
        {
            "sums": transition_sums(F.col("ends")), "f": fit_logs(F.transform("ranks", lambda c, i: F.struct((i + 1).alias("x"), c.alias("y")))),
            "g": fit_logs(F.transform("points", lambda p: F.struct(p["position"].alias("x"), p["n_types"].alias("y")))),
            "m": A.mean(F.col("k")), "sd": exact_std(F.col("k")), "total": A.total(F.col("k")), "sm": A.mean(F.col("lengths")), "ssd": exact_std(F.col("lengths")),
        }
    )
    n, f, g, sums = F.col("n").cast("double"), F.col("f"), F.col("g"), F.col("sums")
    pairs = F.greatest(n - 1, lit(1))
    word_bits = A.entropy_bits(F.col("counts"), n)
    pair_bits = F.when(n >= 2, F.log2(pairs) - sums["pairs"] / pairs).otherwise(lit(0))
    even = F.array_max("counts") == F.array_min("counts")
    ranked = (n >= 10) & (F.size("counts") > 1)
    spread = (f["n"] * f["xy"] - f["x"] * f["y"]) / F.sqrt((f["n"] * f["xx"] - f["x"] * f["x"]) * (f["n"] * f["yy"] - f["y"] * f["y"]))
    beta = F.when(F.size("points") >= 2, slope(g)).otherwise(lit(0))
    varied = F.col("sd") > 0
    near = A.lagged_pairs(F.col("k"), lambda x, y: (x - F.col("m")) * (y - F.col("m")))
    off = A.total_by(F.col("densities"), lambda x: (x - F.col("density")) * (x - F.col("density")))
    out = d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.when(ranked, slope(f)).otherwise(lit(0)).alias("zipf_slope"), F.when(ranked & ~even, spread * spread).otherwise(lit(0)).alias("zipf_r2"),
        word_bits.alias("word_bits"), F.col("letters").alias("letter_bits"), pair_bits.alias("pair_bits"), F.greatest(lit(0), pair_bits - word_bits).alias("conditional_bits"), (word_bits * 1.1).alias("cross_bits"),
        A.entropy_bits(F.col("by_length"), A.size(F.col("lengths"))).alias("sentence_bits"),
        burstiness_of_returns(F.col("gaps")).alias("return_burstiness"), A.mean(F.col("back")).alias("return_mean"), exact_std(F.col("back")).alias("return_std"),
        exact_std(F.col("apart")).alias("content_spread"),
        F.when(F.size("densities") >= 2, F.sqrt(off / F.size("densities")) / F.greatest(F.col("density"), lit(0.001))).otherwise(lit(0)).alias("topic_burstiness"),
        F.col("m").alias("length_mean"), F.col("sd").alias("length_std"), exact_skewness(F.col("k"), F.col("m"), F.col("sd")).alias("length_skewness"),
        F.col("sm").alias("sentence_mean"), F.col("ssd").alias("sentence_std"), exact_skewness(F.col("lengths"), F.col("sm"), F.col("ssd")).alias("sentence_skewness"),
        F.when(F.size("points") >= 2, F.exp((g["y"] - beta * g["x"]) / g["n"])).otherwise(lit(0)).alias("heaps_k"), beta.alias("heaps_beta"),
        A.ratio(sums["bits"], sums["states"]).alias("transition_bits"),
        F.when((n >= 10) & varied, A.total(near) / ((n - 1) * F.col("sd") * F.col("sd"))).otherwise(lit(0)).alias("length_lag1"),
        F.when((n >= 20) & varied, F.log(reach(F.col("k"), n, F.col("total")) / n / F.col("sd")) / F.log(n)).otherwise(lit(0.5)).alias("hurst"),
    )
    return A.fenced(out)


def vocabulary_growth(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``position``, ``n_types``: distinct words after every 50 words and
    after the last. A document without words has no rows."""
    d = _sequence(docs, id_col, text_col)
    d = A.fenced(d.select("doc_id", growth(F.col("placed"), F.col("n")).alias("g")))
    return d.select("doc_id", F.inline("g")).select("doc_id", F.col("position").cast("long").alias("position"), F.col("n_types").cast("long").alias("n_types"))

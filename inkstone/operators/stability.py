"""How far a text stays the same when its first sentences are rewritten in place."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions import voice_lists as L
from inkstone.functions.arrays import lit
from inkstone.operators.authorship import segmented
from inkstone.operators.rewrite import _upper_first
from inkstone.operators.voice_categories import _java, _scored

#: Sentences that are rewritten by words and clauses, and by commas and order (what the score is defined on).
BY_WORDS, BY_ORDER = 10, 8


def with_synonym(x: Column) -> Column:
    """The first listed word in its first place by its synonym."""
    clean = F.transform(F.split(F.lower(x), f"[{segment.SPACE}]+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    word = F.get(F.filter(clean, lambda w: w.isin(*L.SYNONYM)), F.lit(0))
    at = F.regexp_instr(x, F.concat(F.lit("(?i)" + segment.EDGE), word, F.lit(segment.EDGE)))
    other = F.element_at(F.create_map(*map(F.lit, chain(*L.SYNONYM.items()))), word)
    first = x.substr(at, F.lit(1))
    return F.when(at > 0, F.overlay(x, F.when(first == F.upper(first), _upper_first(other)).otherwise(other), at, F.length(word)))


def with_clauses_moved(x: Column) -> Column:
    def part(p: str, k: int) -> Column:
        return F.regexp_extract(x, _java(p), k)

    fits = lambda p: x.rlike(_java(p))
    a, b, c = L.LEADING_WORD, L.LEADING_CLAUSE, L.LATER_CLAUSE
    return (
        F.when(fits(a), F.concat(part(a, 2), F.lit(", "), F.lower(part(a, 1))))
        .when(fits(b), F.concat(part(b, 3), F.lit(", "), F.lower(part(b, 1)), F.lit(" "), part(b, 2)))
        .when(fits(c), F.concat(_upper_first(part(c, 2)), F.lit(" "), part(c, 3), F.lit(", "), F.lower(part(c, 1))))
    )


def with_comma_changed(x: Column) -> Column:
    once = lambda old, new: F.overlay(x, F.lit(new), F.instr(x, old), F.lit(len(old)))
    return F.when(F.contains(x, F.lit(", ")), once(", ", " ")).when(F.contains(x, F.lit(" and ")), once(" and ", ", and ")).when(F.contains(x, F.lit(" but ")), once(" but ", ", but "))


def with_words_swapped(x: Column) -> Column:
    swapped = F.regexp_replace(x, _java(r"(?is)^(.*?)" + L.TWO_BEFORE_NOUN + "(.*)$"), "$1$3 $2 $4$5")
    p = _java(L.SECOND_ADVERB)
    moved = F.concat(_upper_first(F.regexp_extract(x, p, 2)), F.lit(", "), F.lower(F.regexp_extract(x, p, 1)), F.lit(" "), x.substr(F.length(F.regexp_extract(x, p, 0)) + 1, F.length(x)))
    return F.when(swapped != x, swapped).when(x.rlike(p), moved)


def tags(x: Column) -> Column:
    """A sentence's words with the closed classes and endings in place of the words."""
    for words, tag in L.WORD_TAGS:
        x = F.regexp_replace(x, F.lit(_java(rf"(?i)\b(?:{words})\b")), F.lit(tag))
    return F.split(x, f"[{segment.SPACE}]+")


def _concepts(w: Column) -> Column:
    return F.array_distinct(F.filter(w, lambda t: (F.length(t) > 3) & ~t.isin(*L.NO_CONCEPTS)))


def stability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Likeness of a text's first sentences to themselves after synonyms, moved clauses, commas and
    swaps, and even lengths in windows of 3, 5 and 8 sentences. Null, short and empty texts are
    undecided; a sentence without words of letters or digits has the length ratio 0."""
    d = segmented(docs, id_col, text_col)

    def variants(x: Column, i: Column) -> Column:
        every = F.array(with_synonym(x), with_clauses_moved(x), F.when(i < BY_ORDER, with_comma_changed(x)), F.when(i < BY_ORDER, with_words_swapped(x)))
        return F.struct(x.alias("o"), F.filter(every, lambda v: v.isNotNull() & (v != x)).alias("v"))

    d = d.withColumn("new", F.transform(F.slice("sentences", 1, BY_WORDS), variants))
    words = lambda x: F.struct(x["o"], x["v"], segment.tokens_web(x["o"]).alias("ow"), F.transform(x["v"], segment.tokens_web).alias("vw"), tags(x["o"]).alias("ot"), F.transform(x["v"], tags).alias("vt"))
    d = d.withColumns({"new": F.transform("new", words), "k": F.transform("sentences", lambda x: F.size(segment.tokens_web(x)))})
    pair = lambda x: F.zip_with(x["vw"], x["vt"], lambda w, t: F.struct(x["ow"].alias("ow"), x["ot"].alias("ot"), w.alias("w"), t.alias("t")))
    d = d.withColumn("pairs", F.flatten(F.transform("new", pair)))

    def likeness(x: Column) -> Column:
        a, b = F.size(x["ow"]), F.size(x["w"])
        same = F.size(F.filter(F.zip_with(x["ot"], x["t"], lambda s, t: s == t), lambda e: e))
        grams = A.jaccard(F.array_distinct(A.ngrams(x["ow"], 2)), F.array_distinct(A.ngrams(x["w"], 2)))
        return A.ratio(F.least(a, b), F.greatest(a, b)) * 0.2 + grams * 0.4 + same / F.greatest(F.size(x["ot"]), F.size(x["t"])) * 0.4

    def drift(x: Column) -> Column:
        content = F.filter(x["ow"], lambda t: F.length(t) > 4)
        place = lambda t, w: (F.array_position(w, t) - 1) / F.size(w)
        moved = F.transform(content, lambda t: F.when(F.array_contains(x["w"], t), F.abs(place(t, x["ow"]) - place(t, x["w"]))).otherwise(lit(0.5)))
        return (1 - A.jaccard(_concepts(x["ow"]), _concepts(x["w"]))) * 0.6 + A.mean(moved) * 0.4

    def alike(x: Column) -> Column:
        """Mean likeness of all pairs among the up to four variants of a sentence."""
        v = F.transform(x["vw"], F.array_distinct)
        each = F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 2, F.size(v)), lambda b: A.jaccard(a, b))))
        return F.when(F.size(v) >= 2, A.mean(each))

    d = d.withColumns({"likeness": F.transform("pairs", likeness), "moves": F.transform("pairs", drift), "alike": F.filter(F.transform("new", alike), lambda v: v.isNotNull())})
    s, n = F.size("sentences"), F.size("pairs")
    windows = [(w, A.window_variances(F.col("k"), w)) for w in (3, 5, 8)]
    d = d.select(
        "doc_id", F.length("text").alias("len"), s.alias("s"), n.alias("n"), A.mean(F.col("likeness")).alias("likeness"), A.mean(F.col("moves")).alias("moves"),
        F.when(F.size("alike") > 0, A.mean(F.col("alike"))).otherwise(lit(0.5)).alias("alike"), *[v.alias(f"w{w}") for w, v in windows],
    )
    s, n = F.col("s"), F.col("n")
    even = [F.when(s >= w, 1 - S.normalize(A.mean(F.col(f"w{w}")) + A.var_pop(F.col(f"w{w}")), 0, 50)).otherwise(lit(0)) for w, _ in windows]
    sizes = sum(((s >= w).cast("int") for w, _ in windows), F.lit(0))
    some = lambda c: F.when(n > 0, c).otherwise(lit(0.5))
    scores = {
        "structure": some(S.normalize(F.col("likeness"), 0.5, 0.9)), "meaning": some(1 - F.col("moves")), "recovery": some(S.normalize(F.col("alike"), 0.4, 0.85)),
        "even_lengths": A.ratio(sum(even, lit(0)), sizes, 0.5),
    }
    p = scores["structure"] * 0.3 + scores["meaning"] * 0.25 + scores["recovery"] * 0.25 + scores["even_lengths"] * 0.2
    sure = F.when(n < 5, lit(0.3)).otherwise(S.ladder(s, [(10, 0.5), (20, 0.7)], 0.85))
    return _scored(d, "Contrastive Instability", 15, (F.col("len") >= 200) & (s >= 5), p, sure, scores)

"""How hard a text is to follow: clauses, ambiguity, negation, density, the distance
from a pronoun back to the last name, and how its parts hang together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import processing_lists as L
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.functions.lexicons import FUNCTION_WORDS
from inkstone.operators.lexical import _jvm, _text

FLOOR = 0.0001  # of a share in the divergence of the halves
FEW = 32  # words in common that are counted one by one


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, _jvm(pattern))


def _alone(pattern: str) -> list[str]:
    """The words of a pattern that is a list of words between edges; it finds a text's words that are among them."""
    words = pattern.removeprefix(r"(?i)\b(?:").removesuffix(r")\b").split("|")
    assert all(w.isalnum() and w.islower() for w in words), pattern
    return words


def referents(text: Column) -> Column:
    """``total`` and ``n``: words from each pronoun back to the last name of its
    sentence, and pronouns that have one. A capitalised pronoun is its own."""
    words = F.transform(F.split(text, "[.!?]+"), lambda s: F.split(s, f"[{segment.SPACE}]+"))
    marked = F.transform(words, lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.rlike(L.NAME).alias("name"), (_n(w, L.REFERENCE) > 0).alias("ref"))))
    zero = F.struct(F.lit(-1).alias("last"), A.zero().alias("total"), A.zero().alias("n"))

    def step(a: Column, x: Column) -> Column:
        last = F.when(x["name"], x["i"]).otherwise(a["last"])
        found = x["ref"] & (last >= 0)
        return F.struct(last.alias("last"), (a["total"] + F.when(found, x["i"] - last).otherwise(0)).alias("total"), (a["n"] + found.cast("double")).alias("n"))

    each = F.transform(marked, lambda ws: F.aggregate(ws, zero, step))
    return F.aggregate(each, F.struct(A.zero().alias("total"), A.zero().alias("n")), lambda a, x: F.struct((a["total"] + x["total"]).alias("total"), (a["n"] + x["n"]).alias("n")))


def processing_difficulty(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts, means and densities for each document; 0 where there is nothing to count."""
    d = _text(docs, id_col, text_col)
    text = F.col("text")
    word = F.lit("[A-Za-z0-9_]+")
    named = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(p, _jvm(L.NAMES), 0), F.lower))
    d = d.withColumns({"s": segment.sentences_ext(text), "w": segment.tokens_ext(text), "paragraphs": F.transform(F.split(text, rf"\n[{segment.SPACE}]*\n"), named), "referents": referents(text), "words": F.regexp_count(text, word).cast("double")})

    def by_sentence(s: Column) -> Column:
        return A.let(F.transform(F.regexp_extract_all(s, word, 0), F.lower), lambda own: of_sentence(s, own))

    def of_sentence(s: Column, own: Column) -> Column:
        low = F.lower(s)
        _listed = lambda pattern: F.size(F.filter(own, lambda w: w.isin(*_alone(pattern))))
        far = (F.size(F.split(s, f"[{segment.SPACE}]+")) > 20) & (_n(s, L.SUBJECTS) >= 2) & (_listed(L.VERBS) >= 2)
        content = F.filter(F.regexp_extract_all(low, word, 0), lambda w: ~w.isin(*FUNCTION_WORDS))
        return F.struct(
            _listed(L.CLAUSES).alias("clauses"), _listed(L.DEEP_CLAUSES).alias("depth"), (_listed(L.EMBEDDED) >= 2).cast("int").alias("embedded"),
            ((_n(s, L.GARDEN_PATHS[0]) > 0).cast("int") + (_n(low, L.GARDEN_PATHS[1]) > 0).cast("int")).alias("garden"), far.cast("int").alias("far"),
            (_listed(L.VAGUE_PRONOUNS) * lit(0.1) + _listed(L.POLYSEMOUS) * lit(0.2)).alias("vague"), _n(s, L.PROPOSITIONS).alias("verbs"), F.size(content).alias("load"),
        )

    d = d.withColumns({"p": F.transform("s", by_sentence), "simple": _n(text, L.SIMPLE_NEGATIONS), "double": _n(text, L.DOUBLE_NEGATIONS), "implicit": _n(text, L.IMPLICIT_NEGATIONS), "pronouns": _n(text, L.PRONOUNS), "names": _n(text, L.NAMES)})
    n, w, words = F.greatest(F.size("s"), F.lit(1)).cast("double"), F.greatest(F.size("w"), F.lit(1)).cast("double"), F.greatest(F.col("words"), lit(1))
    total = lambda k: A.total_by(F.col("p"), lambda x: x[k])
    shifts = A.lagged_pairs(F.col("paragraphs"), lambda a, b: (F.size(F.array_intersect(a, b)) < 2).cast("int"))
    count = lambda c: c.cast("long")
    out = d.select(
        "doc_id", ((total("clauses") + F.size("s")) / n).alias("parse_depth"), count(total("garden")).alias("garden_paths"), count(total("embedded")).alias("center_embedded"), count(total("far")).alias("long_dependencies"), (total("vague") / n).alias("ambiguity"),
        count(F.col("simple")).alias("simple_negations"), count(F.col("double")).alias("double_negations"), count(F.col("implicit")).alias("implicit_negations"), count(F.col("simple") + F.col("double") * 2 + F.col("implicit")).alias("negation_complexity"),
        (F.size(F.filter("w", lambda x: ~x.isin(*FUNCTION_WORDS))) / w).alias("content_ratio"), (total("verbs") / n).alias("proposition_density"),
        ((_n(text, L.NOUN_ENDINGS) + _n(text, L.VERB_ENDINGS)) / words).alias("idea_density"), (_n(text, L.ABSTRACT_ENDINGS) / words).alias("concept_density"),
        (F.size(F.filter("w", lambda x: ~x.isin(*FUNCTION_WORDS) & (F.length(x) > 2))) / w).alias("lexical_density"), (total("load") / n).alias("information_load"),
        count(F.coalesce(F.array_max(F.transform("p", lambda x: x["depth"])), F.lit(0))).alias("clause_depth"),
        F.when(F.col("names") == 0, (F.col("pronouns") > 5).cast("double")).otherwise(F.least(lit(1), F.col("pronouns") / (F.greatest(F.col("names"), F.lit(1)) * lit(2)))).alias("pronoun_difficulty"),
        A.ratio(F.col("referents.total"), F.col("referents.n")).alias("referent_distance"), (A.total(shifts) / F.greatest(F.size("paragraphs") - 1, F.lit(1))).alias("topic_shifts"), (_n(text, L.ENTITIES) / words).alias("entity_density"),
    )
    return A.fenced(out)


def merged(a: Column, b: Column) -> Column:
    """Words of two arrays in one order, each with where it comes from; a last null closes them."""
    both = F.sort_array(F.concat(F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(0).alias("k"))), F.transform(b, lambda t: F.struct(t.alias("t"), F.lit(1).alias("k")))))
    return F.concat(both, F.array(F.lit(None).cast("struct<t:string,k:int>")))


def over_merged(both: Column, names: tuple[str, ...], add, done) -> Column:
    """Folds ``add(sums, count in a, count in b)`` over the words of ``merged`` arrays:
    two sparse distributions are walked through together, never laid out."""
    sums = lambda s: [s[k].alias(k) for k in names]
    zero = F.struct(F.lit(None).cast("string").alias("t"), A.zero().alias("a"), A.zero().alias("b"), *[A.zero().alias(k) for k in names])

    def step(s: Column, x: Column) -> Column:
        a, b = (x["k"] == 0).cast("double"), (x["k"] == 1).cast("double")
        more = F.struct(s["t"].alias("t"), (s["a"] + a).alias("a"), (s["b"] + b).alias("b"), *sums(s))
        new = F.struct(x["t"].alias("t"), F.coalesce(a, lit(0)).alias("a"), F.coalesce(b, lit(0)).alias("b"), *[v.alias(k) for k, v in zip(names, add(s, s["a"], s["b"]))])
        first = F.struct(x["t"].alias("t"), F.coalesce(a, lit(0)).alias("a"), F.coalesce(b, lit(0)).alias("b"), *sums(s))
        return F.when(x["t"] == s["t"], more).when(s["t"].isNull(), first).otherwise(new)

    return F.aggregate(both, zero, step, done)


def squares(a: Column) -> Column:
    """Sum of the squared counts of an array's words."""
    zero = F.struct(F.lit(None).cast("string").alias("t"), A.zero().alias("c"), A.zero().alias("s"))

    def step(s: Column, t: Column) -> Column:
        more = F.struct(t.alias("t"), (s["c"] + 1).alias("c"), (s["s"] + s["c"] * 2 + 1).alias("s"))
        return F.when(s["t"] == t, more).otherwise(F.struct(t.alias("t"), lit(1).alias("c"), (s["s"] + 1).alias("s")))

    return F.aggregate(F.sort_array(a), zero, step, lambda s: s["s"])


def products(a: Column, b: Column) -> Column:
    """Sum over words of the products of their counts in two arrays. Few words that are in both are
    counted one by one; with many of them the arrays are walked through together."""
    each = lambda common: A.total_by(common, lambda t: A.times_in(a, t) * A.times_in(b, t).cast("double"))
    together = over_merged(merged(a, b), ("xy",), lambda s, x, y: (s["xy"] + x * y,), lambda s: s["xy"])
    return A.let(F.array_intersect(a, b), lambda common: F.when(F.size(common) <= FEW, each(common)).otherwise(together))


def sparse_cosine(x: Column, y: Column) -> Column:
    """Of structs of words ``w`` and their ``squares`` ``q``."""
    return A.ratio(products(x["w"], y["w"]), F.sqrt(x["q"] * y["q"]))


def divergences(a: Column, b: Column) -> Column:
    """``js`` and ``kl``: Jensen-Shannon divergence in bits of two arrays' words, and the
    divergence in nats of the first from the second, no share below FLOOR."""
    n, m = F.greatest(F.size(a), F.lit(1)).cast("double"), F.greatest(F.size(b), F.lit(1)).cast("double")

    def add(s: Column, x: Column, y: Column) -> tuple[Column, Column]:
        p, q = x / n, y / m
        half = (p + q) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / half)).otherwise(lit(0))
        least, floor = F.greatest(lit(FLOOR), p), F.greatest(lit(FLOOR), q)
        return s["js"] + (part(p) + part(q)) / 2, s["kl"] + least * F.log(least / floor)

    return over_merged(merged(a, b), ("js", "kl"), add, lambda s: F.struct(s["js"].alias("js"), s["kl"].alias("kl")))


def text_coherence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Likeness of neighbouring sentences as word vectors (mean, variance, evenness),
    divergences of the second half's words from the first's, drift of the
    vocabulary over thirds, words that come back, and pronouns a hundred words.

    Below three sentences the evenness is 0.5; halves without words don't diverge;
    drift, chains and pronouns are 0 below 30 words or three sentences."""
    d = _text(docs, id_col, text_col)
    text = F.col("text")
    blank = segment.trim(text) == ""
    none = F.array().cast("array<string>")
    d = d.withColumns({"s": F.when(blank, none).otherwise(segment.sentences_web(text)), "w": segment.tokens_web(text), "own": F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), 0)})
    half = F.floor(F.size("w") / 2).cast("int")
    d = d.withColumns({"v": F.transform(F.transform("s", segment.tokens_web), lambda w: F.struct(w.alias("w"), squares(w).alias("q"))), "a": F.slice("w", 1, half), "b": F.slice("w", half + 1, F.size("w")), "third": F.floor(F.size("s") / 3).cast("int"), "content": F.filter("own", lambda x: F.length(x) > 4)})
    d = A.with_run_counts(d, counts="content")
    vocabulary = lambda i: F.array_distinct(segment.tokens_letters(F.array_join(F.slice("s", F.lit(i) * F.col("third") + 1, F.greatest(F.col("third"), F.lit(1))), " ")))
    d = d.withColumns({"cos": A.lagged_pairs(F.col("v"), sparse_cosine), "parts": F.array(*[vocabulary(i) for i in range(3)]), "far": divergences(F.col("a"), F.col("b"))})
    ok = (F.size("own") >= 30) & (F.size("s") >= 3)
    var = A.var_pop(F.col("cos"))
    both = (F.size("a") > 0) & (F.size("b") > 0)
    when = lambda test, x: F.when(test, x).otherwise(lit(0))
    out = d.select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), A.mean(F.col("cos")).alias("mean_similarity"), var.alias("similarity_variance"), F.when(F.size("s") < 3, lit(0.5)).otherwise(1 - S.normalize(F.round(var, 12), 0, 0.1)).alias("evenness"),
        when(both, F.col("far.js")).alias("halves_js"), when(both, F.col("far.kl")).alias("halves_kl"),
        when(ok, 1 - A.mean(A.lagged_pairs(F.col("parts"), A.jaccard))).alias("topic_drift"), when(ok, A.ratio(A.size(F.filter("counts", lambda c: c > 1)), A.size(F.col("counts")))).alias("lexical_chains"),
        when(ok, F.size(F.filter("own", lambda x: x.isin(*L.REFERRING))) * lit(100) / F.greatest(F.size("own"), F.lit(1))).alias("pronoun_density"),
    )
    return A.fenced(out)

"""More categories of the richer analysis: archaic style, predictability, consistency
of authorship, set pieces, and traces of rewriting.

Each gives the same columns as the categories of ``categories``; a text that is
too short has the probability 0.5 and the confidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import category_lists as C
from inkstone.functions import matching
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions import style_lists as L
from inkstone.functions.arrays import lit
from inkstone.operators.authorship import segmented
from inkstone.operators.categories import _contained, _count, _plain, _result
from inkstone.operators.lexical import _jvm


def _among(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _share_of(x: Column, most: Column) -> Column:
    """Place of x between 0 and a bound that isn't constant; a half if the bound is 0."""
    return F.when(most == 0, lit(0.5)).otherwise(S.clamp(x / most))


def archaic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Old forms that stay on the surface, with anachronisms and mixed morphology.
    A text without old forms has 0.5 and the confidence 0.3."""
    d = segmented(docs, id_col, text_col).withColumn("low", F.lower("text"))
    old = _among(L.ARCHAIC_VERBS + L.ARCHAIC_PRONOUNS + L.ARCHAIC_SYNTAX)
    words = lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9_]+"), 0)
    low, text = F.col("low"), F.col("text")
    d = d.withColumns({"w": words(low), "thou": F.regexp_extract_all(low, _jvm(rf"\bthou[{segment.SPACE}]+([A-Za-z0-9_]+)"), 1)})
    d = d.withColumn("has", F.array_distinct("w"))

    def times(*some: str) -> Column:
        return F.size(F.filter("w", lambda x: x.isin(*some)))

    d = d.select(
        "doc_id", F.size("tokens").alias("n"), F.size("sentences").alias("s"), F.size(F.array_intersect("has", old)).alias("old"),
        F.size(F.filter("sentences", lambda x: F.arrays_overlap(words(F.lower(x)), old))).alias("old_sentences"),
        times("thou", "thee", "thy").alias("thou_forms"), times("you").alias("you"),
        _count(text, [r"(?i)[A-Za-z0-9_]+eth\b", r"(?i)[A-Za-z0-9_]+est\b"]).alias("old_ends"), times("does", "has", "is", "was", "goes").alias("modern"),
        (F.size(F.array_intersect("has", _among(L.ANACHRONISMS))) + _contained(low, L.MODERN_CONTRACTIONS)).alias("late"),
        F.size("thou").alias("pairs"), F.size(F.filter("thou", lambda v: v.endswith("st") | v.isin(*L.THOU_FORMS))).alias("agree"),
        _count(text, [rf"(?i)\b(he|she|it)[{segment.SPACE}]+(does|has|is|goes|says)\b"]).alias("third_modern"), _count(text, [rf"(?i)\b(he|she|it)[{segment.SPACE}]+[A-Za-z0-9_]+th\b"]).alias("third_old"),
    )
    n, s = F.col("n"), F.col("s")
    density = A.ratio(F.col("old"), n)
    mixed = (F.col("thou_forms") > 0) & (F.col("you") > 0)
    verbs = (F.col("old_ends") > 0) & (F.col("modern") > F.col("old_ends"))
    depth = A.ratio(F.col("old_sentences"), s) * 0.4 + F.when(mixed, 0.0).otherwise(0.3) + F.when(verbs, 0.0).otherwise(0.3)
    third = (F.col("third_modern") > 0) | (F.col("third_old") > 0)
    one = third & ((F.col("third_modern") == 0) | (F.col("third_old") == 0))
    agree = A.ratio(F.col("agree") + one.cast("int"), F.col("pairs") + third.cast("int"), 0.5)
    tried = (density > 0.01) | (F.col("old") >= 3)
    scores = {"surface": (1 - depth, 0.4), "anachronisms": (S.normalize(F.col("late").cast("double"), 0, 3), 0.3), "morphology": (1 - agree, 0.3)}
    scores = {k: (F.when(tried, v).otherwise(lit(0.5)), w) for k, (v, w) in scores.items()}
    sure = S.ladder(n, [(100, 0.3), (300, 0.5)], 0.7) + F.when(F.round(density * 100, 2) > 2, 0.2).otherwise(0.0)
    return _result(d, "Archaic / Historical Grammar", 5, n >= 20, scores, F.when(tried, sure).otherwise(lit(0.3)))


def phrase_repeats(lines: Column) -> dict[str, Column]:
    """Columns to add one after another; the last, ``repeats``, counts how often four words
    in a row come back later in their line, where a match goes on to the last
    return and the next begins behind it. Linear in the text but for the sorting."""

    def starts(e: Column) -> Column:
        last = F.greatest(F.size(e) - 4, F.lit(-1))
        i = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        joined = F.transform(e, lambda x: x.rlike(f"^[a-z0-9_]+[{segment.SPACE}]+$"))
        phrase = lambda k: F.xxhash64(F.get(e, k), F.get(e, k + 1), F.get(e, k + 2), F.regexp_extract(F.get(e, k + 3), "^[a-z0-9_]+", 0))
        each = lambda j: F.transform(i, lambda k: F.when(F.get(j, k) & F.get(j, k + 1) & F.get(j, k + 2), F.struct(phrase(k).alias("h"), k.alias("i"))))
        return F.sort_array(F.filter(A.let(joined, each), lambda x: x.isNotNull()))

    def ends(s: Column) -> Column:
        same = F.zip_with(A.shifted(s), s, lambda y, x: y.isNull() | (x["h"] != y["h"]))
        return F.filter(F.transform(same, lambda end, i: F.when(end, i + 1)), lambda p: p.isNotNull())

    def returns(x: Column) -> Column:
        """Of each phrase that returns, where it starts and where it does so last."""
        s = x["starts"]
        runs = F.zip_with(F.concat(F.array(F.lit(0)), x["ends"]), x["ends"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.filter(runs, lambda r: r["b"] - r["a"] > 1)
        return F.sort_array(F.flatten(F.transform(runs, lambda r: F.transform(F.slice(s, r["a"] + 1, r["b"] - r["a"]), lambda v: F.struct(v["i"].alias("i"), F.get(s, r["b"] - 1)["i"].alias("last"))))))

    def matches(r: Column) -> Column:
        zero = F.struct(F.lit(0).alias("from"), F.lit(0).alias("n"))
        hit = lambda a, x: (x["i"] >= a["from"]) & (x["last"] >= x["i"] + 4)
        return F.aggregate(r, zero, lambda a, x: F.struct(F.when(hit(a, x), x["last"] + 4).otherwise(a["from"]).alias("from"), (a["n"] + hit(a, x).cast("int")).alias("n")), lambda a: a["n"])

    return {
        "starts": F.transform(F.transform(lines, lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]+[^a-z0-9_]*"), 0)), starts),
        "ends": F.transform("starts", ends),
        "returns": F.transform(F.arrays_zip("starts", "ends"), returns),
        "repeats": F.aggregate(F.transform("returns", matches), F.lit(0), lambda a, x: a + x),
    }


def predictability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Even sentences, common word pairs and starts, repeated n-grams, low entropy.

    A sentence's score has a constant where its original draws at random. A phrase
    counts as repeated within its line."""
    d = segmented(docs, id_col, text_col)
    d = d.withColumns(
        {
            "pair": A.ngrams(F.col("tokens"), 2), "triple": A.ngrams(F.col("tokens"), 3), "four": A.ngrams(F.col("tokens"), 4),
            "start": F.transform("sentences", lambda x: F.lower(F.array_join(F.slice(F.split(x, f"[{segment.SPACE}]+"), 1, 2), " "))),
            "own": F.transform("sentences", lambda x: F.struct(segment.tokens_web(x).alias("w"), F.regexp_count(x, F.lit("[,;:]")).alias("marks"))),
        }
    )
    d = A.with_run_counts(d, counts="tokens", starts_n="start", triples="triple", fours="four")

    def surprise(x: Column) -> Column:
        k = F.greatest(F.size(x["w"]), F.lit(1))
        letters = F.aggregate(x["w"], F.lit(0), lambda a, t: a + F.length(t))
        return S.clamp(F.size(F.array_distinct(x["w"])) / k * 30 + letters / k * 2 + x["marks"] / k * 20 + 2.5, 10, 100)

    d = d.withColumn("score", F.transform("own", surprise))
    for name, column in phrase_repeats(F.split("text", r"[\n\r\x{2028}\x{2029}]")).items():
        d = d.withColumn(name, column)
    again = lambda c: F.round(A.ratio(A.total_by(F.col(c), lambda x: x - 1), A.total(F.col(c))) * 100, 1)
    d = d.select(
        "doc_id", F.size("tokens").alias("n"), F.size("sentences").alias("s"), F.size("counts").alias("v"), A.entropy_bits(F.col("counts"), F.size("tokens").cast("double")).alias("h"),
        A.ratio(A.std_pop(F.col("score")), A.mean(F.col("score"))).alias("cv"), again("triples").alias("again3"), again("fours").alias("again4"), "repeats",
        A.ratio(F.size(F.filter("pair", lambda x: x.isin(*L.COMMON_BIGRAMS))), F.size("pair")).alias("pairs"), A.ratio(F.size(F.filter("triple", lambda x: x.isin(*L.COMMON_TRIGRAMS))), F.size("triple")).alias("common3"),
        A.ratio(A.total(F.filter("starts_n", lambda c: c > 1)), F.size("sentences")).alias("starts"),
    )
    n, h = F.col("n"), F.log2(F.col("v").cast("double"))
    scores = {
        "even_surprise": (1 - S.normalize(F.col("cv"), 0.1, 0.4), 0.25),
        "predictable": (S.normalize(F.col("pairs"), 0, 0.15) * 0.3 + S.normalize(F.col("common3"), 0, 0.05) * 0.3 + S.normalize(F.col("starts"), 0, 0.3) * 0.4, 0.25),
        "repetition": (S.normalize(F.col("again3"), 0, 5) * 0.4 + S.normalize(F.col("again4"), 0, 3) * 0.3 + S.normalize(F.col("repeats").cast("double"), 0, 3) * 0.3, 0.3),
        "low_entropy": (1 - S.normalize(F.when(h > 0, F.col("h") / h).otherwise(lit(0)), 0.7, 0.95), 0.2),
    }
    return _result(d, "Statistical Language Model Indicators", 8, n >= 50, scores, S.ladder(n, [(100, 0.4), (200, 0.6), (500, 0.8)], 0.95))


def consistency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drift between the halves, spikes of complexity, shifts of tone, paragraphs that share no words."""
    d = segmented(docs, id_col, text_col)
    stop = _among(C.STOP_WORDS)
    half = F.floor(F.size("sentences") / 2).cast("int")
    paragraph = lambda p: F.struct(
        *[_contained(F.lower(p), words).alias(k) for k, words in L.TONES.items()],
        F.array_distinct(F.filter(segment.tokens_web(p), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 3))).alias("own"),
    )
    d = d.withColumns({"first": F.slice("sentences", 1, half), "second": F.slice("sentences", half + 1, F.size("sentences")), "para": F.transform(segment.paragraphs(F.col("text")), paragraph), "sw": F.transform("sentences", segment.tokens_web)})
    for part in ("first", "second"):
        d = d.withColumn(f"{part}_w", segment.tokens_web(F.array_join(part, " ")))

    def measures(part: str) -> list[Column]:
        w = F.col(f"{part}_w")
        k = F.size(w)
        words = F.round(A.ratio(A.total(F.transform(w, F.length)), k), 2)
        functional = F.round(A.ratio(F.size(F.filter(w, lambda t: F.array_contains(stop, t))), k), 3)
        marks = F.round(A.ratio(F.regexp_count(F.array_join(part, " "), F.lit("[.,;:!?]")), k), 3)
        return [F.round(A.mean(F.transform(part, lambda x: F.size(segment.tokens_web(x)))), 1), words, functional, marks]

    def complexity(x: Column, i: Column) -> Column:
        w = F.get("sw", i)
        return F.size(w) * 0.3 + A.ratio(A.total(F.transform(w, F.length)), F.size(w)) * 2 + F.regexp_count(x, F.lit(L.CLAUSE_SIGNS)) * 3

    d = d.withColumns({"c": F.transform("sentences", complexity), "m1": F.array(*measures("first")), "m2": F.array(*measures("second"))})
    d = d.withColumn("sd", A.std_pop(F.col("c")))
    inner = F.zip_with(A.lagged_pairs(F.col("c"), lambda x, z: (x + z) / 2, 2), A.shifted(A.head(F.col("c"), F.size("c") - 1)), lambda m, x: F.abs(x - m) > F.col("sd") * 1.5)

    def shifts(x: Column, y: Column) -> Column:
        register = ((x["formal"] > 0) & (y["informal"] > 0)) | ((x["informal"] > 0) & (y["formal"] > 0))
        certainty = ((x["confident"] > 0) & (y["uncertain"] > 1)) | ((x["uncertain"] > 0) & (y["confident"] > 1))
        return register.cast("int") + certainty.cast("int")

    overlap = A.lagged_pairs(F.col("para"), lambda x, y: A.ratio(F.size(F.array_intersect(x["own"], y["own"])), F.least(F.size(x["own"]), F.size(y["own"]))))
    d = d.select(
        "doc_id", F.size("sentences").alias("s"), F.size("para").alias("p"), F.transform(F.arrays_zip("m1", "m2"), lambda x: F.abs(x["m1"] - x["m2"])).alias("drift"),
        F.size(F.filter(inner, lambda x: x)).alias("spikes"), A.total(A.lagged_pairs(F.col("para"), shifts)).alias("shifts"), overlap.alias("overlap"),
    )
    d = d.withColumns({"mean_overlap": A.mean(F.col("overlap")), "var_overlap": A.var_pop(F.col("overlap"))})
    s, p = F.col("s"), F.col("p")
    drift = sum((S.normalize(F.get("drift", F.lit(i)), 0, most) * w for i, (most, w) in enumerate(((10, 0.3), (1, 0.2), (0.1, 0.25), (0.05, 0.25)))), lit(0))
    shared = F.when((F.col("mean_overlap") < 0.2) & (F.col("var_overlap") < 0.05), 0.7).when(F.col("mean_overlap") < 0.1, 0.6).otherwise(0.3)
    scores = {
        "drift": (F.when(p < 2, 0.5).when(drift < 0.2, 0.6).when(drift > 0.6, 0.7).otherwise(0.3), 0.25),
        "spikes": (_share_of(F.col("spikes"), s * 0.15), 0.3),
        "tone": (_share_of(F.col("shifts"), p * 0.3), 0.25),
        "vocabulary": (F.when(p < 2, 0.5).otherwise(shared), 0.2),
    }
    sure = F.when((p < 3) | (s < 15), lit(0.3)).otherwise(S.ladder(s, [(30, 0.5), (60, 0.7)], 0.85))
    return _result(d, "Authorship Consistency", 9, s >= 10, scores, sure)


def set_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Balanced arguments, hedging, symmetric paragraphs, an expected arc, an assistant's phrases."""
    d = segmented(docs, id_col, text_col).withColumns({"low": F.lower("text"), "para": segment.paragraphs(F.col("text"))})
    low, text = F.col("low"), F.col("text")
    d = d.withColumns({"k": F.transform("para", lambda p: F.size(segment.tokens_web(p))), "inner": F.transform("para", lambda p: F.transform(segment.sentences_web(p), lambda x: F.size(segment.tokens_web(x))))})
    d = d.withColumn("sizes", F.transform("inner", lambda a: F.size(a)))
    opening = lambda o: (low.startswith(o) | F.contains(low, F.lit("\n" + o))).cast("int")
    java = lambda p: p.replace(r"\s", f"[{segment.SPACE}]")
    first, last = F.lower(F.get("para", F.lit(0))), F.lower(F.get("para", F.size("para") - 1))
    d = d.select(
        "doc_id", F.size("sentences").alias("s"), F.size("para").alias("p"), sum((matching.times(text, x, F.lit(java(x)), low) for x in L.ASSISTANT_PATTERNS), F.lit(0)).alias("assistant"), sum((opening(o) for o in L.ASSISTANT_OPENINGS), F.lit(0)).alias("openings"),
        sum((matching.found(text, x, matching.in_a_line(x), low) for x in L.BALANCE_TEMPLATES), F.lit(0)).alias("templates"), _count(low, [rf"\b{w}\b" for w in L.PRO_WORDS]).alias("pro"), _count(low, [rf"\b{w}\b" for w in L.CON_WORDS]).alias("con"),
        _contained(low, L.CAUTIOUS_PHRASES).alias("cautious"), _contained(low, L.STANCE_PHRASES).alias("firm"),
        A.ratio(A.std_pop(F.col("k")), A.mean(F.col("k"))).alias("cv"), A.ratio(A.std_pop(F.col("sizes")), A.mean(F.col("sizes"))).alias("sizes_cv"),
        F.size(F.filter("inner", lambda a: (F.size(a) >= 3) & (A.ratio(A.std_pop(a), A.mean(a), 1.0) < 0.3))).alias("even"),
        sum((F.coalesce(first.rlike(x), F.lit(False)).cast("int") for x in L.INTRODUCTIONS), F.lit(0)).alias("intro"), sum((F.coalesce(last.rlike(x), F.lit(False)).cast("int") for x in L.CONCLUSIONS), F.lit(0)).alias("outro"),
        sum((matching.times(text, x, F.lit(x), low) for x in L.BODY_SIGNS), F.lit(0)).alias("body"),
    )
    s, p = F.col("s"), F.col("p")
    balanced = (F.col("pro") + F.col("con") > 2) & (F.abs(F.col("pro") - F.col("con")) <= 1)
    stance = A.ratio(F.col("cautious"), F.col("cautious") + F.col("firm"), 0.5)
    spread = lambda c, a, b: 1 - S.normalize(F.when(p > 1, F.col(c)).otherwise(lit(0.5)), a, b)
    arc = F.col("intro") + F.col("outro") + (F.col("body") >= 3).cast("int")
    essay = p.between(4, 6) & (F.col("intro") > 0) & (F.col("outro") > 0)
    scores = {
        "balanced": (S.normalize(F.col("templates").cast("double"), 0, 3) * 0.5 + F.when(balanced, 0.5).otherwise(0.0), 0.2),
        "hedging": (S.normalize(A.ratio(F.col("cautious"), s), 0, 0.2) * 0.5 + S.normalize(stance, 0.5, 0.9) * 0.5, 0.2),
        "symmetry": (spread("cv", 0.2, 0.6) * 0.3 + spread("sizes_cv", 0.3, 0.7) * 0.3 + _share_of(F.col("even"), p * 0.5) * 0.4, 0.15),
        "arc": (F.when(p < 3, lit(0.5)).otherwise(S.normalize(arc.cast("double"), 0, 4) * 0.5 + F.when(essay, 0.3).otherwise(0.0) + S.normalize(F.col("body").cast("double"), 0, 5) * 0.2), 0.25),
        "assistant": (S.normalize((F.col("assistant") + F.col("openings")).cast("double"), 0, 5), 0.2),
    }
    sure = F.when((p < 3) | (s < 10), lit(0.4)).otherwise(S.ladder(s, [(25, 0.6), (50, 0.8)], 0.9))
    return _result(d, "Meta-Patterns Unique to AI", 10, s >= 5, scores, sure)


def _edged(words: list[str]) -> str:
    """Words at word edges; before a letter it is enough to look behind, and no word ends with a sign."""
    bare = [w for w in words if w[0] != "'"]
    return f"(?:{matching.BEHIND}(?:{'|'.join(bare)})|{segment.EDGE}(?:{'|'.join(w for w in words if w[0] == chr(39))})){matching.AHEAD}"


def rewriting(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Evenly spread contractions, fillers at the start, planted typos, mixed registers,
    formal phrases beside slang, rhetorical questions."""
    d = segmented(docs, id_col, text_col).withColumn("low", F.lower("text"))
    low = F.col("low")
    # a contraction's apostrophe may be missing
    contraction, informal = _edged([w.replace("'", "'?", 1) for w in L.STANDARD_CONTRACTIONS + L.INFORMAL_CONTRACTIONS]), _edged(L.INFORMAL_CONTRACTIONS)
    starts = lambda low: F.exists(F.array(*map(F.lit, L.SENTENCE_FILLERS)), lambda f: low.startswith(f))
    filler = F.size(F.filter("sentences", lambda x: A.let(segment.trim(F.lower(F.substring(x, 1, 1 + max(map(len, L.SENTENCE_FILLERS))))), starts)))
    lists = {"typos": L.PLANTED_TYPOS, "formal": L.FORMAL, "slang": L.SLANG, "loose": L.INFORMAL_CONTRACTIONS + L.SLANG}
    every = sorted({w for words in lists.values() for w in words})

    def listed(words: list[str]) -> Column:
        return F.size(F.filter("hits", lambda t: t.isin(*words)))

    d = d.withColumns({"hits": F.filter("tokens", lambda t: t.isin(*every)), "short": F.regexp_count(low, F.lit(contraction))})
    # a sentence's contractions are the text's as well
    d = d.withColumns({
        "per": F.transform("sentences", lambda x: F.when(F.col("short") > 0, F.regexp_count(F.lower(x), F.lit(contraction))).otherwise(0)),
        "informal": F.when(F.col("short") > 0, F.regexp_count(low, F.lit(informal))).otherwise(0),
    })
    d = d.select(
        "doc_id", F.size("tokens").alias("n"), F.size("sentences").cast("double").alias("s"), "short", "informal",
        A.ratio(A.std_pop(F.col("per")), A.mean(F.col("per"))).alias("cv"), filler.alias("fillers"), *[listed(words).alias(k) for k, words in lists.items()],
        _contained(low, L.LEFTOVER_PHRASES).alias("left"), _contained(low, L.RHETORICAL_QUESTIONS).alias("asked"),
    )
    n, s = F.col("n"), F.col("s")
    even = (F.col("short") > s * 0.3) & (F.col("cv") < 0.5)
    share = A.ratio(F.col("fillers"), s)
    human = F.col("loose") + F.col("fillers")
    times = lambda ok, x, most: F.when(ok, S.normalize(x.cast("double"), 0, most)).otherwise(lit(0))
    scores = {
        "contractions": (F.when(even, F.least(lit(1), (1 - F.col("cv")) * 0.7 + F.when(F.col("informal") > 2, 0.3).otherwise(0.0))).otherwise(lit(0)), 0.2),
        "fillers": (F.when(share > 0.15, S.normalize(share, 0.15, 0.5)).otherwise(lit(0)), 0.15),
        "typos": (S.ladder(F.col("typos"), [(1, 0.0), (2, 0.4), (3, 0.7)], 0.9), 0.2),
        "registers": (times((F.col("formal") >= 2) & (F.col("slang") >= 2), F.col("formal") * F.col("slang"), 20), 0.15),
        "leftovers": (times((F.col("left") >= 1) & (human >= 3), F.col("left") * human, 15), 0.2),
        "questions": (F.when(F.col("asked") >= 2, S.normalize(F.col("asked").cast("double"), 2, 5)).otherwise(lit(0)), 0.1),
    }
    sure = (S.normalize(n.cast("double"), 50, 500) + S.normalize(s, 5, 30)) / 2
    return _result(d, "Humanization Artifacts", 14, n >= 20, scores, sure)


#: In the form of ``categories.CATEGORIES``.
STYLE_CATEGORIES = {"archaic_style": archaic, "predictability": predictability, "authorship_consistency": consistency, "set_pieces": set_pieces, "rewriting_traces": rewriting}

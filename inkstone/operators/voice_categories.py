"""More categories of the richer analysis: stability of tone, word classes, repetition,
inconsistency within a text; the heads that combine categories; scores relative to a kind of writing.

The categories give the same columns as those of ``categories``; a text that is too
short, empty or null has the probability 0.5 and the confidence 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import matching
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions import voice_lists as L
from inkstone.functions.arrays import lit
from inkstone.functions.series import sorted_grams
from inkstone.operators.authorship import segmented
from inkstone.operators.categories import _contained, alone, among, listed
from inkstone.operators.rewriting_signals import exact_var


def _java(pattern: str) -> str:
    """The JVM's form of a pattern: edges by ASCII words, all white space."""
    return matching.half_edges(pattern).replace(r"\b", segment.EDGE).replace(r"\s", f"[{segment.SPACE}]")


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_java(pattern)))


def _whole(text: Column, pattern: str, low: Column | None = None) -> Column:
    """``_times`` in a whole text, where a search for the pattern's words pays."""
    return matching.times(text, pattern, F.lit(_java(pattern)), low)


def at_start(pattern: str) -> str:
    """A pattern for a text's start, which it finds there or else nothing, in place of looking on."""
    flags, body = re.fullmatch(r"(\(\?[a-z]+\))?\^(.*)", pattern).groups()
    return f"{flags or ''}^(?:{_java(body)})?"


def _having(a: Column, k) -> Column:
    """How many elements equal k."""
    return F.size(F.filter(a, lambda x: x == k))


def _each(a: Column, key: str | int) -> Column:
    """A field or element of each element."""
    return F.transform(a, lambda x: x[key])


def _row(d: DataFrame, keep: list[str], name: str, number: int, ok: Column, p: Column, confidence: Column, scores: dict[str, Column]) -> DataFrame:
    part = F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*[F.when(ok, F.round(c.cast("double"), 6)) for c in scores.values()]))
    r = {"name": F.lit(name), "category": F.lit(number), "ai_probability": F.when(ok, p).otherwise(lit(0.5)), "confidence": F.when(ok, confidence).otherwise(lit(0)), "scores": part}
    return d.select(*keep, F.struct(*[c.alias(k) for k, c in r.items()]).alias("r"))


def _scored(d: DataFrame, name: str, number: int, ok: Column, p: Column, confidence: Column, scores: dict[str, Column]) -> DataFrame:
    return A.fenced(_row(d, ["doc_id"], name, number, ok, p, confidence, scores).select("doc_id", "r.*"))


def _listed(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def tone_of(tokens: Column) -> Column:
    """Rates and balances of the words of a piece of text; balances are a half without such words."""
    every = sorted({w for words in L.VOICE.values() for w in words})
    return A.let(F.filter(tokens, lambda t: t.isin(*every)), lambda hits: _tone(hits, F.size(tokens)))


def _tone(hits: Column, n: Column) -> Column:
    counts = {k: _listed(hits, words) for k, words in L.VOICE.items()}
    own = counts["first"] + counts["second"]
    return F.struct(
        A.ratio(counts["formal"], counts["formal"] + counts["informal"], 0.5).alias("register"), A.ratio(counts["positive"] - counts["negative"], n).alias("emotion"),
        A.ratio(counts["certainty"], counts["certainty"] + counts["hedging"], 0.5).alias("modality"), A.ratio(counts["hedging"], n).alias("hedging"),
        (own / (own + counts["third"] + 1)).alias("pronouns"),
    )


DIMENSIONS = ["register", "emotion", "modality", "hedging", "pronouns"]


def _steady(a: Column) -> Column:
    """Evenness of values whose mean may be negative; one that is 0 but for rounding counts as 0."""
    level = F.round(A.mean(a), 12)
    return F.when(F.size(a) >= 2, 1 - F.least(lit(1), A.ratio(A.std_pop(a), level) / 0.8)).otherwise(lit(0.5))


def tone(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How steady register, emotion, certainty and hedging are from sentence to sentence, and an assistant's phrases."""
    return alone(tone_row, docs, id_col, text_col)


def tone_row(d: DataFrame, keep: list[str]) -> DataFrame:
    d = d.withColumns({"tones": F.transform("sw", tone_of), "para": F.transform("pw", tone_of)})
    d = d.withColumns({k: _each(F.col("tones"), k) for k in DIMENSIONS})
    d = d.withColumns({f"u_{k}": F.when(F.size("tones") < 3, lit(0.5)).otherwise(_steady(F.col(k))) for k in DIMENSIONS})
    steps = A.lagged_pairs(F.col("tones"), lambda x, y: F.array(*[F.abs(y[k] - x[k]) for k in DIMENSIONS[:3]]))
    d = d.withColumns({"steps": steps, "half": F.floor(F.size("para") / 2).cast("int")})
    shift = lambda x: F.array(F.when(F.get(x, F.lit(0)) > 0.3, F.get(x, F.lit(0))), F.when(F.get(x, F.lit(1)) > 0.1, F.get(x, F.lit(1))), F.when(F.get(x, F.lit(2)) > 0.3, F.get(x, F.lit(2))))
    d = d.withColumn("shifts", F.filter(F.flatten(F.transform("steps", shift)), lambda m: m.isNotNull()))

    def drift(k: str) -> Column:
        part = lambda a: A.mean(_each(a, k))
        return F.abs(part(F.slice("para", F.col("half") + 1, F.size("para"))) - part(F.slice("para", 1, F.col("half"))))

    helper = sum((_whole(F.col("text"), p, F.col("low")) for p in L.HELPER_PATTERNS), F.lit(0)) + _contained(F.col("low"), L.HELPER_PHRASES) + _contained(F.substring("low", 1, 100), L.HELPER_OPENINGS)
    d = d.select(
        *keep, F.length("text").alias("len"), F.size("sentences").alias("s"), (sum((F.col(f"u_{k}") for k in DIMENSIONS), lit(0)) / 5).alias("steady"),
        F.when(F.forall("hedging", lambda x: x == 0), lit(1)).otherwise(_steady(F.col("hedging"))).alias("hedged"), F.col("u_register").alias("register"),
        (1 - F.least(lit(1), A.std_pop(F.col("emotion")) * 10)).alias("flat"), S.normalize(helper.cast("double"), 0, 6).alias("helper"),
        F.size("shifts").alias("shifts"), F.exists("shifts", lambda m: m > 0.4).alias("sudden"), F.when(F.size("para") >= 2, (drift("register") + drift("emotion") + drift("hedging")) / 3).otherwise(lit(0)).alias("drift"),
        (1 - A.ratio(F.size(F.filter("steps", lambda x: (F.get(x, F.lit(0)) > 0.15) | (F.get(x, F.lit(1)) > 0.15))), F.size("steps"))).alias("smooth"),
    )
    # on texts whose dimensions don't change at all, the rounded sums must not fall on either side of a bound
    steady = F.round("steady", 9)
    p = steady * 0.2 + F.col("hedged") * 0.15 + F.col("flat") * 0.2 + F.col("register") * 0.1 + F.col("helper") * 0.2
    p += F.when(steady > 0.85, 0.1).otherwise(0.0) + F.when((F.col("shifts") == 0) & (steady > 0.7), 0.05).otherwise(0.0) + F.when(F.col("helper") > 0.5, 0.1).otherwise(0.0) - F.when(F.col("sudden"), 0.1).otherwise(0.0)
    scores = {k: F.col(k) for k in ("steady", "hedged", "flat", "register", "helper", "shifts", "drift", "smooth")}
    return _row(d, keep, "Tone Stability", 13, F.col("len") >= 100, S.clamp(p), S.ladder(F.col("s"), [(5, 0.2), (10, 0.4), (20, 0.6), (50, 0.75)], 0.85), scores)


def word_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stock adverbs and where they stand, hedging verbs, set verb phrases, one tense throughout."""
    d = segmented(docs, id_col, text_col)
    text = F.col("text")
    words = lambda x: F.split(segment.trim(x), f"[{segment.SPACE}]+")

    def places(x: Column) -> Column:
        """Adverbs of a sentence's words: first, first third, between, last two."""
        clean = F.transform(x, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
        n = F.size(x)
        where = F.transform(clean, lambda w, i: F.when((i > 0) & w.endswith("ly") & (F.length(w) > 4), F.when(i < n / 3, 1).when(i >= n - 2, 3).otherwise(2)))
        first = F.get(clean, F.lit(0)).isin(*L.STOCK_ADVERBS).cast("int")
        return F.when(n >= 3, F.array(first, *[_having(where, k) for k in (1, 2, 3)])).otherwise(F.array(*[F.lit(0)] * 4))

    def tense(x: Column) -> Column:
        past, present, future = (_times(x, p) for p in L.TENSES.values())
        return F.when((past > present) & (past > future), 0).when((present > past) & (present > future), 1).when(future > 0, 2).otherwise(3)

    d = d.withColumns({
        "places": F.transform(F.transform("sentences", words), places), "tenses": F.transform("sentences", tense),
        "adverbs": F.transform("sentences", lambda x: _times(x, L.ADVERB)), "verbs": F.transform("sentences", lambda x: _times(x, L.VERB)),
    })
    d = d.select(
        "doc_id", F.length("text").alias("len"), "adverbs", "verbs", _times(text, L.ADVERB).alias("n_adverbs"), _times(text, rf"(?i)\b(?:{'|'.join(L.STOCK_ADVERBS)})\b").alias("stock"),
        _whole(text, rf"(?i)\b(?:{'|'.join(L.HEDGING_VERBS)})\b").alias("hedging"), _times(text, L.VERB).alias("n_verbs"), sum((_whole(text, "(?i)" + p) for p in L.PERSONAL_PATTERNS), F.lit(0)).alias("personal"),
        sum((_whole(text, "(?i)" + p.replace(" ", r"\s+")) for p in L.VERB_PHRASES), F.lit(0)).alias("phrases"),
        F.array(*[A.total(_each(F.col("places"), k)) for k in range(4)]).alias("at"), F.array(*[_having(F.col("tenses"), k) for k in range(3)]).alias("tense_n"),
    )
    placed, told = A.total(F.col("at")), A.total(F.col("tense_n"))
    front = A.ratio(F.get("at", F.lit(0)) + F.get("at", F.lit(1)), placed, 0.5)
    one_tense = A.ratio(F.array_max("tense_n"), told, 0.5)
    p = lit(0.5) + F.when(F.col("stock") / F.greatest("n_adverbs", F.lit(1)) > 0.5, 0.15).otherwise(0.0) + F.when(F.col("phrases") > 3, F.least(lit(0.2), F.col("phrases") * 0.03)).otherwise(lit(0))
    p += F.when(one_tense > 0.9, 0.1).otherwise(0.0) + F.when(front > 0.6, 0.1).otherwise(0.0) - F.when(F.col("personal") > 2, 0.15).otherwise(0.0)
    p += F.when(F.col("hedging") / F.greatest("n_verbs", F.lit(1)) > 0.3, 0.1).otherwise(0.0)
    even = lambda c, some: F.when(some, S.clamp(1 - A.std_pop(c) / (A.mean(c) + 0.1))).otherwise(lit(0.5))
    sure = lit(0.4) + sum((F.when(F.col("len") > k, 0.1).otherwise(0.0) for k in (500, 1000, 2000)), lit(0)) + sum((F.when(F.col("n_adverbs") > k, 0.1).otherwise(0.0) for k in (5, 10)), lit(0))
    scores = {
        "adverb_spread": even(F.col("adverbs"), F.size("adverbs") > 0), "verb_spread": F.when(F.size("verbs") > 0, 1 - F.least(lit(1), A.std_pop(F.col("verbs")) / 3)).otherwise(lit(0.5)),
        "one_tense": one_tense, "adverb_places": even(F.col("at"), placed > 0), "front": front, "phrases": F.col("phrases"),
    }
    return _scored(d, "Part of Speech Patterns", 14, F.col("len") >= 50, S.clamp(p), F.least(lit(1), sure), scores)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Even gaps between repeated n-grams, sentences and paragraphs alike, paragraphs of the same shape.

    Paragraphs are compared with all others of their document in its row, which only keeps
    their number, and stops as soon as more of them can't change the score."""
    d = segmented(docs, id_col, text_col).withColumn("para", segment.paragraphs(F.col("text")))
    for n in (2, 3, 4, 5):
        d = d.withColumn(f"g{n}", sorted_grams(F.col("tokens"), n))
    gaps = lambda n: F.filter(A.lagged_pairs(F.col(f"g{n}"), lambda x, y: F.when(x["g"] == y["g"], y["i"] - x["i"])), lambda v: v.isNotNull())
    ends = lambda g: F.filter(F.transform(F.zip_with(A.shifted(g), g, lambda y, x: y["g"].isNull() | (x["g"] != y["g"])), lambda end, k: F.when(end, k + 1)), lambda v: v.isNotNull())
    d = d.withColumns({"gaps": F.concat(gaps(2), gaps(3), gaps(4))} | {f"e{n}": ends(F.col(f"g{n}")) for n in (3, 4, 5)})

    def again(n: int) -> Column:
        """Of each n-gram that returns: how often it stands, in negative; n; where first; the mean gap."""
        g = F.col(f"g{n}")
        runs = F.zip_with(F.concat(F.array(F.lit(0)), F.col(f"e{n}")), F.col(f"e{n}"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.filter(runs, lambda r: r["b"] - r["a"] > 1)
        return F.transform(runs, lambda r: F.struct((r["a"] - r["b"]).alias("c"), F.lit(n).alias("n"), F.get(g, r["a"])["i"].alias("i"), ((F.get(g, r["b"] - 1)["i"] - F.get(g, r["a"])["i"]) / (r["b"] - r["a"] - 1)).alias("gap")))

    def shape(p: Column) -> Column:
        lengths = F.transform(segment.sentences_web(p), lambda x: F.size(F.split(x, f"[{segment.SPACE}]+")))
        return F.array_join(F.transform(lengths, lambda k: F.when(k < 10, "S").when(k < 20, "M").otherwise("L")), "")

    def template(x: Column) -> Column:
        starts = F.create_map(*[F.lit(v) for kind, words in L.STARTS.items() for w in words for v in (w, kind)])
        first = F.lower(F.regexp_extract(x, f"^[^{segment.SPACE}]*", 0))
        start = F.coalesce(F.element_at(starts, first), F.lit("OTHER"))
        size = A.let(F.size(F.split(x, f"[{segment.SPACE}]+")), lambda n: F.when(n < 8, "SHORT").when(n < 15, "MED").when(n < 25, "LONG").otherwise("VLONG"))
        return F.concat_ws("-", start, size, F.when(F.contains(x, F.lit(",")), "COMMA"), F.when(x.rlike("[:;]"), "COLON"), F.when(x.rlike("[\"']"), "QUOTE"))

    own = lambda a: F.transform(a, lambda x: F.array_distinct(segment.tokens_web(x)))
    d = d.withColumns({
        "top": F.slice(F.sort_array(F.concat(again(3), again(4), again(5))), 1, 10), "own": own("sentences"), "own_p": own("para"), "shapes": F.transform("para", shape),
        "templates": F.transform("sentences", template), "closing": A.total(F.transform("sentences", lambda x: _contained(F.lower(x), L.SUMMING_UP))),
    })
    near = sum((F.size(F.filter(A.lagged_pairs(F.col("own"), A.jaccard_of_sets, k), lambda v: v > 0.4)) for k in (1, 2, 3, 4)), F.lit(0))
    enough = F.size("own_p") * 1.25  # alike pairs from which the score is 1
    rest = lambda i: F.slice("own_p", i + 2, F.size("own_p"))
    like_sizes = lambda a, b: F.least(F.size(a), F.size(b)) > F.greatest(F.size(a), F.size(b)) * 0.3
    count = lambda acc, x: acc + F.when(acc < enough, F.size(F.filter(rest(x["i"]), lambda y: F.when(like_sizes(x["own"], y), A.jaccard_of_sets(x["own"], y) > 0.3).otherwise(False)))).otherwise(0)
    alike = F.aggregate(F.transform("own_p", lambda w, i: F.struct(w.alias("own"), i.alias("i"))), F.lit(0), count)
    d = d.select(
        "doc_id", F.length("text").alias("len"), F.size("tokens").alias("n"), F.size("sentences").alias("s"), F.size("para").alias("p"), "gaps", F.transform("top", lambda x: x["gap"]).alias("top"), near.alias("near"), alike.alias("alike"),
        F.size(F.array_distinct("shapes")).alias("n_shapes"), F.size(F.array_distinct("templates")).alias("n_templates"), "closing",
    )
    s, p = F.col("s"), F.col("p")
    many = F.size("gaps") > 2
    scores = {
        "even_gaps": F.when(many, A.uniformity(F.col("gaps"))).otherwise(lit(0.5)), "clustered": F.when(many, F.least(lit(1), A.cv(F.col("gaps")))).otherwise(lit(0.5)),
        "redundant": F.least(lit(1), (A.ratio(F.col("near"), s) * 0.6 + F.when(p > 1, F.col("alike") / (p - 1)).otherwise(lit(0)) * 0.4) * 2), "same_shape": F.when(p > 1, 1 - F.col("n_shapes") / p).otherwise(lit(0.5)),
        "same_template": A.ratio(s - F.col("n_templates"), s), "closing": F.col("closing"),
    }
    d = d.withColumns(scores)
    total = F.col("even_gaps") * 0.3 + (1 - F.col("clustered")) * 0.25 + F.col("redundant") * 0.25 + F.col("same_shape") * 0.2 + F.when((F.size("top") > 5) & (F.round(A.uniformity(F.col("top")), 9) > 0.7), 0.1).otherwise(0.0)
    sure = lit(0.3) + F.when(F.col("n") > 500, 0.3).when(F.col("n") > 200, 0.2).when(F.col("n") > 100, 0.1).otherwise(0.0) + F.when(s > 20, 0.2).when(s > 10, 0.1).otherwise(0.0)
    return _scored(d, "Repetition Patterns", 12, F.col("len") >= 100, S.clamp(total), sure, {k: F.col(k) for k in scores})


#: Patterns that count the same as those of ``SLIPS``, but are tried where their rarer sign is, and go back over nothing.
SAME_SLIPS = {
    r"\b[A-Za-z0-9_]*[aeiou]{3,}[A-Za-z0-9_]*\b": r"[aeiou]{3}[A-Za-z0-9_]*+",
    r"\s{3,}|[A-Za-z0-9_][.!?][A-Za-z0-9_]": r"[.!?](?<=[A-Za-z0-9_][.!?])[A-Za-z0-9_](?:[.!?](?=[A-Za-z0-9_]))?|\s{3,}",
}


def inconsistency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kinds of openings, and how idioms, depth, slips and style differ between four or more
    segments. A segment without words has the word measures 0."""
    return alone(inconsistency_row, docs, id_col, text_col)


def inconsistency_row(d: DataFrame, keep: list[str]) -> DataFrame:
    kind = lambda x: F.coalesce(*[F.when(F.regexp_extract(x, at_start(p), 0) != "", i) for i, p in enumerate(L.OPENING_KINDS)], F.lit(len(L.OPENING_KINDS)))
    size = F.greatest(F.lit(3), F.floor(F.size("sentences") / 4).cast("int"))
    starts = F.when(F.size("sentences") > 0, F.sequence(F.lit(0), F.size("sentences") - 1, size)).otherwise(F.array().cast("array<int>"))
    d = d.withColumns({"kinds": F.transform("sentences", kind), "parts": F.transform(starts, lambda i: F.struct(F.slice("sentences", i + 1, size).alias("s"), F.slice("sw", i + 1, size).alias("each")))})
    d = A.with_run_counts(d, kinds_n="kinds")

    def measured(part: Column) -> Column:
        return F.struct(F.array_join(part["s"], " ").alias("text"), part["each"], part["s"], F.flatten(part["each"]).alias("w"))

    listed_words = listed(L.SUBORDINATE) + listed(L.CONNECTIVE) + listed(L.FIRST_PERSON)
    d = d.withColumn("parts", F.transform("parts", measured))
    d = d.withColumn("parts", F.transform("parts", lambda x: F.struct(x["text"], x["each"], x["s"], x["w"], F.filter(segment.ascii_words(x["text"]), lambda t: t.isin(*listed_words)).alias("hits"))))

    def measures(x: Column) -> Column:
        n, k = F.size(x["w"]), F.size(x["s"]).cast("double")
        letters = A.ratio(F.aggregate(x["w"], F.lit(0), lambda a, t: a + F.length(t)), n)
        lexical = (letters / 10 + A.ratio(F.size(F.filter(x["w"], lambda t: F.length(t) > 8)), n)) / 2
        depth = (among(x["hits"], listed(L.SUBORDINATE)) + among(x["hits"], listed(L.CONNECTIVE)) * 2) / k
        ends = lambda mark: F.size(F.filter(x["s"], lambda q: q.endswith(mark))) / k
        style = F.array(n / k, letters, _times(x["text"], L.PASSIVE) / k, ends("?"), ends("!"), A.ratio(among(x["hits"], listed(L.FIRST_PERSON)), n))
        kinds = F.array_distinct(F.transform(x["each"], lambda t: S.ladder(F.size(t), [(3, 0), (8, 1), (15, 2), (25, 3)], 4)))
        return F.struct(
            _contained(F.lower(x["text"]), L.IDIOMS).alias("idioms"), F.when(depth == 0, lexical * 10).otherwise(lexical / (depth + 0.1)).alias("balance"),
            F.array(*[_times(x["text"], SAME_SLIPS.get(p, p)) for p in L.SLIPS]).alias("slips"), style.alias("style"), F.array_distinct(x["w"]).alias("own"), kinds.alias("kinds"),
        )

    d = d.withColumn("m", F.transform("parts", measures))
    change = lambda x, y: F.aggregate(F.zip_with(x["style"], y["style"], lambda a, b: F.abs(a - b)), A.zero(), lambda a, v: a + v)
    first, last = F.get("m", F.lit(0)), F.get("m", F.size("m") - 1)
    both = lambda k: A.ratio(F.size(F.array_intersect(first[k], last[k])), F.greatest(F.size(first[k]), F.size(last[k])))
    each = F.array(*[A.var_pop(_each(_each(F.col("m"), "slips"), k)) for k in range(len(L.SLIPS))])
    slips = A.total(F.transform("m", lambda x: A.total(x["slips"])))
    s = F.size("sentences").cast("double")
    d = d.select(
        *keep, F.length("text").alias("len"), F.size("sentences").alias("s"),
        ((1 - A.entropy_bits(F.col("kinds_n"), s) / math.log2(len(L.OPENING_KINDS) + 1)) * 0.6 + A.ratio(F.size(F.filter(A.lagged_pairs(F.col("kinds"), lambda x, y: x == y), lambda v: v)), s) * 0.4).alias("alike"),
        A.var_pop(F.transform("m", lambda x: x["idioms"])).alias("idioms"), A.var_pop(F.transform("m", lambda x: x["balance"])).alias("balance"), slips.alias("slips"), A.mean(each).alias("slips_var"),
        A.mean(A.lagged_pairs(F.col("m"), change)).alias("drift"), ((both("own") + both("kinds")) / 2).alias("same"),
    )
    scores = {
        "openings": 1 - F.col("alike"), "idioms": S.normalize(F.col("idioms"), 0, 3), "complexity": S.normalize(F.col("balance"), 0, 2),
        "errors": F.when(F.col("slips") == 0, lit(0.2)).otherwise(S.normalize(F.col("slips_var"), 0, 2)), "drift": S.normalize(F.col("drift"), 0, 3), "segments": 1 - F.col("same"),
    }
    p = scores["openings"] * 0.15 + scores["idioms"] * 0.15 + scores["complexity"] * 0.2 + (1 - scores["errors"]) * 0.15 + (1 - scores["drift"]) * 0.2 + scores["segments"] * 0.15
    sure = S.ladder(F.col("s"), [(10, 0.3), (20, 0.6), (40, 0.75)], 0.85)
    return _row(d, keep, "Intra-document Inconsistency", 16, (F.col("len") >= 300) & (F.col("s") >= 8), p, sure, scores)


def undecided_ensemble(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row the combining category gives when it sees no other category: always a half."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("len"))
    return _scored(d, "Multi-Head Ensemble", 17, F.col("len") >= 100, lit(0.5), lit(0.6), {k: lit(0.5) for k in L.HEADS})


def heads(categories: DataFrame) -> DataFrame:
    """Categories of a document put together by heads: each head's mean by confidence (of those above 0.1,
    a half if there are none), the weighted mean of the heads, how far they agree, and their conflicts."""
    head = F.lit(None).cast("string")
    for k, (numbers, _) in L.HEADS.items():
        head = F.when(F.col("category").isin(*numbers), k).otherwise(head)
    ok = F.col("confidence") > 0.1
    p, c = F.col("ai_probability"), F.col("confidence")
    sums = [F.sum(F.when(ok & (F.col("head") == k), x)).alias(f"{k}_{n}") for k in L.HEADS for n, x in (("w", c), ("p", p * c))]
    d = categories.withColumn("head", head).groupBy("doc_id").agg(*sums)
    d = d.select("doc_id", *[F.coalesce(F.try_divide(f"{k}_p", f"{k}_w"), lit(0.5)).alias(k) for k in L.HEADS])
    total = sum(w for _, w in L.HEADS.values())
    names = list(L.HEADS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    against = [F.when((F.abs(F.col(a) - F.col(b)) > 0.4) & (F.least(a, b) < 0.4) & (F.greatest(a, b) > 0.6), F.abs(F.col(a) - F.col(b))) for a, b in pairs]
    d = d.withColumns({"conflicts": F.array_compact(F.array(*against)), "all": F.array(*names)})
    agreement = 1 - F.least(lit(1), A.std_pop(F.col("all")) * 2)
    strong = F.size(F.filter("all", lambda x: (x > 0.7) | (x < 0.3))) / len(names)
    return A.fenced(
        d.select(
            "doc_id", *names, (sum((F.col(k) * w for k, (_, w) in L.HEADS.items()), lit(0)) / total).alias("ai_probability"), agreement.alias("agreement"),
            S.clamp(agreement * 0.6 + strong * 0.4).alias("confidence"), F.size("conflicts").alias("n_conflicts"), A.mean(F.col("conflicts")).alias("conflict"),
        )
    )


def relative_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How far a text's measures lie from those usual in its kind of writing.

    Measures that divide by words or sentences are 0 without these; texts under 100
    characters are general, undecided and without z-scores."""
    d = segmented(docs, id_col, text_col)
    d = A.with_run_counts(d, counts="tokens")
    text = F.col("text")
    found = lambda p, one: _whole(text, p) if one == 0 else matching.found(text, p, _java(p)) * one
    d = d.select(
        "doc_id", F.length("text").alias("len"), F.size("tokens").cast("double").alias("n"), F.size("sentences").cast("double").alias("s"), F.size("counts").alias("v"), F.size(F.filter("counts", lambda c: c > 2)).alias("often"),
        F.transform("sentences", lambda x: F.size(segment.tokens_web(x))).alias("k"), *[_whole(text, p).alias(k) for k, p in L.COHORT_COUNTS.items()],
        *[sum((found(p, one) for p, one in patterns), F.lit(0)).alias(f"c_{k}") for k, patterns in L.COHORTS.items()],
    )
    best = F.greatest(*[f"c_{k}" for k in L.COHORTS])
    cohort = F.coalesce(*[F.when((best >= 3) & (F.col(f"c_{k}") == best), k) for k in L.COHORTS], F.lit("general"))
    n, s = F.col("n"), F.col("s")
    each = {
        "richness": F.least(A.ratio(F.col("v"), F.sqrt(n)) / 5, lit(1)),
        "complexity": S.normalize(n / F.greatest(s, lit(1)), 5, 35) * 0.6 + S.normalize(A.ratio(F.col("subordinate"), s), 0, 0.5) * 0.4,
        "formality": S.normalize(A.ratio(F.col("formal") * 2 - F.col("informal") - F.col("short"), n) * 100 + 50, 0, 100) / 100,
        "passive": F.least(F.col("passives") / F.greatest(s, lit(1)), lit(1)), "first_person": F.least(F.col("mine") / F.greatest(n, lit(1)), lit(1)),
        "repetition": F.col("often") / F.greatest(F.col("v"), F.lit(1)), "burstiness": F.when(s > 1, S.normalize(exact_var(F.col("k")), 0, 100)).otherwise(lit(0.5)),
    }
    d = d.withColumns({"cohort": cohort, "cohort_confidence": F.least(best / 10, lit(1))} | each)

    def z(i: int, k: str) -> Column:
        out = lit(0)
        for name, (ranges, _) in L.COHORT_RANGES.items():
            mean, std = ranges[i]
            out = F.when(F.col("cohort") == name, (F.col(k) - mean) / std).otherwise(out)
        return out

    limit = lit(2)
    for name, (_, t) in L.COHORT_RANGES.items():
        limit = F.when(F.col("cohort") == name, t).otherwise(limit)
    d = d.withColumns({f"z_{k}": z(i, k) for i, k in enumerate(L.MEASURES)} | {"limit": limit})
    d = d.withColumn("off", F.array(*[F.abs(F.col(f"z_{k}")) for k in L.MEASURES]))
    d = d.withColumns({"mean_abs_z": A.mean(F.col("off")), "n_outliers": F.size(F.filter("off", lambda x: x > F.col("limit"))), "n_extreme": F.size(F.filter("off", lambda x: x > F.col("limit") * 1.5))})
    score = F.least((F.col("n_outliers") + F.col("n_extreme")) * 0.15 + F.when(F.col("mean_abs_z") < 0.3, 0.2).otherwise(0.0), lit(1))
    sure = F.least(F.col("cohort_confidence") * 0.5 + S.normalize(F.col("len").cast("double"), 100, 2000) * 0.5, lit(1))
    ok = F.col("len") >= 100
    return A.fenced(
        d.select(
            "doc_id", F.when(ok, F.col("cohort")).otherwise("general").alias("cohort"), F.when(ok, F.col("cohort_confidence")).otherwise(lit(0)).alias("cohort_confidence"), F.when(ok, score).otherwise(lit(0.5)).alias("relative_score"),
            F.when(ok, sure).otherwise(lit(0)).alias("confidence"), F.when(ok, F.col("n_outliers")).otherwise(0).alias("n_outliers"), F.when(ok, F.col("mean_abs_z")).alias("mean_abs_z"),
            *[F.when(ok, F.col(f"z_{k}")).alias(f"z_{k}") for k in L.MEASURES],
        )
    )


def adjusted(p: Column, relative: Column, cohort_confidence: Column) -> Column:
    """A probability pulled towards the relative score, by up to 0.3 for a sure kind of writing."""
    return p * (1 - cohort_confidence * 0.3) + relative * (cohort_confidence * 0.3)


#: In the form of ``categories.CATEGORIES``.
VOICE_CATEGORIES = {"tone_stability": tone, "word_classes": word_classes, "repetition_patterns": repetition, "inconsistency": inconsistency, "undecided_ensemble": undecided_ensemble}

"""Categories of the richer analysis: grammar, syntax, lexical choice, discourse.

Each is a table of scores from 0 to 1, their weighted mean as the probability,
and a confidence by the text's length. A text that is too short has the probability
0.5 and the confidence 0.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import category_lists as L
from inkstone.functions import matching
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.operators.authorship import segmented
from inkstone.operators.lexical import _jvm, phrase_pattern

BY_TOKENS = [(50, 0.3), (100, 0.5), (200, 0.7), (500, 0.85)]
BY_SENTENCES = [(5, 0.3), (10, 0.5), (20, 0.7), (50, 0.85)]


#: Patterns that count the same, but begin with what is rarer in a text.
SAME_COUNT = {r"\s+[,.:;!?]": r"[,.:;!?](?<=\s[,.:;!?])"}
#: What the categories share of a document, each computed once: see ``read``.
BASE = ("doc_id", "text", "tokens", "sentences", "low", "w", "words", "sw", "paragraphs", "pw")


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``BASE``: the text, also in lower case, its tokens, also by sentence and paragraph, the
    ASCII words of the lower-case text, and the text's ASCII words in lower case. The last two
    differ by two letters only whose lower case is ASCII or holds it."""
    d = segmented(docs, id_col, text_col).withColumns({"low": F.lower("text"), "paragraphs": segment.paragraphs(F.col("text"))})
    d = d.withColumns({"w": F.regexp_extract_all("low", F.lit("[a-z0-9_]+"), 0), "sw": F.transform("sentences", segment.tokens_web), "pw": F.transform("paragraphs", segment.tokens_web)})
    odd = F.contains("text", F.lit("\u0130")) | F.contains("text", F.lit("\u212a"))
    return d.withColumn("words", F.when(odd, segment.ascii_words(F.col("text"))).otherwise(F.col("w"))).select(*BASE)


def alone(category, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of one category, which gives a struct for each document that was ``read``."""
    return A.fenced(category(read(docs, id_col, text_col), ["doc_id"]).select("doc_id", "r.*"))


def together(categories: list, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of several categories without their scores, from one reading of the documents."""
    d, keep = read(docs, id_col, text_col), list(BASE)
    for i, category in enumerate(categories):
        d = category(d, keep).withColumn("r", F.col("r").dropFields("scores")).withColumnRenamed("r", f"r{i}")
        keep = [*keep, f"r{i}"]
    return d.select("doc_id", F.inline(F.array(*[f"r{i}" for i in range(len(categories))])))


def among(words: Column, some: list[str]) -> Column:
    """How many of the words are listed."""
    return F.size(F.filter(words, lambda x: x.isin(*some)))


def listed(pattern: str) -> list[str]:
    """The words of a pattern that is a choice of words between word edges."""
    return re.fullmatch(r"(?:\(\?i\))?\\b\(\?:([A-Za-z0-9_|]+)\)\\b", pattern)[1].lower().split("|")


def _count(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    return sum((matching.times(text, p, _jvm(SAME_COUNT.get(p, p)), low) for p in patterns), F.lit(0))


def _contained(low: Column, phrases: list[str]) -> Column:
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def _row(d: DataFrame, keep: list[str], name: str, number: int, ok: Column, scores: dict[str, tuple[Column, float]], confidence: Column) -> DataFrame:
    d = d.select(*keep, ok.alias("_ok"), confidence.alias("_c"), *[c.alias(f"_{k}") for k, (c, _) in scores.items()])
    p = sum(F.col(f"_{k}") * w for k, (_, w) in scores.items())
    part = F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*[F.when(F.col("_ok"), F.round(f"_{k}", 6)) for k in scores]))
    r = {
        "name": F.lit(name), "category": F.lit(number), "ai_probability": F.when(F.col("_ok"), p).otherwise(lit(0.5)), "confidence": F.when(F.col("_ok"), F.col("_c")).otherwise(lit(0)), "scores": part,
    }
    return d.select(*keep, F.struct(*[c.alias(k) for k, c in r.items()]).alias("r"))


def _result(d: DataFrame, name: str, number: int, ok: Column, scores: dict[str, tuple[Column, float]], confidence: Column) -> DataFrame:
    return A.fenced(_row(d, ["doc_id"], name, number, ok, scores, confidence).select("doc_id", "r.*"))


def grammar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Few errors, formal phrases, no self-corrections, sentences that start alike."""
    return alone(_grammar, docs, id_col, text_col)


def _grammar(d: DataFrame, keep: list[str]) -> DataFrame:
    d = d.withColumn("start", F.transform("sentences", lambda x: F.lower(F.array_join(F.slice(F.split(x, f"[{segment.SPACE}]+", 4), 1, 3), " "))))
    d = A.with_run_counts(d, starts="start")
    d = d.select(
        *keep, F.size("tokens").alias("n"), F.size("sentences").alias("s"), _count(F.col("text"), L.GRAMMAR_ERRORS, F.col("low")).alias("errors"),
        _count(F.col("text"), ["(?i)" + phrase_pattern(p) for p in L.FORMAL_PHRASES], F.col("low")).alias("formal"), _count(F.col("text"), L.SELF_CORRECTIONS, F.col("low")).alias("fixes"),
        A.total(F.filter("starts", lambda c: c > 1)).alias("again"),
    )
    n, s = F.col("n"), F.col("s")
    scores = {
        "few_errors": (1 - S.normalize(A.ratio(F.col("errors"), n) * 1000, 0, 10), 0.3),
        "formality": (F.when(s > 0, S.normalize(F.col("formal") / s, 0, 0.3)).otherwise(lit(0)), 0.25),
        "no_corrections": (1 - S.normalize(F.col("fixes").cast("double"), 0, 5), 0.25),
        "repetition": (S.normalize(A.ratio(F.col("again"), s), 0, 0.5), 0.2),
    }
    return _row(d, keep, "Grammar & Error Patterns", 1, n > 0, scores, S.ladder(n, BY_TOKENS, 0.95))


def sentence_kind(low: Column) -> Column:
    """Which conjunctions a lower-case sentence has: a key of KINDS."""
    any_of = lambda some: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in some])
    sub = any_of([f"{c} " for c in L.SUBORDINATORS] + [f", {c}" for c in L.SUBORDINATORS])
    co = any_of([f" {c} " for c in L.COORDINATORS])
    return F.concat(F.when(sub, "s").otherwise(""), F.when(co, "c").otherwise(""))


#: By whether there is a subordinating (s) and a coordinating (c) conjunction.
KINDS = {"": "simple", "c": "compound", "s": "complex", "sc": "compound-complex"}


def syntax(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Even lengths and rhythm, few kinds of sentences, many conjunctions."""
    return alone(_syntax, docs, id_col, text_col)


def _syntax(d: DataFrame, keep: list[str]) -> DataFrame:
    d = d.withColumns({"a": F.transform("sw", F.size), "kind": F.transform(F.transform("sentences", F.lower), sentence_kind)})
    d = A.with_run_counts(d, kinds="kind")
    d = d.select(
        *keep, F.size("sentences").cast("double").alias("s"), A.mean(F.col("a")).alias("m"), A.std_pop(F.col("a")).alias("sd"), A.entropy_bits(F.col("kinds"), F.size("kind").cast("double")).alias("h"),
        among(F.col("words"), L.COORDINATORS).alias("conj"), _contained(F.col("low"), L.TRANSITIONS).alias("trans"),
    )
    s, m, sd = F.col("s"), F.col("m"), F.col("sd")
    burst = F.when(sd != m, (sd - m) / (sd + m + lit(0.001))).otherwise(lit(0))
    scores = {
        "even_lengths": (1 - S.normalize(A.ratio(sd, m), 0.3, 0.8), 0.25),
        "even_rhythm": (1 - S.normalize(burst + 1, 0, 1), 0.25),
        "one_structure": (1 - F.col("h") / F.log2(F.greatest(lit(4), s)), 0.25),
        "conjunctions": (S.normalize(A.ratio(F.col("conj"), s), 0, 2) * 0.5 + S.normalize(A.ratio(F.col("trans"), s), 0, 0.3) * 0.5, 0.25),
    }
    return _row(d, keep, "Sentence Structure & Syntax", 2, s > 0, scores, S.ladder(s, BY_SENTENCES, 0.95))


def lexical_choice(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Little variety, few words used once, overused vocabulary, one register."""
    return alone(_lexical_choice, docs, id_col, text_col)


def _lexical_choice(d: DataFrame, keep: list[str]) -> DataFrame:
    d = d.withColumn("content", F.filter("tokens", lambda t: ~t.isin(*L.STOP_WORDS) & (F.length(t) > 2)))
    d = A.with_run_counts(d, counts="tokens", own="content")
    low = F.col("low")
    single = [w for w in L.OVERUSED_WORDS if "-" not in w]
    d = d.select(
        *keep, F.size("tokens").alias("n"), F.size("counts").alias("v"), F.size("own").alias("cv"), F.size(F.filter("own", lambda c: c == 1)).alias("c1"),
        (among(F.col("w"), single) + _count(low, [rf"\b{w}\b" for w in L.OVERUSED_WORDS if "-" in w], low)).alias("over"),
        _contained(low, L.OVERUSED_PHRASES).alias("phrases"), _contained(low, L.ACADEMIC_WORDS).alias("academic"),
        F.size(F.array_distinct(F.filter("w", lambda x: x.isin(*L.CONVERSATIONAL_WORDS)))).alias("casual"),
    )
    n = F.col("n")
    over = F.least(lit(1), S.normalize(A.ratio(F.col("over"), n), 0, 0.05) + F.least(lit(0.3), F.col("phrases") * 0.05))
    register = F.when((F.col("academic") > 0) & (F.col("casual") == 0), lit(0.8)).otherwise((1 - S.normalize(F.col("casual").cast("double"), 0, 5)) * 0.5)
    scores = {
        "little_variety": (1 - S.normalize(A.ratio(F.col("v"), n), 0.25, 0.65), 0.25),
        "flattening": (1 - S.normalize(A.ratio(F.col("c1"), F.col("cv")), 0.2, 0.6), 0.2),
        "overused_words": (over, 0.35),
        "one_register": (register, 0.2),
    }
    return _row(d, keep, "Lexical Choice & Vocabulary", 3, n >= 10, scores, S.ladder(n, BY_TOKENS, 0.95))


def _plain(pattern: str) -> str:
    """A pattern for ``rlike``, with word edges by ASCII words."""
    return re.sub(r"^(\(\?i\))?\\b", r"\1(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")


def discourse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Smooth transitions, even paragraphs, many markers, predictable progress."""
    return alone(_discourse, docs, id_col, text_col)


def _discourse(d: DataFrame, keep: list[str]) -> DataFrame:
    stop = F.array(*map(F.lit, L.STOP_WORDS))
    every = [m for ms in L.MARKERS.values() for m in ms]
    low = F.col("low")
    content = lambda i: F.array_except(F.coalesce(F.get("pw", i), F.array().cast("array<string>")), stop)
    d = d.withColumns({"k": F.transform("pw", F.size), "flow": F.array_join("sentences", " "), "first": content(F.lit(0)), "last": content(F.size("pw") - 1)})
    inside = sum((F.when(F.contains(low, F.lit(m)), (F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / lit(len(m))).otherwise(lit(0)) for m in every), lit(0))
    d = d.select(
        *keep, F.size("sentences").cast("double").alias("s"), F.size("paragraphs").alias("p"), A.cv(F.col("k")).alias("cv"), inside.alias("transitions"),
        _count(F.col("text"), ["(?i)" + phrase_pattern(m).replace(r"\s+", " ") for m in every], low).alias("markers"), _count(F.col("flow"), L.RESTATEMENTS).alias("again"), _count(F.col("flow"), L.DIGRESSIONS).alias("aside"),
        A.ratio(F.size(F.array_intersect("first", "last")), F.least(F.size("first"), F.size("last"))).alias("overlap"),
    )
    s = F.col("s")
    predictable = S.normalize(F.col("again").cast("double"), 0, 3) * 0.3 + S.normalize(F.col("overlap"), 0.3, 0.7) * 0.4 + (1 - S.normalize(F.col("aside").cast("double"), 0, 3)) * 0.3
    scores = {
        "smooth": (S.normalize(A.ratio(F.col("transitions"), s), 0, 0.3), 0.25),
        "even_paragraphs": (F.when(F.col("p") >= 2, 1 - S.normalize(F.col("cv"), 0.2, 0.6)).otherwise(lit(0.5)), 0.2),
        "markers": (S.normalize(A.ratio(F.col("markers"), s), 0, 0.4), 0.3),
        "predictable": (predictable, 0.25),
    }
    sure = F.when((F.col("p") < 2) | (s < 10), lit(0.3)).when(s < 20, lit(0.5)).when(s < 50, lit(0.7)).otherwise(lit(0.9))
    return _row(d, keep, "Discourse & Coherence", 6, s >= 5, scores, sure)


def semantics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Generic rather than concrete, without experience, hedged claims, no stance."""
    return alone(_semantics, docs, id_col, text_col)


def _semantics(d: DataFrame, keep: list[str]) -> DataFrame:
    text, low = F.col("text"), F.col("low")

    def unsupported(claim: str) -> Column:
        found = F.regexp_extract(text, f"(?i){claim}", 0)
        after = text.substr(F.instr(text, found), F.lit(100))
        return F.when(F.contains(low, F.lit(claim)), ((found != "") & ~after.rlike(L.CITED.replace(r"\s", f"[{segment.SPACE}]"))).cast("int")).otherwise(0)

    d = d.select(
        *keep, F.size("tokens").alias("n"), F.size("sentences").alias("s"), _contained(low, L.GENERIC_PHRASES).alias("generic"), _count(text, L.CONCRETE, low).alias("concrete"),
        sum((matching.found(low, rf"\b{w}\b", _plain(rf"\b{w}\b"), low) for w in L.EXPERIENCE), F.lit(0)).alias("lived"),
        F.when(F.array_contains("words", "i"), F.size(F.filter("sentences", lambda x: x.rlike(_plain(L.ANECDOTE).replace(r"\s", f"[{segment.SPACE}]"))))).otherwise(0).alias("told"),
        among(F.col("words"), listed(L.QUALIFIED)).alias("hedged"), among(F.col("words"), listed(L.ASSERTIVE)).alias("firm"), sum((unsupported(c) for c in L.CLAIMS), F.lit(0)).alias("claims"),
        _contained(low, L.NONCOMMITTAL).alias("neutral"), _contained(low, L.STRONG_STANCE).alias("strong"), among(F.col("words"), listed(L.FOR)).alias("pro"), among(F.col("words"), listed(L.AGAINST)).alias("con"),
    )
    n, s = F.col("n"), F.col("s")
    specific = (1 - S.normalize(A.ratio(F.col("generic"), s), 0, 0.3)) * 0.5 + S.normalize(A.ratio(F.col("concrete"), s), 0, 0.5) * 0.5
    hedged = S.normalize(A.ratio(F.col("hedged"), F.col("hedged") + F.col("firm"), 0.5), 0.3, 0.7) * 0.5 + S.normalize(F.col("claims").cast("double"), 0, 3) * 0.5
    even = (F.col("pro") > 0) & (F.col("con") > 0) & (F.abs(F.col("pro") - F.col("con")) <= 1)
    neutral = S.normalize(F.col("neutral").cast("double"), 0, 4) * 0.4 + (1 - S.normalize(F.col("strong").cast("double"), 0, 3)) * 0.3 + F.when(even, lit(0.3)).otherwise(lit(0))
    scores = {
        "unspecific": (1 - specific, 0.25),
        "no_experience": (1 - S.normalize((F.col("lived") + F.col("told") * 2).cast("double"), 0, 8), 0.3),
        "hedged": (hedged, 0.2),
        "noncommittal": (neutral, 0.25),
    }
    return _row(d, keep, "Semantic & Pragmatic Features", 7, n >= 30, scores, S.ladder(n, BY_TOKENS, 0.9))


def dialect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mixtures: of spellings, of punctuation, of regional words, of slang and archaic words."""
    return alone(_dialect, docs, id_col, text_col)


def _dialect(d: DataFrame, keep: list[str]) -> DataFrame:
    every = L.AMERICAN_SPELLING + L.BRITISH_SPELLING + L.AMERICAN_WORDS + L.BRITISH_WORDS + L.MODERN_SLANG + L.ARCHAIC_FORMAL
    d = d.withColumn("hits", F.array_distinct(F.filter("w", lambda x: x.isin(*every))))
    text, low = F.col("text"), F.col("low")

    def held(words: list[str]) -> Column:
        return among(F.col("hits"), words)

    d = d.select(
        *keep, F.size("tokens").alias("n"), held(L.AMERICAN_SPELLING).alias("us"), held(L.BRITISH_SPELLING).alias("uk"), held(L.AMERICAN_WORDS).alias("us_words"), held(L.BRITISH_WORDS).alias("uk_words"),
        (held(L.MODERN_SLANG) + sum((matching.found(low, rf"\b{p}\b", _plain(rf"\b{p}\b"), low) for p in L.MODERN_PHRASES), F.lit(0))).alias("modern"), held(L.ARCHAIC_FORMAL).alias("archaic"),
        F.regexp_count(text, F.lit('"')).alias("dq"), F.regexp_count(text, F.lit("'")).alias("sq"),
        *[_count(text, [p], low).alias(k) for k, p in (("oxford", L.OXFORD), ("no_oxford", L.NO_OXFORD), ("us_dates", L.US_DATES), ("uk_dates", L.UK_DATES))],
    )

    def mixed(a: str, b: str, most: int) -> Column:
        return S.normalize(F.least(a, b).cast("double"), 0, most)

    def both(a: Column, b: Column, x: float) -> Column:
        return F.when(a & b, lit(x)).otherwise(lit(0))

    marks = both(F.col("dq") > 0, F.col("sq") > 5, 0.3) + both(F.col("oxford") > 0, F.col("no_oxford") > 0, 0.4) + both(F.col("us_dates") > 0, F.col("uk_dates") > 0, 0.3)
    n = F.col("n")
    scores = {"spelling": (mixed("us", "uk", 3), 0.3), "punctuation": (marks, 0.2), "words": (mixed("us_words", "uk_words", 2), 0.25), "times": (mixed("modern", "archaic", 2), 0.25)}
    return _row(d, keep, "Dialect & Regional Consistency", 4, n >= 20, scores, S.ladder(n, [(50, 0.2), (100, 0.4), (200, 0.6), (500, 0.8)], 0.9))


def web_categories(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``name``, ``category``, ``ai_probability``, ``confidence``: a row for each document and category."""
    return together(PARTS, docs, id_col, text_col)


#: What a category has to be: a function from documents to rows of ``web_categories`` with their scores.
CATEGORIES = [grammar, syntax, lexical_choice, dialect, discourse, semantics]
#: The same, from documents that were ``read`` to a struct ``r`` beside the columns to keep.
PARTS = [_grammar, _syntax, _lexical_choice, _dialect, _discourse, _semantics]


def lexical_span(tokens: Column, threshold: float = 0.72) -> Column:
    """Mean length of runs of tokens before their variety falls to the threshold;
    0 for fewer than ten tokens."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), lit(0).alias("k"), lit(0).alias("f"))

    def step(a, t):
        seen = F.when(F.array_contains(a["seen"], t), a["seen"]).otherwise(F.array_append(a["seen"], t))
        full = F.size(seen) / (a["k"] + 1) <= threshold
        return F.struct(F.when(full, F.array().cast("array<string>")).otherwise(seen).alias("seen"), (F.when(full, lit(0)).otherwise(a["k"]) + 1).alias("k"), (a["f"] + full.cast("double")).alias("f"))

    end = F.aggregate(tokens, start, step, lambda a: a["f"] + F.when(a["k"] > 0, (1 - F.size(a["seen"]) / a["k"]) / lit(1 - threshold)).otherwise(lit(0)))
    return F.when(F.size(tokens) >= 10, F.size(tokens) / F.greatest(lit(1), end)).otherwise(lit(0))


def combined(categories: DataFrame, weights: dict[int, float] | None = None, least: float = 0.2) -> DataFrame:
    """Categories of a document put together: weighted mean, log odds, agreement and
    contradiction. Those of a confidence up to ``least`` don't count."""
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col("category") == k, lit(v)).otherwise(w)
    q = S.clamp(F.col("ai_probability"), 0.001, 0.999)
    c = categories.filter(F.col("confidence") > least).withColumns({"w": w * F.col("confidence"), "odds": F.log(q / (1 - q))})
    c = c.groupBy("doc_id").agg(
        F.count("*").alias("n_categories"), F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("ai_probability")).alias("wp"), F.sum(F.col("w") * F.col("odds")).alias("wo"),
        F.stddev_pop("ai_probability").alias("sd"), F.count_if(F.col("ai_probability") > 0.65).alias("n_ai"), F.count_if(F.col("ai_probability") < 0.35).alias("n_human"), F.avg("confidence").alias("mean_confidence"),
    )
    return c.select(
        "doc_id", "n_categories", (F.col("wp") / F.col("ws")).alias("weighted"), (1 / (1 + F.exp(-F.col("wo") / F.col("ws")))).alias("log_odds"), (1 - F.least(lit(1), F.col("sd") * 2)).alias("agreement"),
        "n_ai", "n_human", ((F.col("n_ai") >= 2) & (F.col("n_human") >= 2)).alias("contradictory"), "mean_confidence",
    )

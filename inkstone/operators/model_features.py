"""Feature vectors of the learned models, and the tone features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import category_lists as L
from inkstone.functions import matching
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.operators.lexical import _jvm

#: The order of the model's 31 features (fixed values).
NAMES_31 = """third_he_she first_me answer_opener ellipsis_count instruction_phrases attribution numbered_items helpful_phrases proper_nouns
avg_sent_len sent_len_std sent_count min_sent_len para_count first_I first_we second_you colon_rate question_rate paren_count month_mentions
year_mentions time_mentions specific_dates has_code has_html discourse_markers contraction_rate casual_words word_count vocab_richness""".split()


def model_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The 31 features, in order; all null for a text below ten characters."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({"w": F.split("text", f"[{segment.SPACE}]+"), "s": F.filter(F.split("text", "[.!?]+"), lambda x: segment.trim(x) != "")})
    d = d.withColumn("k", F.transform("s", segment.words_by_space))
    n, s = F.size("w").cast("double"), F.greatest(F.size("s"), F.lit(1)).cast("double")
    text = F.col("text")
    v: dict[str, Column] = {k: matching.times(text, p, _jvm(p)).cast("double") for k, p in L.MODEL_COUNTS.items()}
    v |= {k: v[k] / n for k in L.BY_WORD} | {k: v[k] / s for k in L.BY_SENTENCE}
    v |= {
        "answer_opener": segment.trim(text).rlike("(?i)^(?:Yes|No|Sure|Certainly|Of course|Absolutely)(?![A-Za-z0-9_])").cast("double"),
        "numbered_items": F.regexp_count(text, F.lit(rf"(?m)^[{segment.SPACE}]*\d+[.)][{segment.SPACE}]+")).cast("double"),
        "avg_sent_len": A.mean(F.col("k")), "sent_len_std": A.std_pop(F.col("k")), "sent_count": s, "min_sent_len": F.coalesce(F.array_min("k"), F.lit(0)).cast("double"),
        "para_count": F.size(F.filter(F.split("text", r"\n\n"), lambda p: segment.trim(p) != "")).cast("double"),
        "has_code": text.rlike(rf"```|def[{segment.SPACE}]+[A-Za-z0-9_]+|function[{segment.SPACE}]*\(").cast("double"), "has_html": text.rlike("(?i)<[a-z]+[^>]*>").cast("double"),
        "word_count": n, "vocab_richness": F.size(F.array_distinct(F.transform("w", F.lower))) / n,
    }
    enough = F.length("text") >= 10
    return A.fenced(d.select("doc_id", *[F.when(enough, v[k]).alias(k) for k in NAMES_31]))


def scale(features: DataFrame, means: dict[str, float], scales: dict[str, float]) -> DataFrame:
    """(x - mean) / scale of each named feature; a scale of 0 leaves the difference."""
    return features.select(*[((F.col(c) - means[c]) / (scales[c] or 1.0)).alias(c) if c in means else F.col(c) for c in features.columns])


def tone_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Formality, emotion, hedging, persons, questions, passives, even paragraphs, n-gram entropy."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("w", F.split(F.lower("text"), f"[{segment.SPACE}]+"))
    d = d.withColumns({"pair": A.ngrams(F.col("w"), 2), "triple": A.ngrams(F.col("w"), 3), "k": F.transform(F.filter(F.split("text", r"\n\n+"), lambda p: segment.trim(p) != ""), lambda p: F.size(F.split(p, f"[{segment.SPACE}]+")))})
    d = A.with_run_counts(d, pairs="pair", triples="triple")
    n = F.size("w").cast("double")
    sentences = F.greatest(F.size(F.filter(F.split("text", "[.!?]+"), lambda x: segment.trim(x) != "")), F.lit(1))

    def share(words: list[str]) -> Column:
        return F.size(F.filter("w", lambda x: x.isin(*words))) / n

    def entropy(c: str) -> Column:
        total = A.total(F.col(c))
        return F.when(total > 1, A.entropy_bits(F.col(c), total) / F.log2(total)).otherwise(lit(0))

    passive = sum((F.regexp_count("text", _jvm(rf"(?i)\b(?:is|are|was|were|be|been|being)\s+\w+{end}\b")) for end in ("ed", "en")), F.lit(0))
    even = S.clamp(1 - A.std_pop(F.col("k")) / F.greatest(A.mean(F.col("k")), lit(1)))
    return A.fenced(
        d.select(
            "doc_id", S.clamp(lit(0.5) + share(L.FORMAL_MARKERS) * 10 - share(L.CONTRACTIONS) * 5).alias("formality"), (share(L.EMOTIONAL_WORDS) + F.regexp_count("text", F.lit("!")) * 0.5 / n).alias("emotion"),
            share(L.HEDGE_WORDS).alias("hedging"), share(L.FIRST_SINGULAR).alias("first_singular"), share(L.FIRST_PLURAL).alias("first_plural"),
            (F.regexp_count("text", F.lit(r"\?")) / sentences).alias("questions"), (passive / sentences).alias("passives"), F.when(F.size("k") >= 2, even).otherwise(lit(0.5)).alias("even_paragraphs"),
            entropy("pairs").alias("pair_entropy"), entropy("triples").alias("triple_entropy"),
        )
    )


def tone_verdict(score: Column) -> Column:
    return S.ladder(score, [(0.35, "Human Written"), (0.50, "Likely Human"), (0.65, "Mixed/Uncertain"), (0.85, "Likely AI")], "AI Generated")

"""The 61 features for texts that were rewritten to seem less even, one row for each document.

Words are runs of letters a-z that no other letter, digit or underscore touches. Texts of
fewer than ten characters, null ones included, have all features 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import artifact_lists as L
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.operators.categories import _contained
from inkstone.operators.voice_categories import _java, _listed

#: Letters and digits beyond ASCII, which a digit stands in for so that word edges can be told by ASCII.
OTHER_WORD = r"(?![\x00-\x7F])[\p{L}\p{N}]"

#: In the order of the feature vector (fixed values).
NAMES = """ai_human_cooccurrence ai_phrase_count ai_phrase_density avg_sentence_length avg_word_length bigram_repeat_ratio burstiness_coef char_count
composite_humanization_score contraction_count contraction_density contraction_distribution_std contraction_shift contractions_with_ai_phrases
deliberate_typo_score disfluency_count disfluency_density disfluency_variety double_punct_count ellipsis_count em_dash_count emphatic_count
emphatic_density exclamation_count formal_slang_product formal_structure_casual_language formal_word_count formal_word_density formality_shift
fragment_count fragment_density hapax_ratio hedge_uniformity hedging_count hedging_density informal_contraction_count informal_contraction_density
long_sentences_with_disfluencies passive_voice_density register_inconsistency rhetorical_formal_combo rhetorical_question_count
rhetorical_question_density sentence_count sentence_length_range sentence_length_std sentence_start_disfluency_count
sentence_start_disfluency_ratio sentence_start_variety slang_count slang_density technical_with_typos transition_density trigram_repeat_ratio
typo_count typo_density typo_position_variance unique_word_ratio word_count word_length_variance word_rarity_variance""".split()


def words_alone(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[a-z]+$"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, OTHER_WORD, "0")


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(_plain(text), F.lit(_java(pattern)))


def artifact_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({"w": words_alone(F.col("text")), "sent": segment.sentences_v2(F.col("text")), "low": F.lower("text"), "plain": _plain(F.col("text"))})
    half = F.floor(F.size("sent") / 2).cast("int")
    d = d.withColumns({
        "k": F.transform("w", F.length), "pair": A.ngrams(F.col("w"), 2), "triple": A.ngrams(F.col("w"), 3), "sizes": F.transform("sent", segment.words_by_space),
        "starts": F.transform("sent", lambda x: F.lower(F.get(F.split(x, f"[{segment.SPACE}]+"), F.lit(0)))), "short": F.regexp_count("plain", F.lit(_java(L.CONTRACTION))), "n_hedging": _listed(F.col("w"), L.WORDS["hedging"]),
        "said": F.transform(F.regexp_extract_all("plain", F.lit(_java(L.DISFLUENCY)), 0), F.lower),
        "at": F.filter(F.transform("w", lambda t, i: F.when(t.isin(*L.WORDS["typo"]), i)), lambda i: i.isNotNull()),
        "halves": F.array(F.array_join(F.slice("sent", 1, half), " "), F.array_join(F.slice("sent", half + 1, F.size("sent")), " ")),
    })
    d = A.with_run_counts(d, counts="w", pairs="pair", triples="triple")
    short_in = lambda x: F.when(F.col("short") > 0, _times(x, L.CONTRACTION)).otherwise(0)  # noqa: E731 - a sentence's contractions and words are the text's as well
    part = lambda x: A.let(words_alone(x), lambda w: F.struct(_listed(w, L.WORDS["formal"]).alias("formal"), short_in(x).alias("short"), F.greatest(F.size(w), F.lit(1)).alias("n")))
    count = lambda p: F.regexp_count("plain", F.lit(_java(p)))
    d = d.withColumns({"halves": F.transform("halves", part), "per": F.transform("sent", short_in), "hedges": F.transform("sent", lambda x: F.when(F.col("n_hedging") > 0, _listed(words_alone(x), L.WORDS["hedging"])).otherwise(0))} | {f"n_{k}": _listed(F.col("w"), words) for k, words in L.WORDS.items() if k not in ("common", "hedging")})
    d = d.withColumns({
        "n": F.size("w").cast("double"), "s": F.size("sent").cast("double"), "casual": count(L.CASUAL_CONTRACTION), "asked": count(L.RHETORICAL),
        "opened": F.regexp_count("plain", F.lit("(?imd)" + L.STARTING_DISFLUENCY)), "phrases": _contained(F.col("low"), L.STOCK_PHRASES), "gaps": A.lagged_pairs(F.col("at"), lambda x, y: y - x),
        "std": F.when(F.size("sizes") > 1, A.std_pop(F.col("sizes"))).otherwise(lit(0)),
    })
    n, s = F.greatest("n", lit(1)), F.greatest("s", lit(1))
    formal, slang, typos, phrases, short = F.col("n_formal"), F.col("n_slang"), F.col("n_typo"), F.col("phrases"), F.col("short")
    said, fragments, asked = F.size("said"), _contained(F.col("low"), L.FRAGMENTS), F.col("asked")
    both = lambda *c: F.when(c[0] & c[1], 1.0).otherwise(0.0)
    density = lambda c: c / n * 100
    shift = lambda k: F.when(F.col("s") >= 4, F.abs(F.get("halves", F.lit(0))[k] / F.get("halves", F.lit(0))["n"] - F.get("halves", F.lit(1))[k] / F.get("halves", F.lit(1))["n"])).otherwise(lit(0))
    repeats = lambda c: F.when(F.col("n") >= 5, A.ratio(F.size(F.filter(c, lambda x: x > 1)), A.total(F.col(c)))).otherwise(lit(0))
    rare = F.transform("w", lambda t: t.isin(*L.WORDS["common"]).cast("int"))
    f = {
        "char_count": F.length("text"), "word_count": F.col("n"), "sentence_count": s, "avg_word_length": A.mean(F.col("k")), "avg_sentence_length": F.col("n") / s,
        "unique_word_ratio": F.size("counts") / n, "hapax_ratio": F.size(F.filter("counts", lambda c: c == 1)) / n, "sentence_length_std": F.col("std"),
        "sentence_length_range": F.coalesce(F.array_max("sizes") - F.array_min("sizes"), F.lit(0)), "burstiness_coef": A.ratio(F.col("std"), A.mean(F.col("sizes"))),
        "ai_phrase_count": phrases, "ai_phrase_density": density(phrases), "formal_word_count": formal, "formal_word_density": density(formal), "transition_density": density(F.col("n_transition")),
        "sentence_start_variety": F.when(F.col("s") > 2, F.size(F.array_distinct("starts")) / s).otherwise(lit(1)), "passive_voice_density": density(_contained(F.col("low"), L.PASSIVES)),
        "contraction_count": short, "contraction_density": density(short), "informal_contraction_count": F.col("casual"), "informal_contraction_density": density(F.col("casual")),
        "contraction_distribution_std": F.when(F.col("s") > 2, A.std_pop(F.col("per"))).otherwise(lit(0)), "disfluency_count": said, "disfluency_density": density(said),
        "sentence_start_disfluency_count": F.col("opened"), "sentence_start_disfluency_ratio": F.col("opened") / s, "disfluency_variety": F.size(F.array_distinct("said")) / F.greatest(said, F.lit(1)),
        "typo_count": typos, "typo_density": density(typos), "typo_position_variance": A.std_pop(F.col("gaps")), "hedging_count": F.col("n_hedging"), "hedging_density": density(F.col("n_hedging")),
        "emphatic_count": F.col("n_emphatic"), "emphatic_density": density(F.col("n_emphatic")), "rhetorical_question_count": asked, "rhetorical_question_density": asked / s,
        "slang_count": slang, "slang_density": density(slang), "fragment_count": fragments, "fragment_density": fragments / s,
        **{k: F.regexp_count("text", F.lit(p)) for k, p in L.SIGNS.items()},
        "formal_slang_product": formal * slang / n, "register_inconsistency": F.when(formal + slang > 0, F.abs(formal / n - slang / n)).otherwise(lit(0)),
        "formality_shift": shift("formal"), "contraction_shift": shift("short"), "ai_human_cooccurrence": phrases * (said + F.col("casual")) / n,
        "formal_structure_casual_language": both(_contained(F.col("low"), L.STRUCTURE) > 0, F.col("casual") + slang > 0), "technical_with_typos": both(formal >= 3, typos >= 1),
        "long_sentences_with_disfluencies": both(F.col("n") / s > 20, said >= 3), "deliberate_typo_score": density(typos),
        "hedge_uniformity": F.when(F.col("s") > 3, S.clamp(1 - A.std_pop(F.col("hedges")) / (A.mean(F.col("hedges")) + 0.001))).otherwise(lit(0.5)),
        "rhetorical_formal_combo": both(asked >= 2, formal >= 3), "contractions_with_ai_phrases": both(short >= 5, phrases >= 1),
        "word_length_variance": F.when(F.col("n") >= 5, A.var_pop(F.col("k"))).otherwise(lit(0)), "word_rarity_variance": F.when(F.col("n") >= 5, A.var_pop(rare)).otherwise(lit(0)),
        "bigram_repeat_ratio": repeats("pairs"), "trigram_repeat_ratio": repeats("triples"),
    }
    signals = ["formal_structure_casual_language", "technical_with_typos", "long_sentences_with_disfluencies", "rhetorical_formal_combo", "contractions_with_ai_phrases"]
    f["composite_humanization_score"] = (sum((f[k] for k in signals), lit(0)) + F.least(f["deliberate_typo_score"] / 2, lit(1))) / 6
    ok = F.length(segment.trim(F.col("text"))) >= 10
    return A.fenced(d.select("doc_id", *[F.when(ok, f[k].cast("double")).otherwise(lit(0)).alias(k) for k in NAMES]))

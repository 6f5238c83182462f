"""Queries by name, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import arrays, segment
from inkstone.operators import artifact_features, authorship, calibration, categories, charts, evaluation, features, formatting, lexical, model_features, processing, rewrite, rewriting_signals, sentence_scores, sequences, speech, stability, statistics, style_categories, voice_categories
from inkstone.plans import artifact_sql, category_sql, chart_sql, lexical_sql, oracles, processing_sql, sequence_sql, signal_sql, speech_sql, stability_sql, style_sql, voice_sql
from inkstone.sources import files, samples, sinks

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table as it is stored that a task takes at most.
PIECE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table in even pieces, as many for each core. Its files may be few or their parts large, and the
    work on a document costs far more than moving it: a part as it is read would be one task of many minutes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * max(1, -(-size // (PIECE * cores))))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, as engines add up in different orders.
    The small term moves exact halves off the edge, on which they'd differ as well."""
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


def over(name: str, sql: str | None, operator: Callable[[DataFrame], DataFrame], source: str = "documents") -> None:
    """An operator of one table as a query."""
    register(name, sql, lambda spark, sf_dir: operator(spread(table(spark, sf_dir, source))))


FLAGSHIP = "document_analysis"
over("document_analysis", oracles.ANALYSIS, authorship.analyze)
over("category_scores", oracles.CATEGORY_SCORES, authorship.category_scores)
over("findings", oracles.FINDINGS, authorship.findings)
over("vocabulary", oracles.VOCABULARY, statistics.vocabulary)
over("sequence_statistics", oracles.SEQUENCE, statistics.sequence_statistics)
over("ngram_repetition", oracles.NGRAMS, statistics.ngram_repetition)
over("bigram_perplexity", oracles.PERPLEXITY, statistics.bigram_perplexity)
over("adjacent_similarity", oracles.ADJACENT, statistics.adjacent_similarity)
over("top_words", oracles.TOP_WORDS, statistics.top_words)
over("repeated_phrases", oracles.PHRASES, statistics.repeated_phrases)
over("segment_counts", oracles.SEGMENTS, statistics.segment_counts)
over("lexicon_word_counts", lexical_sql.WORD_COUNTS, lexical.word_counts)
over("lexicon_phrase_counts", lexical_sql.PHRASE_COUNTS, lexical.phrase_counts)
over("lexicon_stem_counts", lexical_sql.STEM_COUNTS, lexical.stem_counts)
over("contained_phrases", lexical_sql.CONTAINED, lexical.contained_phrases)
over("pattern_counts", lexical_sql.PATTERN_COUNTS, lexical.pattern_counts)
over("word_shapes", None, lexical.word_shapes)
over("readability", lexical_sql.READABILITY, lexical.readability)
over("formatting", oracles.FORMATTING, formatting.formatting)
over("classic_features", oracles.FEATURES, features.classic_features)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of labelled documents; ``quality`` stands in for a label of authorship."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = spread(docs).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    p = authorship.analyze(known).select("doc_id", F.col("ai_probability").alias("p"), "words", "len_cv", "ttr", "hapax_per_type", "syllables_per_word")
    return known.select("doc_id", "label", "lang", "source").join(p, "doc_id").withColumn("length", evaluation.length_class(F.col("words")))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def _auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.auc(predictions(spark, sf_dir).withColumn("p", F.round("p", 9)))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled_documents(spark, sf_dir).filter(F.regexp_count("text", F.lit(r"\S+")) >= 20)
    return samples.load_report(docs)


def _pasted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", files.pasted_from(F.col("html")).alias("pasted_from"), F.array_join(files.hidden_formatting(F.col("html")), ",").alias("hidden"))


def _turns(turns: DataFrame) -> DataFrame:
    n = F.size(segment.tokens_web(F.col("text"))).cast("long")
    return turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.count_distinct("conv_id").alias("n_conversations"), F.sum(n).alias("n_tokens"))


def _centre_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of each vector with the mean of its label."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return vectors.join(centre, "label").select("vec_id", arrays.cosine(F.col("embedding"), F.col("c")).alias("similarity"))


register("metrics_by_group", oracles.METRICS_BY, lambda spark, sf_dir: evaluation.metrics_by(predictions(spark, sf_dir), ["lang", "source", "length"]))
register("auc", oracles.AUC, _auc)
register("class_comparison", oracles.COMPARE, lambda spark, sf_dir: evaluation.compare_classes(predictions(spark, sf_dir), ["len_cv", "ttr", "hapax_per_type", "syllables_per_word"]))
register("sample_report", oracles.SAMPLE_REPORT, _report)
register("balanced_samples", oracles.BALANCED, lambda spark, sf_dir: samples.balance(labelled_documents(spark, sf_dir)).select("doc_id", "label"))
over("pasted_from", oracles.PASTED, _pasted, "pages")
over("turns_by_role", oracles.TURNS, _turns, "conversations")
over("centre_similarity", oracles.NEAREST, _centre_similarity, "embeddings")
over("report_lines", None, lambda docs: sinks.minimal(authorship.analyze(docs)))
over("web_categories", category_sql.WEB_CATEGORIES, categories.web_categories)
over("model_features", category_sql.MODEL_FEATURES, model_features.model_features)
over("tone_features", category_sql.TONE, model_features.tone_features)
over("rewritten", None, rewrite.rewrite)
over("lexical_span", None, lambda docs: authorship.segmented(docs).select("doc_id", categories.lexical_span(F.col("tokens")).alias("span")))
for _name, _operator in style_categories.STYLE_CATEGORIES.items():
    over(_name, style_sql.STYLE.get(_name), lambda docs, operator=_operator: operator(docs).drop("scores"))
for _name, _operator in voice_categories.VOICE_CATEGORIES.items():
    over(_name, voice_sql.VOICE.get(_name), lambda docs, operator=_operator: operator(docs).drop("scores"))

over("stability_under_rewriting", stability_sql.STABILITY, lambda docs: stability.stability(docs).drop("scores"))


def _heads(docs: DataFrame) -> DataFrame:
    """Heads over the categories that SQL can check, to the digits of its rows."""
    out = categories.together([*categories.PARTS, voice_categories.tone_row, voice_categories.inconsistency_row], docs)
    return voice_categories.heads(rounded(out))


over("category_heads", voice_sql.HEADS, _heads)
over("relative_scores", voice_sql.RELATIVE, voice_categories.relative_scores)
over("artifact_features", artifact_sql.ARTIFACTS, artifact_features.artifact_features)
over("speech_correction", speech_sql.SPEECH, speech.speech_correction)
over("word_sequences", sequence_sql.SEQUENCES, sequences.word_sequences)
over("vocabulary_growth", sequence_sql.GROWTH, sequences.vocabulary_growth)
over("sentence_scores", chart_sql.SENTENCES, sentence_scores.sentence_scores)
over("document_trends", chart_sql.TRENDS, sentence_scores.document_trends)
over("cooccurrence_edges", chart_sql.EDGES_SQL, charts.cooccurrence_edges)
over("cooccurrence_nodes", chart_sql.NODES_SQL, charts.cooccurrence_nodes)
over("repetition_map", chart_sql.REPETITION_MAP, charts.repetition_map)
over("length_histogram", chart_sql.HISTOGRAM, charts.length_histogram)
over("rewriting_signals", signal_sql.SIGNALS, rewriting_signals.rewriting_signals)
over("processing_difficulty", processing_sql.DIFFICULTY, processing.processing_difficulty)
over("text_coherence", processing_sql.COHERENCE, processing.text_coherence)
register("isotonic_calibration", oracles.CALIBRATION, lambda spark, sf_dir: calibration.fit_isotonic(predictions(spark, sf_dir).withColumn("p", F.round("p", 9))))

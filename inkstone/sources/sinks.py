"""Results as text, JSON lines and Markdown, and a history of analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(c * 100, digits)), F.lit("%"))


def minimal(results: DataFrame) -> DataFrame:
    """``doc_id`` and one ``line``: verdict and probability."""
    return results.select("doc_id", F.concat(F.col("verdict"), F.lit(" "), _percent(F.col("ai_probability"))).alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    return results.select("doc_id", F.to_json(F.struct(*[c for c in results.columns if c != "doc_id"])).alias("json"))


def as_text(results: DataFrame) -> DataFrame:
    """A short report on each document."""
    lines = [
        F.concat(F.lit("Verdict: "), F.col("verdict")), F.concat(F.lit("Machine-written: "), _percent(F.col("ai_probability"))), F.concat(F.lit("Confidence: "), _percent(F.col("confidence"))),
        F.concat(F.lit("Range: "), _percent(F.col("ci_lower")), F.lit(" to "), _percent(F.col("ci_upper"))),
        F.concat(F.col("words").cast("string"), F.lit(" words in "), F.col("n_sentences").cast("string"), F.lit(" sentences")),
    ]
    return results.select("doc_id", F.concat_ws("\n", *lines).alias("report"))


def as_markdown(results: DataFrame, category_scores: DataFrame) -> DataFrame:
    """A Markdown report on each document, with a table of its categories."""
    row = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), _percent(F.col("ai_probability")), F.lit(" | "), _percent(F.col("confidence")), F.lit(" |"))
    tables = category_scores.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("category", row.alias("row")))).alias("rows"))
    head = F.concat(F.lit("# "), F.col("verdict"), F.lit("\n\nMachine-written: **"), _percent(F.col("ai_probability")), F.lit("**\n\n| Category | Probability | Confidence |\n|---|---|---|\n"))
    body = F.coalesce(F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit(""))
    return results.join(tables, "doc_id", "left").select("doc_id", F.concat(head, body, F.lit("\n")).alias("report"))


def add_to_history(history: DataFrame, entries: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` entries of both (``id``, ``timestamp``, others); the
    size of a history is the feature."""
    return history.unionByName(entries, allowMissingColumns=True).orderBy(F.desc("timestamp"), "id").limit(keep)


def drop_from_history(history: DataFrame, ids: list) -> DataFrame:
    return history.filter(~F.col("id").isin(ids) | F.col("id").isNull())

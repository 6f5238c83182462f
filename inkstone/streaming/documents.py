"""The analysis of documents as they arrive.

A document's analysis needs only its own row, so a stream of documents is scored
in append mode without state or watermark; a checkpoint lets it go on where it
stopped. Counts over time do keep state, bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators import authorship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, folder: str, schema: str = SCHEMA, files_by_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_by_batch).parquet(folder)


def analyze_stream(documents: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes an analysis of each document to Parquet, exactly once."""
    out = authorship.analyze(documents).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def verdicts_over_time(analyses: DataFrame, time_col: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and mean probability by window and verdict; rows later than ``late`` don't count."""
    return (
        analyses.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window), "verdict")
        .agg(F.count("*").alias("n"), F.avg("ai_probability").alias("mean_probability"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "verdict", "n", "mean_probability")
    )

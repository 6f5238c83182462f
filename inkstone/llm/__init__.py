"""Operators of a training-data pipeline: deduplication, decontamination,
extraction, filtering, mixing and counting over whole corpora."""

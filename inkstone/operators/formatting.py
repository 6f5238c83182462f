"""White space, hidden characters, punctuation style and layout of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions.arrays import lit

#: Invisible characters by kind (fixed values).
HIDDEN = {
    "zero_width_space": r"\x{200B}", "zero_width_non_joiner": r"\x{200C}", "zero_width_joiner": r"\x{200D}", "byte_order_mark": r"\x{FEFF}", "soft_hyphen": r"\x{AD}",
    "invisible_formatter": r"[\x{2060}-\x{206F}]", "private_use": r"[\x{E000}-\x{F8FF}]", "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
}
#: Matches of each pattern (fixed values).
STYLE = {
    "spaces": " ", "tabs": r"\t", "newlines": r"\n", "carriage_returns": r"\r", "multiple_spaces": "  +", "one_space": "[.!?] [A-Z]", "two_spaces": "[.!?]  [A-Z]",
    "straight_quotes": "[\"']", "double_hyphens": "--", "em_dashes": "—", "en_dashes": "–", "three_dots": r"\.\.\.", "ellipsis_signs": "…", "crlf": r"\r\n", "lf": r"[^\r]\n", "cr": r"\r[^\n]",
    "ascii": r"[\x00-\x7F]", "extended": r"[\x{80}-\x{FF}]",
}


def formatting(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and consistency scores; a null text is like an empty one."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.split("text", "\n").alias("lines"),
        *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in {**STYLE, **{f"hidden_{k}": p for k, p in HIDDEN.items()}}.items()],
    )
    per_line = F.transform("lines", lambda x: F.regexp_count(x, F.lit(" ")))
    ends = sum((F.col(c) > 0).cast("int") for c in ("crlf", "lf", "cr"))
    one, two = F.col("one_space"), F.col("two_spaces")
    return d.select(
        "doc_id", "n_chars", F.size("lines").cast("long").alias("n_lines"), *STYLE, *[f"hidden_{k}" for k in HIDDEN],
        sum(F.col(f"hidden_{k}") for k in HIDDEN).alias("hidden"), (F.col("n_chars") - F.col("ascii") - F.col("extended")).alias("unicode"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[ \t]+$"))).cast("long").alias("trailing_blanks"), (ends > 1).alias("mixed_line_ends"),
        F.when(F.size("lines") > 1, 1 - F.least(lit(1), A.cv(per_line))).otherwise(lit(0.5)).alias("line_uniformity"),
        A.ratio(F.greatest(one, two), one + two, 1.0).alias("spacing_uniformity"), ((one + two > 0) & ((one == 0) | (two == 0))).alias("spacing_consistent"),
    )

"""Scores of single sentences beside their neighbours, and trends of whole documents.

Every sentence becomes a row, but all that its score needs, its neighbours'
lengths included, is read from the document's own row first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions import sentence_lists as L
from inkstone.functions.arrays import lit
from inkstone.operators.authorship import segmented
from inkstone.operators.categories import _contained
from inkstone.operators.lexical import _jvm

LEAST_TOKENS = 50  # of a text whose sentences have a surprise of their own


def sentence_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``no`` from 1, ``sentence``, ``n_tokens``, six indicators between
    0 and 1, ``ai_probability`` and ``class`` (human, mixed or ai) of each sentence.

    A first or last sentence, and one without words between two without words,
    has the regularity 0.5. In a text of fewer than 50 words the surprise is 0.5;
    else it has a constant where its original draws at random.
    """
    d = segmented(docs, id_col, text_col)

    def parts(s: Column) -> Column:
        w = segment.tokens_web(s)
        return F.struct(
            s.alias("s"), w.alias("w"), F.regexp_count(s, F.lit("[,;:]")).alias("marks"), F.regexp_count(s, _jvm(L.PERSONAL)).alias("personal"),
            _contained(F.lower(s), L.DISCOURSE_MARKERS).alias("markers"), _contained(F.lower(s), L.SENTENCE_HEDGES).alias("hedges"),
        )

    d = d.select("doc_id", (F.size("tokens") >= LEAST_TOKENS).alias("long"), F.transform("sentences", parts).alias("p"))
    size = lambda x: F.size(x["w"])
    d = d.withColumn("k", F.transform("p", size))
    d = d.withColumn("k", F.transform("k", lambda n, i: F.struct(n.alias("n"), F.when(i > 0, F.get("k", i - 1)).alias("a"), F.get("k", i + 1).alias("b"))))
    d = d.withColumn("p", F.zip_with("p", "k", lambda x, k: F.struct(x["s"].alias("s"), k.alias("k"), F.size(F.array_distinct(x["w"])).alias("u"), F.aggregate(x["w"], F.lit(0), lambda a, t: a + F.length(t)).alias("letters"), x["marks"].alias("marks"), x["personal"].alias("personal"), x["markers"].alias("markers"), x["hedges"].alias("hedges"))))
    d = A.fenced(d.select("doc_id", "long", "p"))
    d = d.select("doc_id", "long", F.posexplode("p").alias("i", "p")).select("doc_id", "long", F.col("i") + 1, "p.*", "k.n", ((F.col("k.a") + F.col("k.b")) / 2).alias("beside")).withColumnRenamed("(i + 1)", "no")
    n, beside = F.col("n").cast("double"), F.col("beside")
    off = F.when(beside > 0, F.abs(n - beside) / beside).when(n > 0, lit(1))
    words = F.greatest(n, lit(1))
    surprise = S.clamp(F.col("u") / words * 30 + F.col("letters") / words * 2 + F.col("marks") / words * 20 + 2.5, 10, 100) / 100
    d = d.select(
        "doc_id", F.col("no").cast("long").alias("no"), F.col("s").alias("sentence"), F.col("n").cast("long").alias("n_tokens"),
        F.when(beside.isNull() | off.isNull(), lit(0.5)).otherwise(1 - F.least(lit(1), off)).alias("regularity"), F.when(n > 0, F.col("u") / n).otherwise(lit(0.5)).alias("diversity"),
        F.least(lit(1), F.col("markers") * 0.3).alias("markers"), F.when(F.col("long"), surprise).otherwise(lit(0.5)).alias("surprise"),
        F.least(lit(1), F.col("personal") * 0.2).alias("personal"), F.least(lit(1), F.col("hedges") * 0.25).alias("hedging"),
    )
    p = (1 - F.col("regularity")) * 0.15 + (1 - F.col("diversity")) * 0.15 + F.col("markers") * 0.25 + (1 - F.col("surprise")) * 0.15 + (1 - F.col("personal")) * 0.15 + F.col("hedging") * 0.15
    d = d.withColumn("ai_probability", F.round(p, 9))
    return d.withColumn("class", F.when(F.col("ai_probability") < 0.35, "human").when(F.col("ai_probability") > 0.6, "ai").otherwise("mixed"))


def document_trends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``rank``, ``kind`` (ai, human or neutral), ``trend`` and its ``value``:
    what stands out in a document's sentences, at most eight rows."""
    d = segmented(docs, id_col, text_col).filter(F.size("sentences") > 0).select("doc_id", "sentences", F.array_join("sentences", " ").alias("joined"))
    d = d.withColumns({"low": F.lower("joined"), "k": F.transform("sentences", segment.words_by_space)})
    d = d.withColumn("words", F.sort_array(F.regexp_extract_all("low", F.lit(f"[^{segment.SPACE}]+"), 0)))
    length = lambda w: F.length(w) + F.regexp_count(w, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    third = F.transform("words", lambda w, i: (w == F.get("words", i + 2)) & ((i == 0) | (F.get("words", i - 1) != w)) & (length(w) > 4))
    ends = lambda c: F.size(F.filter("sentences", lambda s: s.endswith(c))).cast("double")
    d = d.select(
        "doc_id", A.size(F.col("sentences")).alias("s"), A.ratio(A.std_pop(F.col("k")), A.mean(F.col("k"))).alias("cv"), A.size(segment.paragraphs(F.col("joined"))).alias("paragraphs"),
        A.size(F.filter(third, lambda x: x)).alias("repeated"), _contained(F.col("low"), L.STOCK_TRANSITIONS).cast("double").alias("phrases"),
        F.regexp_count("low", _jvm(L.FIRST_PERSON)).cast("double").alias("first"), F.size("words").alias("n"), F.regexp_count("low", F.lit("[a-z0-9_]+'[a-z0-9_]+")).cast("double").alias("contractions"),
        ends("?").alias("questions"), ends("!").alias("exclamations"),
    )
    c = {k: F.col(k) for k in d.columns}
    cv, s, first = F.round(c["cv"], 9), c["s"], c["first"] / c["n"]
    rules = [
        (cv < 0.3, "ai", "uniform sentence length", cv),
        (cv > 0.6, "human", "variable sentence length", cv),
        ((c["paragraphs"] == 1) & (s > 5), "neutral", "single paragraph", s),
        (c["repeated"] > 5, "ai", "repetitive vocabulary", c["repeated"]),
        (c["phrases"] >= 2, "ai", "formulaic transitions", c["phrases"]),
        (first > 0.02, "human", "personal voice", c["first"]),
        ((first < 0.005) & (s > 3), "ai", "impersonal tone", c["first"]),
        (c["contractions"] > 3, "human", "natural contractions", c["contractions"]),
        ((c["contractions"] == 0) & (s > 5), "ai", "no contractions", c["contractions"]),
        (c["questions"] > 0, "human", "rhetorical questions", c["questions"]),
        (c["exclamations"] > 0, "human", "expressive punctuation", c["exclamations"]),
    ]
    found = F.filter(F.array(*[F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(trend).alias("trend"), value.alias("value"))) for when, kind, trend, value in rules]), lambda x: x.isNotNull())
    d = A.fenced(d).select("doc_id", F.posexplode(found).alias("rank", "t"))
    return d.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "t.kind", "t.trend", "t.value")

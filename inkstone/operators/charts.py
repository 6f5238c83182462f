"""Data of a document's charts: the graph of words that stand together, the map of
repetition by place, and the histogram of sentence lengths. All within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import category_lists as C
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.functions.series import sorted_grams
from inkstone.operators.authorship import segmented

WINDOW, EDGES, NODES, LEAST_TOKENS = 3, 30, 15, 20
SEGMENTS, FULL = 20, 10
BINS = 10


def runs(sorted_structs: Column, key: list[str]) -> Column:
    """First and last index of each run of equal keys in a sorted array of structs."""
    same = F.zip_with(A.shifted(sorted_structs), sorted_structs, lambda y, x: y.isNull() | ~_all_equal(x, y, key))
    return F.filter(F.transform(same, lambda end, i: F.when(end, i)), lambda i: i.isNotNull())


def _all_equal(x: Column, y: Column, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & (x[k] == y[k])
    return out


def _graph(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, all ``edges`` (negative weight, first place, words a < b), and the ``top`` ones."""
    d = segmented(docs, id_col, text_col).filter(F.size("tokens") >= LEAST_TOKENS)
    d = d.select("doc_id", F.filter("tokens", lambda t: (F.length(t) > 3) & ~t.isin(*C.STOP_WORDS)).alias("c"))
    last = F.size("c") - WINDOW  # windows that begin before it
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    places = [(j, k) for j in range(WINDOW) for k in range(j + 1, WINDOW)]

    def pairs(i: Column) -> Column:
        out = []
        for t, (j, k) in enumerate(places):
            x, y = F.get("c", i + j), F.get("c", i + k)
            out.append(F.when(x != y, F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (i * len(places) + t).alias("i"))))
        return F.array(*out)

    d = d.withColumn("pairs", F.sort_array(F.filter(F.flatten(F.transform(starts, pairs)), lambda p: p.isNotNull())))
    d = d.withColumn("ends", runs(F.col("pairs"), ["a", "b"]))
    starts = F.concat(F.array(F.lit(-1)), "ends")
    edge = lambda e, s: F.when(e.isNotNull(), F.struct((s - e).alias("w"), F.get("pairs", s + 1)["i"].alias("first"), F.get("pairs", e)["a"].alias("a"), F.get("pairs", e)["b"].alias("b")))
    d = d.select("doc_id", F.filter(F.zip_with("ends", starts, edge), lambda x: x.isNotNull()).alias("edges"))
    d = d.withColumn("top", F.slice(F.sort_array("edges"), 1, EDGES))
    return d.withColumn("nodes", F.slice(F.array_distinct(F.flatten(F.transform("top", lambda e: F.array(e["a"], e["b"])))), 1, NODES))


def cooccurrence_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``rank``, ``word``, ``other``, ``weight``, ``drawn``: the 30 heaviest
    pairs of content words within a moving window of three, the earlier first
    where weights are equal; drawn are those between two of the graph's nodes.
    A window that reaches the last word isn't counted, nor is a word beside itself."""
    d = _graph(docs, id_col, text_col)
    d = A.fenced(d.select("doc_id", F.transform("top", lambda e: F.struct(e["a"].alias("word"), e["b"].alias("other"), (-e["w"]).cast("long").alias("weight"), (F.array_contains("nodes", e["a"]) & F.array_contains("nodes", e["b"])).alias("drawn"))).alias("e")))
    return d.select("doc_id", F.posexplode("e").alias("rank", "e")).select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "e.*")


def cooccurrence_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``rank``, ``word``, ``degree``: the first 15 words of the heaviest
    edges, and how many pairs of the whole text they are in."""
    d = _graph(docs, id_col, text_col)
    degree = lambda w: F.aggregate("edges", F.lit(0), lambda n, e: n - F.when((e["a"] == w) | (e["b"] == w), e["w"]).otherwise(0))
    d = A.fenced(d.select("doc_id", F.transform("nodes", lambda w: F.struct(w.alias("word"), degree(w).cast("long").alias("degree"))).alias("n")))
    return d.select("doc_id", F.posexplode("n").alias("rank", "n")).select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "n.*")


def repetition_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``segment``, ``repeats``, ``intensity``: for runs of two to five
    words and each twentieth of the text, how many runs begin there that the text repeats."""
    d = segmented(docs, id_col, text_col).select("doc_id", "tokens")
    sizes = (2, 3, 4, 5)
    for n in sizes:
        d = d.withColumn(f"g{n}", sorted_grams(F.col("tokens"), n))
    d = d.withColumns({f"s{n}": A.lagged_pairs(F.col(f"g{n}"), lambda x, y: x["g"] == y["g"]) for n in sizes})
    total = lambda n: F.greatest(F.size(f"g{n}"), F.lit(1))
    again = lambda n: F.filter(F.transform(f"g{n}", lambda x, k: F.when(F.coalesce(F.get(f"s{n}", k), F.lit(False)) | ((k > 0) & F.coalesce(F.get(f"s{n}", k - 1), F.lit(False))), F.floor(x["i"].cast("long") * SEGMENTS / total(n)))), lambda x: x.isNotNull())
    d = d.select("doc_id", *[again(n).alias(f"r{n}") for n in sizes])

    def row(n: int) -> Column:
        count = lambda s: A.times_in(F.col(f"r{n}"), s.cast("long")).cast("long")
        return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: F.struct(F.lit(n).alias("n"), s.alias("segment"), count(s).alias("repeats")))

    cells = F.flatten(F.array(*map(row, sizes)))
    d = A.fenced(d.select("doc_id", cells.alias("c"))).select("doc_id", F.inline("c"))
    return d.withColumn("intensity", F.least(lit(1), F.col("repeats") / lit(FULL)))


def length_histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """``doc_id``, ``bin`` from 0, ``low``, ``high``, ``centre`` (rounded) and ``n``: sentence
    lengths in words by bins of equal width, the longest in the last bin.
    Where all are equal, bins are one wide and all but the first and the last
    are empty; the last then counts the longest as well, as the first does."""
    d = segmented(docs, id_col, text_col).filter(F.size("sentences") > 0)
    d = d.select("doc_id", F.transform("sentences", lambda s: F.size(segment.tokens_web(s))).alias("k"))
    d = d.withColumns({"least": F.array_min("k"), "most": F.array_max("k")})
    low, span = F.col("least").cast("double"), (F.col("most") - F.col("least")).cast("double")
    width = F.when(span > 0, span / bins).otherwise(lit(1))
    # Half up, as the chart's labels are.
    label = lambda x: F.floor(x + 0.5).cast("long")

    def one(i: Column) -> Column:
        a, b = low + i * width, low + (i + 1) * width
        inside = F.size(F.filter("k", lambda x: (x >= a) & (x < b)))
        last = F.when(i == bins - 1, F.size(F.filter("k", lambda x: x == F.col("most")))).otherwise(0)
        return F.struct(i.alias("bin"), label(a).alias("low"), label(b).alias("high"), label((a + b) / 2).alias("centre"), (inside + last).cast("long").alias("n"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)
    return A.fenced(d.select("doc_id", cells.alias("c"))).select("doc_id", F.inline("c"))

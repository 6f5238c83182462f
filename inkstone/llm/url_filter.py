"""URL filters: host and path rules, and character language models for the rest.

Two variable-order Markov models of characters are learned, one from the URLs
that rules accept and one from those they reject. An undecided URL is judged by
the difference of its log-likelihoods by character, against a threshold that
is calibrated on decided URLs which the models haven't seen.

A model is a table with the exact counts of every context and of every context
with its next character, so it grows with the URLs and is never brought to one machine.
URLs are scored by batches: a batch asks the table for its distinct contexts, and the
answers meet its URLs in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkstone.llm.scratch import Scratch
from inkstone.llm.wordhash import column_bytes, slices

#: Production rules: verdict and host with path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 5  # bytes of the longest context; with the next one they fit a long
BINS = 512
WIDTH = 8.0  # differences beyond it count with the last bins


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_rules(pages: DataFrame, url_col: str, rules=RULES) -> DataFrame:
    """``pages`` (``id``, url) with ``host``, ``path``, ``rule`` and the rule's verdict."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(host) + 1, F.greatest(F.length(rest), F.lit(1)))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    out = pages.withColumn("host", _lower(host)).withColumn("path", path)
    none = F.lit(None).cast("string")
    rule, verdict = F.when(F.lit(False), none), F.when(F.lit(False), none)
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r)):
        h, p = text.split("/", 1)
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = rule.when(fits, text), verdict.when(fits, what)
    return out.withColumn("rule", rule).withColumn("by_rule", verdict)


def _strings(hosts: pa.Array, paths: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of host and path, after ORDER spaces and before one, by parts of bounded size."""
    joined = pa.array([" " * ORDER + h + p + " " for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.large_string())
    data, offs = column_bytes(joined)
    for a, b in slices(offs):
        yield data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Places of the bytes to predict, and for each context length from 0 the
    exact codes of their contexts, alone and with the byte: length and bytes in a long."""
    skip = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    at = np.flatnonzero(skip >= ORDER)

    def each():
        context = np.zeros(len(at), dtype=np.int64)
        for k in range(ORDER + 1):
            if k:
                context |= data[at - k].astype(np.int64) << (8 * k)
            yield context | (2 * k) << 48, context | data[at] | (2 * k + 1) << 48

    return at, each()


def _counted(batches):
    """Codes in the URLs of each batch, with the numbers of accepted and of rejected URLs' characters."""
    for b in batches:
        allowed = b.column(2).to_pylist()
        found = []
        for what in ("allow", "block"):
            own = b.filter(pa.array([x == what for x in allowed], pa.bool_()))
            codes = [c for data, offs in _strings(own.column(0), own.column(1)) for pair in _codes(data, offs)[1] for c in pair]
            found.append(np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, dtype=np.int64),) * 2)
        every = np.union1d(found[0][0], found[1][0])
        n = np.zeros((2, len(every)), dtype=np.int64)
        for row, (codes, counts) in zip(n, found):
            row[np.searchsorted(every, codes)] = counts
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(n[0]), pa.array(n[1])], names=["code", "allow", "block"])


def _differences(code: np.ndarray, counts: np.ndarray, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """Log-likelihood of each URL by the accepted less by the rejected model, by
    character; longer contexts are smoothed by shorter ones. ``code`` is sorted
    and has those of the URLs that the models know, ``counts`` two rows."""

    def known(wanted):
        at = np.minimum(np.searchsorted(code, wanted), max(len(code) - 1, 0))
        return np.where(code[at] == wanted, counts[:, at], 0) if len(code) else np.zeros((2, len(wanted)), dtype=np.int64)

    out = [np.zeros(0)]
    for data, offs in _strings(hosts, paths):
        at, lengths = _codes(data, offs)
        p = np.full((2, len(at)), 1 / 256)
        for k, (context, pair) in enumerate(lengths):
            p = (known(pair) + (1.0 + k) * p) / (known(context) + (1.0 + k))
        d = np.log(p[0]) - np.log(p[1])
        first = np.searchsorted(at, offs[:-1])
        out.append(np.add.reduceat(d, first) / np.diff(np.append(first, len(at))))
    return np.concatenate(out)


def _scored(ruled: DataFrame, model: DataFrame, scratch: Scratch) -> DataFrame:
    """``ruled`` with ``difference``. Batches and the distinct codes they ask for
    are written once, so that both sides agree on them."""
    columns = ruled.columns
    types = [to_arrow_type(f.dataType) for f in ruled.schema]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ruled.schema)
    names = ["batch", "code", *columns]

    def deal(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, n)), pa.nulls(b.num_rows, pa.int64()), *b.columns], names=names)
            codes = [c for data, offs in _strings(b.column(1), b.column(2)) for pair in _codes(data, offs)[1] for c in pair]
            codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), n)), pa.array(codes), *[pa.nulls(len(codes), t) for t in types]], names=names)
            n += 1

    dealt = scratch.keep(ruled.mapInArrow(deal, f"batch long, code long, {kinds}"))
    asked = dealt.filter("code is not null").select(F.col("batch").alias("of"), "code").join(model, "code")

    def score(urls: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("code").to_numpy())
        code = answers.column("code").to_numpy()[order]
        counts = np.stack([answers.column(c).to_numpy()[order] for c in ("allow", "block")])
        urls = urls.select(columns)
        return urls.append_column("difference", pa.array(_differences(code, counts, urls.column("host").combine_chunks(), urls.column("path").combine_chunks())))

    urls = dealt.filter("code is null").drop("code")
    return scratch.keep(urls.groupBy("batch").cogroup(asked.groupBy("of")).applyInArrow(score, f"{kinds}, difference double"))


def _threshold(scored: DataFrame) -> float:
    """The difference that best separates decided URLs, both classes weighing the same."""
    place = F.least(F.greatest(F.floor((F.col("difference") + WIDTH) / (2 * WIDTH) * BINS), F.lit(0)), F.lit(BINS - 1))
    total = np.zeros((2, BINS))
    for r in scored.groupBy("by_rule", place.alias("place")).count().collect():  # 2 * BINS rows at most
        total[int(r["by_rule"] == "block"), r["place"]] = r["count"]
    if not total.sum(1).all():
        return 0.0
    share = total.cumsum(1) / total.sum(1, keepdims=True)
    wrong = share[0] + 1 - share[1]  # accepted below a bin's end, rejected above it
    best = np.flatnonzero(wrong[:-1] <= wrong[:-1].min() + 1e-12)
    return float((best[len(best) // 2] + 1) * 2 * WIDTH / BINS - WIDTH)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``difference`` by row.

    A null url, or one without ``://``, has an empty host and path. A rule fits
    its host and all subdomains if the path starts with the rule's; the longest
    wins and its verdict holds. Other URLs are blocked if their difference lies
    below the threshold. Where rules decide URLs of one kind only, or none, the
    models can't judge and other URLs are allowed. Four fifths of the decided URLs
    (by a hash) train the models, the others calibrate the threshold. Null and
    repeated ids stay as they are; other columns aren't read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    ruled = with_rules(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url", rules).select(F.col("_id").alias("id"), "host", "path", "rule", "by_rule")
    aside = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    decided = ruled.filter("by_rule is not null")
    counts = decided.filter(~aside).select("host", "path", "by_rule").mapInArrow(_counted, "code long, allow long, block long")
    model = scratch.keep(counts.groupBy("code").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    seen = model.filter("code = 0").first()  # the empty context
    if seen and seen["allow"] and seen["block"]:
        out = _scored(ruled, model, scratch)
        edge = _threshold(out.filter(F.col("by_rule").isNotNull() & aside))
        by_model = F.when(F.col("difference") < edge, "block").otherwise("allow")
    else:
        out = ruled.withColumn("difference", F.lit(0.0))
        by_model = F.lit("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "difference")

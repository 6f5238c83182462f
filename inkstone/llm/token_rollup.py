"""Token totals by source, language and tokenizer version, kept up by deltas.

Changes carry a document's count before and after: an insert has no before, a
delete no after, a revision both. A batch adds up the signed differences and
commits them under its own name, at once or not at all: the folder of a batch
counts only once its success marker is there, and a batch that is committed
again changes nothing. Totals are the sum over committed batches; old batches can be
merged into one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch
from inkstone.llm.wordhash import NOT_SPACE, column_bytes, slices, words

TOKENIZERS = "/opt/tokenizers"
#: Version names, and the rank file of each byte-level BPE; None counts words.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "words": None}
KEYS = ("source", "lang", "version")
#: The pre-tokenization pattern that the public rank files are made for (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern sees it, in runs that its backtracking can't hold.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def count_pieces(encode, encode_whole, text: str) -> int:
    """Tokens of a text of any length.

    The pattern takes a run of white space as one piece but for its last
    character, which it leaves to what follows; so long runs can be cut out and
    encoded by themselves without changing any token."""
    total, at = 0, 0
    for m in _GAP.finditer(text):
        start, end = m.span()
        end -= end < len(text)
        total += len(encode(text[at:start])) + len(encode_whole(text[start:end]))
        at = end
    return total + len(encode(text[at:]))


def load_ranks(path: str) -> dict[bytes, int]:
    """A public vocabulary's ranks; its size is fixed, so it may be broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, versions: Mapping[str, str | None] = VERSIONS, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id``, ``source``, ``lang``, ``version``, ``estimate``, ``tokens`` for each
    row and version; the estimate is a quarter of the bytes. A null text has none."""
    sc = docs.sparkSession.sparkContext
    ranks = sc.broadcast({v: load_ranks(f"{folder}/{f}") for v, f in versions.items() if f})
    order = list(versions)
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, source_col, lang_col)]
    pattern = PATTERN

    def run(batches):
        import tiktoken

        codec = lambda v, p, r: tiktoken.Encoding(v, pat_str=p, mergeable_ranks=r, special_tokens={}).encode_ordinary
        codecs = {v: (codec(v, pattern, r), codec(v, r"[\s\S]+", r)) for v, r in ranks.value.items()}
        for b in batches:
            data, offs = column_bytes(b.column(3))
            size = np.diff(offs)
            for v in order:
                if v in codecs:
                    n = [count_pieces(*codecs[v], t) if t else 0 for t in b.column(3).to_pylist()]
                else:
                    n = [k for a, z in slices(offs) for k in np.diff(words(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], NOT_SPACE)[3]).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array([v] * b.num_rows, pa.string()), pa.array(-(-size // 4), pa.int64()), pa.array(n, pa.int64())],
                    names=["id", "source", "lang", "version", "estimate", "tokens"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kinds[0]}, source {kinds[1]}, lang {kinds[2]}, version string, estimate long, tokens long")


class TokenRollup:
    """Totals in a folder that all machines share.

    Changes have ``source``, ``lang``, ``version`` and the longs ``before`` and
    ``after`` (null where there is none). Nulls in the keys are keys like others.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self) -> list[str]:
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and self._exists(f"{self.folder}/{s.getPath().getName()}/_SUCCESS"))

    def _merged(self, names: list[str]) -> dict[str, list[str]]:
        """Batches that each merged table stands for."""
        out = {}
        for n in names:
            if n.startswith("merged-"):
                rows = self.spark.read.parquet(f"{self.folder}/{n}").filter("batch is not null").select("batch").collect()
                out[n] = [r["batch"] for r in rows]  # a row by batch name
        return out

    def committed(self) -> set[str]:
        names = self._names()
        return {n.removeprefix("batch-") for n in names if n.startswith("batch-")} | {b for bs in self._merged(names).values() for b in bs}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the changes under the batch's name; False if that is committed
        already. A batch that broke off before its marker is written anew."""
        if batch in self.committed():
            return False
        one = F.col("after").isNotNull().cast("long") - F.col("before").isNotNull().cast("long")
        by = changes.groupBy(*KEYS).agg(F.sum(one).alias("docs"), F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).cast("long").alias("tokens"))
        by.withColumn("batch", F.lit(None).cast("string")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def _live(self) -> list[str]:
        names = self._names()
        merged = self._merged(names)
        gone = {f"batch-{b}" for bs in merged.values() for b in bs} | {n for n in merged if any(n != m and set(merged[n]) < set(bs) for m, bs in merged.items())}
        return [n for n in names if n not in gone]

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``version``, ``n_docs``, ``n_tokens``, without groups that are gone."""
        paths = [f"{self.folder}/{n}" for n in self._live()]
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs long, n_tokens long")
        rows = self.spark.read.parquet(*paths).filter("batch is null")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def merge(self, name: str) -> None:
        """One table in place of all committed batches, which it names."""
        live, done = self._live(), self.committed()
        if not live:
            return
        rows = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in live]).filter("batch is null")
        rows = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).withColumn("batch", F.lit(None).cast("string"))
        named = self.spark.createDataFrame([(b,) for b in sorted(done)], "batch string")
        rows.unionByName(named, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.folder}/merged-{name}")
        for n in live:
            fs, p = self._fs(f"{self.folder}/{n}")
            fs.delete(p, True)


def rollup_documents(docs: DataFrame, versions: Mapping[str, str | None] = VERSIONS, folder: str = TOKENIZERS, loads: int = 4) -> DataFrame:
    """``source``, ``lang``, ``version``, ``n_docs``, ``n_tokens`` over all documents.

    Documents arrive in ``loads`` batches with estimated counts, which further
    batches revise to the tokenizers' counts. A batch then deletes documents
    without any token, and one is committed again, which changes nothing. Null
    and empty texts thus don't count; null sources and languages are groups of their own;
    repeated rows count each. An empty table has no groups.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    counts = scratch.keep(count_tokens(docs, versions, folder))
    rollup = TokenRollup(spark, f"{scratch.root}/rollup")
    load = F.pmod(F.xxhash64("id"), F.lit(loads))
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, before, after) -> DataFrame:
        return rows.select(*KEYS, before.alias("before"), after.alias("after"))

    for k in range(loads):
        rollup.commit(f"load-{k}", changes(counts.filter(load == k), none, F.col("estimate")))
    for k in range(loads):
        rollup.commit(f"revise-{k}", changes(counts.filter(load == k), F.col("estimate"), F.col("tokens")))
    rollup.commit("empty", changes(counts.filter("tokens = 0"), F.col("tokens"), none))
    rollup.commit("revise-0", changes(counts.filter(load == 0), F.col("estimate"), F.col("tokens")))
    rollup.merge("all")
    return rollup.totals()

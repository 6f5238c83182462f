"""Language identification in two steps: family, then language within it.

Texts are byte trigrams, hashed and normalised by their number, so a linear
model's margin is a mean of weights over the whole text. Families are told
apart first; within the family found, one-versus-one linear support vector
machines separate each pair of its languages, and the language with most
votes wins (the larger sum of margins, where votes are equal). Executors fit the
machines, one in a task, on a bounded sample; the driver gets their weights only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch, bounded_batches
from inkstone.llm.wordhash import LOWER, column_bytes, slices

BUCKETS = 4096
#: Languages by family; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
}
_FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family_of(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].lower(), language)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram (rows end with two spaces), and the first by row."""
    n = np.diff(offsets)
    total = len(data) + 3 * (len(n))
    b = np.full(total, 32, dtype=np.uint32)
    first = offsets[:-1] + 3 * np.arange(len(n))
    b[np.arange(len(data)) + np.repeat(first + 1 - offsets[:-1], n)] = LOWER[data]
    x = np.zeros(total, dtype=np.uint32)
    x[:-2] = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), np.append(first, total)


def _features(texts: list[bytes]) -> np.ndarray:
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    h, first = trigrams(np.frombuffer(b"".join(texts), dtype=np.uint8), offs)
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i in range(len(texts)):
        out[i] = np.bincount(h[first[i] : first[i + 1]], minlength=BUCKETS)
        out[i] /= max(1, first[i + 1] - first[i])
    return out


def _pieces(texts: list[bytes]) -> list[bytes]:
    """A short piece of each text, so that short texts are known as well."""
    return [t[len(t) // 3 : len(t) // 3 + 80] for t in texts]


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated
    gradient descent; classes weigh the same, and frequent trigrams less."""
    scale = (1 / (np.sqrt(x.mean(0)) + 1e-3)).astype(np.float32)
    x = np.concatenate((x * scale, np.ones((len(x), 1), dtype=np.float32)), axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = z = np.zeros(x.shape[1], dtype=np.float32)
    v = np.random.default_rng(3).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        size = np.linalg.norm(v)
        v /= size
    step, t = 1 / (2 * size * 1.1 + penalty), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (penalty * z - 2 * (x.T @ (weight * y * slack)))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (was - 1) / t * (new - w)
        w = new
    return np.append(w[:-1] * scale, w[-1]).astype(np.float64)


def machines_of(languages: list[str]) -> list[tuple[str, str]]:
    """The pairs to tell apart: of families (their names after a null byte), and of each family's languages."""
    families = sorted({family_of(x) for x in languages})
    out = [("\0" + a, "\0" + b) for a, b in combinations(families, 2)]
    for f in families:
        out += combinations(sorted(x for x in languages if family_of(x) == f), 2)
    return out


class LanguageModel:
    """``machines``: (class, other class) with a column of ``weights`` each;
    positive margins speak for the former."""

    def __init__(self, languages: list[str], weights: list[np.ndarray]):
        self.languages = sorted(languages)
        self.families = sorted({family_of(x) for x in self.languages})
        self.members = {f: [x for x in self.languages if family_of(x) == f] for f in self.families}
        self.machines = machines_of(self.languages)
        self.weights = np.stack(weights, 1) if weights else np.zeros((BUCKETS + 1, 0))

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, first = trigrams(data, offsets)
        n = np.diff(first)
        out = np.empty((len(n), len(self.machines)))
        for k in range(len(self.machines)):
            out[:, k] = np.add.reduceat(self.weights[:-1, k][h], first[:-1]) / n + self.weights[-1, k]
        return out

    def _choose(self, names: list[str], row: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0].lstrip("\0"), 1.0
        votes = {x: [0, 0.0] for x in names}
        for k, (a, b) in enumerate(self.machines):
            if a in votes and b in votes:
                votes[a if row[k] >= 0 else b][0] += 1
                votes[a][1] += row[k]
                votes[b][1] -= row[k]
        best = max(names, key=lambda x: (votes[x][0], votes[x][1]))
        least = min(abs(row[k]) if best in (a, b) else np.inf for k, (a, b) in enumerate(self.machines) if a in votes)
        return best.lstrip("\0"), float(1 / (1 + np.exp(-3 * min(least, 10))))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, float]]:
        """Language and a score from 0 to 1 by row; ``und`` and 0 without a letter."""
        if not self.languages:
            return [("und", 0.0)] * (len(offsets) - 1)
        out = []
        for a, b in slices(offsets):
            part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            letters = np.concatenate(([0], np.cumsum(_LETTER[part])))
            some = letters[offs[1:]] > letters[offs[:-1]]
            rows = self.margins(part, offs)
            for i in range(b - a):
                if not some[i] and not any(c.isalpha() for c in part[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")):
                    out.append(("und", 0.0))
                    continue
                kin, p = self._choose(["\0" + f for f in self.families], rows[i])
                name, q = self._choose(self.members[kin], rows[i])
                out.append((name, p * q))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400) -> LanguageModel:
    """Fits on at most ``per_language`` rows of each language, of texts of any
    length, drawn by a hash of id and text among the ids whose crc32 (of the
    decimal text) isn't 2 modulo 4. Executors turn the texts into features."""
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    known = known.filter("i is not null and t is not null and l is not null and pmod(crc32(cast(i as string)), 4) <> 2")
    known = known.select("i", "l", F.xxhash64(F.lit("language"), "i", "t").alias("k"))
    levels = known.groupBy("l").agg(F.count("*").alias("n")).collect()  # a row for each language
    rows = []
    for r in levels:  # the smallest hashes, by a threshold that leaves few more than wanted
        some = known.filter(F.col("l") == r["l"])
        rows += [(x["i"], x["l"], x["k"]) for x in some.orderBy("k", "i").limit(per_language).collect()]
    wanted = docs.sparkSession.createDataFrame(rows, f"i {docs.schema[id_col].dataType.simpleString()}, l string, k long")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    texts = texts.join(F.broadcast(wanted), "i").filter(F.xxhash64(F.lit("language"), "i", "t") == F.col("k")).dropDuplicates(["i", "k", "l"])

    def featured(batches):
        """Of each text and of a piece of it the trigrams that it has, and their shares."""
        for b in batches:
            t = [x.encode() for x in b.column(2).to_pylist()]
            for part, those in enumerate((t, _pieces(t))):
                x = _features(those)
                at = [np.flatnonzero(v).astype(np.int16) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.full(len(t), part, dtype=np.int32)), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].tobytes() for v, i in zip(x, at)], pa.binary())],
                    names=["l", "k", "part", "at", "share"],
                )

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("l", "ascending"), ("k", "ascending"), ("part", "ascending")])
        x = np.zeros((table.num_rows, BUCKETS), dtype=np.float32)
        for row, at, share in zip(x, table.column("at").to_pylist(), table.column("share").to_pylist()):
            row[np.frombuffer(at, dtype=np.int16)] = np.frombuffer(share, dtype=np.float32)
        w = _svm(x, table.column("y").to_numpy().astype(np.float32))
        return pa.table({"machine": table.column("machine").slice(0, 1), "weights": pa.array([w.tobytes()], pa.binary())})

    rows = Scratch(docs.sparkSession, "language").keep(texts.select("l", "k", "t").mapInArrow(featured, "l string, k long, part int, at binary, share binary"))
    languages = sorted(r["l"] for r in rows.select("l").distinct().collect())
    sides = []
    for machine, pair in enumerate(machines_of(languages)):
        for name, y in zip(pair, (1, -1)):
            sides += [(x, machine, y) for x in languages if name in (x, "\0" + family_of(x))]
    if not sides:
        return LanguageModel(languages, [])
    sides = docs.sparkSession.createDataFrame(sides, "l string, machine int, y int")
    fits = rows.join(F.broadcast(sides), "l").groupBy("machine").applyInArrow(fitted, "machine int, weights binary").collect()
    return LanguageModel(languages, [np.frombuffer(r["weights"]) for r in sorted(fits, key=lambda r: r["machine"])])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score`` for each row.

    ``und`` with score 0 where the text is null or has no letter, or no language
    was learned. A null id isn't held out. Repeated rows get equal
    predictions; other columns, the language's included, aren't read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.predict(*column_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    held = F.coalesce(F.expr(f"pmod(crc32(cast(`{id_col}` as string)), 4) = 2"), F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held.alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: LanguageModel, languages: tuple[str, ...] | None = None, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, as they are, in one of ``languages`` (all that were
    learned, if None) with a score of at least ``least``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = shared.value.predict(*column_bytes(batch.column(place)))
            yield batch.filter(pa.array([x != "und" and s >= least and (languages is None or x in languages) for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

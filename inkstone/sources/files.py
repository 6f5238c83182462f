"""Texts from files: plain text, Markdown, subtitles and word-processor files."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.segment import trim

#: Media types by extension (fixed values).
TYPES = {
    "txt": "text/plain", "md": "text/markdown", "vtt": "text/vtt", "srt": "application/x-subrip", "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_SRT_TIME = rf"^{_CLOCK},\d{{3}}\s*-->\s*{_CLOCK},\d{{3}}"
_VTT_TIME = rf"^{_CLOCK}[.,]\d{{3}}\s*-->\s*{_CLOCK}[.,]\d{{3}}|^\d{{2}}:\d{{2}}\.\d{{3}}\s*-->\s*\d{{2}}:\d{{2}}\.\d{{3}}"
_VTT_TAGS = r"<v\s+[^>]+>|</v>|<c\.[^>]+>|</c>|</?[biu]>|</?ruby>|</?rt>|<lang[^>]*>|</lang>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    """By the extension; plain text for any other."""
    out = F.when(F.lit(False), "")
    for e, t in TYPES.items():
        out = out.when(extension(path) == e, t)
    return out.otherwise("text/plain")


def clean(c: Column, keep_format: bool = False) -> Column:
    """Line ends, NULs, and (unless formats are kept) runs of blanks and empty lines."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\x00", "")
    if not keep_format:
        c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trim(c)


def _unescape(c: Column) -> Column:
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return trim(c)


def _cues(content: Column, time: str) -> Column:
    return F.size(F.filter(F.split(content, "\n"), lambda x: trim(x).rlike(time))).cast("long")


def srt_text(content: Column) -> tuple[Column, Column]:
    """Text and number of cues of SubRip content. Lines count from a time line
    to the next empty line."""
    lines = F.transform(F.split(content, "\n"), trim)
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        time, number = x.rlike(_SRT_TIME), x.rlike(r"^\d+$")
        on = F.when(x == "", False).when(time, True).otherwise(a["on"])
        take = a["on"] & (x != "") & ~time & ~number
        return F.struct(on.alias("on"), F.when(take, F.array_append(a["out"], x)).otherwise(a["out"]).alias("out"))

    kept = F.aggregate(lines, start, step, lambda a: a["out"])
    pieces = F.transform(kept, lambda x: _unescape(F.regexp_replace(x, r"<[^>]+>|\{[^}]+\}", "")))
    return F.array_join(F.filter(pieces, lambda x: x != ""), " "), _cues(content, _SRT_TIME)


def vtt_text(content: Column) -> tuple[Column, Column]:
    """Text and number of cues of WebVTT content. Any line but the first counts
    that isn't a header, note, time, number or setting."""
    lines = F.transform(F.split(content, "\n"), lambda x, i: F.struct(trim(x).alias("x"), i.alias("i")))

    def is_text(line):
        x = line["x"]
        skip = (x == "") | (x == "WEBVTT") | x.startswith("NOTE") | x.startswith("STYLE") | x.rlike(r"(?i)^(?:kind|language|region|style|note|webvtt)\s*:")
        skip = skip | x.rlike(_VTT_TIME) | x.rlike(r"^\d+$") | x.contains("-->") | x.rlike("^(?:align|position|line|size):")
        return ~skip & (line["i"] > 0)

    pieces = F.transform(F.filter(lines, is_text), lambda line: _unescape(F.regexp_replace(line["x"], _VTT_TAGS, "")))
    return F.array_join(F.filter(pieces, lambda x: x != ""), " "), _cues(content, _VTT_TIME)


def _docx(data: bytes) -> tuple[str | None, dict[str, str]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
            core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else ""
    except (zipfile.BadZipFile, KeyError):
        return None, {}
    paragraphs = []
    for p in re.finditer(r"<w:p(?:\s[^>]*)?>.*?</w:p>", xml, re.S):
        text = "".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p[0])).replace("\t", " ").strip()
        if text:
            paragraphs.append(("- " if "<w:numPr>" in p[0] or "<w:ilvl" in p[0] else "") + text)
    facts = re.findall(r"<(?:dc|cp|dcterms):(creator|created|modified|title|subject|lastModifiedBy)\b[^>]*>([^<]*)<", core)
    return "\n\n".join(paragraphs), dict(facts)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``type``, ``size``, ``modified``, ``text``, ``cues``, ``facts`` of each file below a path.

    Subtitles and word-processor files give their text; a file of a type
    that can't be read (or is broken) has a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", media_type(F.col("path")).alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    is_docx = F.col("type") == TYPES["docx"]

    def read(batches):
        for b in batches:
            found = [_docx(x) for x in b.column(4).to_pylist()]
            facts = pa.array([list(f.items()) for _, f in found], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([t for t, _ in found], pa.string()), facts], names=["path", "type", "size", "modified", "text", "facts"])

    docx = files.filter(is_docx).mapInArrow(read, "path string, type string, size long, modified timestamp, text string, facts map<string,string>")
    plain = files.filter(~is_docx & ~F.col("type").isin(TYPES["pdf"], TYPES["doc"])).withColumn("raw", F.decode("content", "UTF-8"))
    none = F.lit(None)
    (srt, srt_n), (vtt, vtt_n) = srt_text(F.col("raw")), vtt_text(F.col("raw"))
    is_srt, is_vtt = F.col("type") == TYPES["srt"], F.col("type") == TYPES["vtt"]
    plain = plain.withColumns({"text": F.when(is_srt, srt).when(is_vtt, vtt).otherwise(F.col("raw")), "cues": F.when(is_srt, srt_n).when(is_vtt, vtt_n), "facts": none.cast("map<string,string>")})
    others = files.filter(F.col("type").isin(TYPES["pdf"], TYPES["doc"])).withColumns({"text": none.cast("string"), "cues": none.cast("long"), "facts": none.cast("map<string,string>")})
    out = plain.drop("raw", "content").unionByName(docx, allowMissingColumns=True).unionByName(others.drop("content"))
    return out.select("path", "type", "size", "modified", clean(F.col("text")).alias("text"), "cues", "facts")


def pasted_from(html: Column) -> Column:
    """Which program a pasted fragment comes from."""
    has = lambda *xs: F.greatest(*[F.contains(html, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(html, F.lit(xs[0]))
    return F.when(has("docs-internal-guid", "google-docs"), "google-docs").when(has("MsoNormal", "Microsoft"), "microsoft-office").when(has("notion"), "notion").otherwise("unknown")


def hidden_formatting(html: Column) -> Column:
    """Names of what a fragment hides."""
    return F.array_compact(
        F.array(
            F.when(F.contains(html, F.lit("&nbsp;")), "non-breaking-spaces"),
            F.when(html.rlike(r"""(?i)style\s*=\s*["'][^"']*font"""), "inline-font-styles"),
            F.when(F.contains(html, F.lit("<!--")), "html-comments"),
            F.when(html.rlike(r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"), "zero-width-characters"),
        )
    )


def shared_document_id(url: Column) -> Column:
    """The id in the address of a shared online document; null without one."""
    return F.nullif(F.regexp_extract(url, r"/document/d/([a-zA-Z0-9_-]+)", 1), F.lit(""))

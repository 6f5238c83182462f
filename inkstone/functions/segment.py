"""Tokens, sentences and paragraphs, by six conventions that differ.

A column built on one of them should say which: ``web``, ``letters`` and ``flat``, ``ext``, ``v1``,
``v2``, ``v1_long`` or ``bench``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import arrays as A

#: White space and line ends of the scripting language whose rules these follow (fixed values).
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same for the JVM, inside of brackets: one look at the whole range tells most signs apart, in place of one for each part.
SPACE = r"\t\n\x0B\f\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
#: The same, one by one.
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Abbreviations that end no sentence (fixed values).
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "vs.", "etc.", "e.g.", "i.e.", "U.S.", "U.K.")
#: Word endings that end no sentence in the v1 conventions (fixed values).
ABBREVIATIONS_V1 = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|inc|ltd"
#: A word boundary by ASCII words only; the JVM's own also counts other letters.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_MASK = "\u0001"


def trim(c: Column) -> Column:
    """Looks at the ends only; a pattern for them would be tried at every place."""
    return F.btrim(c, F.lit(WS_CHARS))


def not_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def words_by_space(c: Column) -> Column:
    """Number of pieces between white space of a trimmed text."""
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def tokens_web(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_'-]+"), 0)


def ascii_words(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores in lower case. The two letters whose lower case is ASCII, or
    holds it, are edges."""
    return F.regexp_extract_all(F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("\u0001")), F.lit("\u212a"), F.lit("\u0001"))), F.lit("[a-z0-9_]+"), 0)


def tokens_letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{EDGE}[a-z]+{EDGE}"), 0)


def tokens_ext(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{EDGE}[a-z'-]+{EDGE}"), 0)


def tokens_v1(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z'-]+"), 0)


def sentences_web(text: Column) -> Column:
    """Split after ``.!?`` and white space before a capital. An abbreviation is
    masked as a whole, so no sentence ends after it nor begins with it."""
    masked = text
    for i, a in enumerate(ABBREVIATIONS):
        masked = F.replace(masked, F.lit(a), F.lit(f"{_MASK}{chr(97 + i)}{_MASK}"))
    pieces = F.split(masked, rf"(?<=[.!?])[{SPACE}]+(?=[A-Z])")

    def restore(s: Column) -> Column:
        whole = s
        for i, a in enumerate(ABBREVIATIONS):
            whole = F.replace(whole, F.lit(f"{_MASK}{chr(97 + i)}{_MASK}"), F.lit(a))
        return trim(F.when(F.contains(s, F.lit(_MASK)), whole).otherwise(s))

    return not_empty(F.transform(pieces, restore))


def sentences_flat(text: Column) -> Column:
    flat = trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.filter(F.split(flat, rf"(?<=[.!?])[{SPACE}]+"), lambda s: F.length(trim(s)) > 5)


def sentences_ext(text: Column) -> Column:
    return F.filter(F.split(text, rf"[.!?]+[{SPACE}]+"), lambda s: trim(s) != "")


def pieces_v1(text: Column) -> Column:
    """Sentences of the v1 conventions, of any number of words."""
    masked = F.regexp_replace(text, rf"(?i)[.](?<=(?:{ABBREVIATIONS_V1})[.])", _MASK)
    return F.transform(F.split(masked, rf"[.!?]+[{SPACE}]+"), lambda s: trim(F.replace(s, F.lit(_MASK), F.lit("."))))


def _sentences_v1(text: Column, least: int) -> Column:
    return F.filter(pieces_v1(text), lambda s: words_by_space(s) >= least)


def sentences_v1(text: Column) -> Column:
    """Terminators are lost; sentences of one word are left out."""
    return _sentences_v1(text, 2)


def sentences_v1_long(text: Column) -> Column:
    return _sentences_v1(text, 3)


def sentences_v2(text: Column) -> Column:
    return not_empty(F.transform(F.split(text, rf"[.!?]+[{SPACE}]+|[.!?]+$"), trim))


def sentences_bench(text: Column) -> Column:
    """Split after a terminator and white space, and at bars."""
    return F.filter(F.split(text, rf"(?<=[.!?])[{SPACE}]+|[|]"), lambda s: F.length(trim(s)) > 5)


def paragraphs(text: Column) -> Column:
    """Split at blank lines; blank ones are left out."""
    return F.filter(F.split(text, rf"\n[{SPACE}]*\n"), lambda p: trim(p) != "")


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word, less a silent final e; 1 at least."""
    def of(x: Column) -> Column:
        less = lambda groups: F.greatest(F.lit(1), groups - F.when(x.endswith("e") & (groups > 1), 1).otherwise(0))
        return F.when(F.length(x) <= 3, 1).otherwise(A.let(F.regexp_count(x, F.lit("[aeiouy]+")), less))

    return A.let(F.regexp_replace(word, "[^a-z]", ""), of)


def syllables_ext(word: Column) -> Column:
    """The variant that strips endings first."""
    short = F.regexp_replace(F.regexp_replace(F.lower(word), "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(short, F.lit("[aeiouy]{1,2}"))))


def syllables_v1(word: Column) -> Column:
    """Vowel groups, less a final e, more for a consonant with ``le``; 1 at least."""
    def of(w: Column) -> Column:
        n = F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0) + F.when(w.endswith("le") & w.rlike("[^aeiouy]le$"), 1).otherwise(0)
        return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), n))

    return A.let(F.lower(word), of)

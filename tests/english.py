"""A table of English-like texts that hold every word, phrase and pattern of the lists."""

import random
import re
import re._constants as K
import re._parser as parser

from inkstone.functions import artifact_lists, category_lists, lexicons, sentence_lists, signal_lists, speech_lists, style_lists, voice_lists

MODULES = (lexicons, category_lists, style_lists, voice_lists, artifact_lists, speech_lists, sentence_lists, signal_lists)
PLAIN = re.compile(r"[A-Za-z0-9 ,;:'.!?\u2019-]+")


def entries():
    """All strings of the lists, and what matches their patterns."""
    out, seen = [], set()

    def walk(x):
        if isinstance(x, str):
            if x and x not in seen:
                seen.add(x)
                out.append(x)
        elif isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, (list, tuple, dict, str)):
                    walk(v)
                if isinstance(v, list) and isinstance(k, str) and k.islower():
                    walk(k)
        elif isinstance(x, (list, tuple, set, frozenset)):
            for v in x:
                walk(v)

    for m in MODULES:
        for name, value in sorted(vars(m).items()):
            if name.isupper():
                walk(value)
    return out


def matching(pattern, r):
    """A string that a pattern matches (as far as look-arounds allow)."""
    pattern = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)

    def make(tree):
        return "".join(map(one, tree))

    def chosen(items):
        if items[0][0] is K.NEGATE:
            banned = {chr(v) for op, v in items if op is K.LITERAL}
            return next(c for c in "abcdefgh" if c not in banned)
        op, v = r.choice(items)
        if op is K.LITERAL:
            return chr(v)
        if op is K.RANGE:
            return chr(r.randint(*v))
        return {K.CATEGORY_SPACE: " ", K.CATEGORY_DIGIT: "7", K.CATEGORY_WORD: "w"}.get(v, "x")

    def one(node):
        op, v = node
        if op is K.LITERAL:
            return chr(v)
        if op is K.NOT_LITERAL:
            return next(c for c in "ab" if ord(c) != v)
        if op is K.ANY:
            return r.choice("aeiou")
        if op is K.IN:
            return chosen(v)
        if op is K.BRANCH:
            return make(r.choice(v[1]))
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = v
            return "".join(make(body) for _ in range(r.randint(low, max(low, min(high, low + 2)))))
        if op is K.SUBPATTERN:
            return make(v[3])
        return ""

    return make(parser.parse(pattern))


def texts(seed=1, sentences=14):
    """As many texts as it takes for all entries, three of them in a sentence."""
    r = random.Random(seed)
    parts = []
    for e in entries():
        try:
            parts.append(e if PLAIN.fullmatch(e) else matching(e, r))
        except (re.error, OverflowError):
            continue
    r.shuffle(parts)
    frames = ["The {} house, {} and {}", "I think {} is {} but {}", "However, {} was {}; we saw {}", "{} {} {}", "So {} (and {}) went to {}", "It is important to note that {} may {} in {} cases"]
    ends = [". "] * 6 + ["? ", "! ", ".\n\n", ".\n", "... "]
    out, text = [], ""
    for k in range(0, len(parts) - 2, 3):
        s = r.choice(frames).format(*parts[k : k + 3])
        text += s[:1].upper() + s[1:] + r.choice(ends)
        if k // 3 % sentences == sentences - 1:
            # A text repeats itself here and there, as texts do.
            out.append(text + (text[: len(text) // 3] if len(out) % 4 == 0 else ""))
            text = ""
    hidden = "A\u200bline\u00adwith\ufeff hidden\u00a0signs \u2013 here\u2014there.\r\n\tAnother one\r  Third line. Fourth one here!  Two spaces."
    return out + [text, hidden, "", None, "  \n ", "One short text."]


def rows():
    """``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars``."""
    return [(i, t, ["en", "de"][i % 2], f"src{i % 5}", len(t or "")) for i, t in enumerate(texts())]

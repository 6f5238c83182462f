"""Patterns that are choices of words."""

import re

from inkstone.operators import lexical


def test_choices_of_words_are_looked_up():
    assert lexical.choice_of_words(r"(?i)\b(?:Well|so)\b") == ["well", "so"] and lexical.choice_of_words(r"(?i)\bin\b") == ["in"]
    assert not any(map(lexical.choice_of_words, [r"\b(?:a|b)\b", r"(?i)\b(?:a|I mean)\b", r"(?i)\ba\s+b\b", "(?i)a|b"]))
    words = [w for ps in lexical.lexicons.PATTERNS.values() for p in ps for w in lexical.choice_of_words(p)]
    assert words and all(re.fullmatch("[a-z0-9_]+", w) for w in words)

"""Patterns that estimates of reading difficulty count."""

from __future__ import annotations

# Words that open a clause below another one, without and with ``whom`` and the like.
CLAUSES = r"(?i)\b(?:that|which|who|whom|where|when|because|although|while|if|unless)\b"
DEEP_CLAUSES = r"(?i)\b(?:that|which|who|whom|when|where|because|although|if|unless)\b"
EMBEDDED = r"(?i)\b(?:that|which|who)\b"
# Openings that mislead a reader.
GARDEN_PATHS = [r"\b(?:the|a)\s+\w+\s+\w+ed\s+\w+", r"\b(?:while|when)\s+\w+ing\b"]
# Subjects and verbs of long sentences.
SUBJECTS = r"(?i)\b(?:he|she|it|they|the \w+)\b"
VERBS = r"(?i)\b(?:is|are|was|were|has|have|had|does|do|did)\b"
# Words that may stand for several things.
VAGUE_PRONOUNS = r"(?i)\b(?:it|this|that|these|those|they|them)\b"
POLYSEMOUS = r"(?i)\b(?:bank|run|set|get|take|make|put|turn|right|light|play|point|case)\b"
# Negations.
SIMPLE_NEGATIONS = r"(?i)\b(?:not|no|never|none|nothing|nobody|nowhere|neither)\b"
DOUBLE_NEGATIONS = r"(?i)\b(?:not\s+\w+\s+not|no\s+\w+\s+no|never\s+\w+\s+never)\b"
IMPLICIT_NEGATIONS = r"(?i)\b(?:hardly|barely|scarcely|seldom|rarely)\b"
# Endings of verbs and nouns.
PROPOSITIONS = r"(?i)\b\w+(?:ed|ing|s|es)\b|\b(?:is|are|was|were|be|been|being|have|has|had)\b"
NOUN_ENDINGS = r"(?i)\b\w+(?:tion|ment|ness|ity|ism|er|or|ist|ance|ence)\b"
VERB_ENDINGS = r"(?i)\b\w+(?:ed|ing|s)\b"
ABSTRACT_ENDINGS = r"(?i)\b\w+(?:tion|ism|ity|ment|ness|ance|ence)\b"
# Names and what refers to them.
PRONOUNS = r"(?i)\b(?:it|this|that|these|those|they|them|he|she)\b"
NAMES = r"\b[A-Z][a-z]+\b"
NAME, REFERENCE = r"^[A-Z][a-z]+$", r"(?i)\b(?:it|this|that|they|them|he|she)\b"
ENTITIES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
# Pronouns that hold a text together.
REFERRING = "he she it they this that these those which who".split()

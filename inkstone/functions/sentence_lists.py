"""Words and patterns that scores of sentences, graphs and trends look for."""

from __future__ import annotations

# Phrases that mark a sentence's place in an argument.
DISCOURSE_MARKERS = [
    "furthermore", "moreover", "additionally", "in addition", "however", "nevertheless", "nonetheless", "on the other hand",
    "consequently", "therefore", "thus", "hence", "as a result", "in conclusion", "to summarize", "overall", "in summary",
    "firstly", "secondly", "thirdly", "finally", "lastly", "for example", "for instance", "specifically", "in particular",
    "it is important to note", "it should be noted", "notably", "essentially", "fundamentally", "basically", "ultimately",
]
# Hedges within a sentence.
SENTENCE_HEDGES = ["perhaps", "maybe", "possibly", "might", "could", "may", "seems", "appears"]
# Fixed value: a writer speaking of himself.
PERSONAL = r"(?i)\b(?:I|my|me|we|our|us)\b"
# Transitions of formulaic texts.
STOCK_TRANSITIONS = ["it is important to note", "in conclusion", "furthermore", "moreover", "it is worth noting", "in summary", "as such"]
# Fixed value: the first person in a document's trends.
FIRST_PERSON = r"(?i)\b(?:i|me|my|myself|we|our|us)\b"

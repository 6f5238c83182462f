"""Words that the signals of rewritten texts look for."""

from __future__ import annotations

# Plain words, each with the finer ones that take its place.
FINER_WORDS = {
    "good": ["excellent", "great", "wonderful", "fantastic", "superb", "outstanding"],
    "bad": ["terrible", "awful", "horrible", "dreadful", "poor", "disappointing"],
    "big": ["large", "huge", "enormous", "massive", "substantial", "significant"],
    "small": ["tiny", "little", "minute", "minor", "slight", "minimal"],
    "important": ["crucial", "vital", "essential", "critical", "significant", "key"],
    "help": ["assist", "aid", "support", "facilitate", "enable", "contribute"],
    "show": ["demonstrate", "illustrate", "reveal", "indicate", "display", "exhibit"],
    "use": ["utilize", "employ", "leverage", "apply", "implement", "harness"],
    "make": ["create", "produce", "generate", "develop", "construct", "build"],
    "get": ["obtain", "acquire", "receive", "gain", "secure", "attain"],
}
# Phrases that hedge.
HEDGING_PHRASES = [
    "it is important to note", "it should be noted", "it is worth mentioning",
    "generally speaking", "in many cases", "it could be argued",
    "from this perspective", "in this context", "as we can see",
    "this suggests that", "this indicates that", "this demonstrates",
]
# Words that lead over to the next thought.
TRANSITION_MARKERS = [
    "furthermore", "moreover", "additionally", "consequently", "therefore",
    "however", "nevertheless", "nonetheless", "subsequently", "accordingly",
]
# Weights of the features in the probability; of a negative one its complement counts.
SIGNAL_WEIGHTS = {
    "variance_stability": 2.0,
    "local_variance_consistency": 1.5,
    "feature_correlation_breaks": 2.5,
    "length_complexity_corr": -1.5,
    "rare_synonym_ratio": 2.0,
    "sophistication_jumps": 1.5,
    "artificial_contraction_score": 2.0,
    "contraction_uniformity": 1.0,
    "structure_template_score": 1.5,
    "parallelism_score": 1.0,
    "entropy_stability": 1.5,
    "hedging_density": 1.5,
    "transition_density": 1.0,
}
# Flags, the feature each looks at, and the value above which it is raised.
SIGNAL_FLAGS = [
    ("variance", "variance_stability", 0.75),
    ("correlation", "feature_correlation_breaks", 0.4),
    ("vocabulary", "rare_synonym_ratio", 0.5),
    ("contractions", "artificial_contraction_score", 0.5),
    ("discourse", "hedging_density", 0.3),
    ("entropy", "entropy_stability", 0.8),
    ("structure", "structure_template_score", 0.3),
]
# Verdicts from the highest probability down.
SIGNAL_VERDICTS = [(0.85, "STRONGLY HUMANIZED"), (0.70, "LIKELY HUMANIZED"), (0.55, "POSSIBLY HUMANIZED"), (0.45, "UNCERTAIN"), (0.30, "LIKELY GENUINE")]
LAST_VERDICT, NO_VERDICT = "GENUINE HUMAN", "INSUFFICIENT DATA"

"""Fixed values of the voice categories: words, patterns and baselines that results depend on."""

from __future__ import annotations

# Word lists of the tone dimensions. Entries of several words equal no token.
VOICE = {
    "first": "i me my mine myself we us our ours ourselves".split(),
    "second": "you your yours yourself yourselves".split(),
    "third": "he she it they him her them his hers its their theirs".split(),
    "hedging": """perhaps maybe possibly probably might could may seems appears suggests indicates somewhat relatively fairly rather
arguably potentially likely unlikely generally typically""".split(),
    "certainty": """definitely certainly absolutely clearly obviously undoubtedly unquestionably surely always never must will
proven established confirmed demonstrated evident indisputable""".split(),
    "positive": """good great excellent wonderful amazing fantastic love happy pleased excited delighted thrilled fortunate beneficial
positive successful impressive remarkable outstanding superb""".split(),
    "negative": """bad terrible awful horrible hate dislike disappointing sad angry frustrated annoyed unfortunate problematic
negative failed poor weak flawed inadequate concerning""".split(),
    "formal": """therefore moreover furthermore consequently nevertheless notwithstanding hereby thereof wherein whereas pursuant
accordingly henceforth thus hence thereby""".split(),
    "informal": """like just really pretty stuff things gonna wanna gotta yeah okay ok cool awesome basically
actually literally totally super kinda anyways btw tbh""".split(),
}
HELPER_PHRASES = [
    "happy to help", "glad to assist", "here to help", "let me help", "i can help", "i'd be happy", "absolutely", "great question",
    "excellent question", "that's a great", "wonderful question", "certainly", "of course", "sure thing", "no problem",
    "hope this helps", "feel free", "don't hesitate", "let me know", "happy to clarify", "hope that helps", "glad to help",
]
HELPER_PATTERNS = [
    r"(?i)absolutely!|great question!|excellent!|perfect!|wonderful!", r"(?i)i(?:'d| would) be happy to", r"(?i)that's a (?:great|wonderful|excellent|fantastic) (?:question|point|idea)",
    r"(?i)i (?:hope|trust) (?:this|that) helps", r"(?i)(?:feel free|don't hesitate) to (?:ask|reach out|let me know)", r"(?i)let me (?:help|assist|explain|break (?:it |this )?down)",
    r"(?i)here(?:'s| is) (?:a |the )?(?:quick |brief )?(?:summary|overview|breakdown)",
]
HELPER_OPENINGS = ["here is", "here are", "here's a", "let me", "i'd be happy", "i can help", "absolutely", "certainly", "of course", "great question", "that's a great"]

# Word classes.
STOCK_ADVERBS = """certainly clearly importantly significantly essentially fundamentally particularly specifically generally typically
ultimately primarily notably remarkably considerably substantially effectively consequently accordingly furthermore
moreover additionally subsequently previously currently increasingly undoubtedly inevitably inherently seemingly""".split()
HEDGING_VERBS = "may might could would should can appears seems tends suggests indicates implies represents demonstrates illustrates".split()
VERB_PHRASES = [
    "it is important to", "it is essential to", "it is worth noting", "it should be noted", "it is crucial to", "it is necessary to",
    "plays a crucial role", "plays an important role", "serves as", "contributes to", "leads to", "results in", "enables us to",
    "allows us to", "helps to", "aims to", "seeks to", "strives to", "is designed to", "is intended to", "is meant to", "is used to",
    "can be seen", "can be found", "can be used", "can be applied", "has been shown", "has been demonstrated", "has been established",
    "there is a need", "there is evidence", "there are several", "it is clear that", "it is evident that", "it is apparent that",
]
PERSONAL_PATTERNS = [
    "i think", "i believe", "i feel", "i guess", "i suppose", "honestly", "frankly", "actually", "basically", "literally",
    "kinda", "sorta", "gonna", "wanna", "gotta", "you know", "i mean", "like i said",
]
ADVERB = r"(?i)\b[A-Za-z0-9_]+ly\b"
VERB = r"(?i)\b(?:is|are|was|were|be|been|being|have|has|had|do|does|did|will|would|shall|should|may|might|can|could|must|[A-Za-z0-9_]+ed|[A-Za-z0-9_]+ing|[A-Za-z0-9_]+s)\b"
TENSES = {
    "past": r"(?i)\b(?:was|were|had|did|[A-Za-z0-9_]+ed)\b",
    "present": r"(?i)\b(?:is|are|am|has|have|do|does|[A-Za-z0-9_]+s)\b",
    "future": r"(?i)\b(?:will|shall|going to)\b",
}

# Repetition.
SUMMING_UP = ["in conclusion", "to summarize", "in summary", "overall", "as mentioned", "as stated", "as discussed", "as noted", "this means", "this shows", "this demonstrates", "this indicates"]
STARTS = {"DET": "the a an this that".split(), "PRON": "i we you he she they it".split(), "TRANS": "however therefore moreover furthermore additionally".split()}

# Kinds of openings, the first that fits counts.
OPENING_KINDS = [
    r"(?i)^(?:I|We|You|He|She|It|They|One|This|That|These|Those)\b", r"(?i)^(?:The|A|An)\b", r"(?i)^(?:And|But|Or|So|Yet|However|Therefore|Moreover|Furthermore|Additionally|Nevertheless)\b",
    r"(?i)^(?:Quickly|Slowly|Carefully|Often|Always|Never|Usually|Generally|Typically|Specifically|Interestingly|Importantly)\b",
    r"(?i)^(?:In|On|At|By|With|From|To|For|Through|During|Before|After|Among|Between)\b", r"(?i)^[A-Za-z0-9_]+ing\b",
    r"(?i)^(?:What|Why|How|When|Where|Who|Which|Is|Are|Do|Does|Can|Could|Would|Should)\b", r"(?i)^(?:If|When|Although|While|Since|Because|Unless|Whether)\b",
    r"(?i)^(?:[0-9]+|One|Two|Three|Four|Five|First|Second|Third|Many|Several|Few)\b", r"""^["']""", r"^[A-Z][a-z]+\s+[A-Z]",
]
IDIOMS = [
    "at the end of the day", "in the long run", "time will tell", "sooner or later", "on the other hand", "in contrast", "by comparison", "as opposed to",
    "in fact", "as a matter of fact", "to be sure", "without a doubt", "as a result", "due to", "owing to", "on account of",
    "in summary", "to summarize", "in conclusion", "all in all", "in other words", "that is to say", "to put it simply", "namely",
    "in addition", "furthermore", "moreover", "what is more", "having said that", "that being said", "even so", "be that as it may",
]
SUBORDINATE = r"(?i)\b(?:because|although|while|if|when|since|unless|whereas|whether)\b"
CONNECTIVE = r"(?i)\b(?:therefore|however|moreover|furthermore|consequently|nevertheless)\b"
SLIPS = [r"\b[A-Za-z0-9_]*[aeiou]{3,}[A-Za-z0-9_]*\b", r"[,;:]{2,}|[.!?]{3,}", r"\s{3,}|[A-Za-z0-9_][.!?][A-Za-z0-9_]", r"[.!?]\s+[a-z]", r"(?m)^[A-Z][^.!?]{1,15}[.!?]$"]
PASSIVE = r"(?i)\b(?:is|are|was|were|been|be)\s+[A-Za-z0-9_]+ed\b"
FIRST_PERSON = r"(?i)\b(?:I|me|my|mine|we|us|our)\b"

# Which categories (by number) a head combines, and its weight.
HEADS = {"syntax": ([2, 1], 0.15), "discourse": ([6, 10], 0.20), "compression": ([3, 7, 8], 0.20), "errors": ([16], 0.15), "stability": ([15], 0.15), "authorship": ([13, 9], 0.15)}

# Kinds of writing. Of each pattern, what one occurrence counts, or 0 if all occurrences do.
COHORTS = {
    "academic": [
        (r"(?i)\b(?:study|research|analysis|hypothesis|methodology|findings|conclusion|data|evidence)\b", 2), (r"(?i)\b(?:et al|ibid|cf|viz|i\.e\.|e\.g\.)\b", 2),
        (r"(?i)\b(?:significant|correlation|variables|participants|results)\b", 2),
    ],
    "technical": [
        (r"(?i)\b(?:function|method|class|variable|parameter|return|install|configure|setup)\b", 2), (r"(?i)\b(?:step [0-9]|first|then|next|finally|ensure|make sure)\b", 2),
        (r"(?i)```|\bcode\b|\bcommand\b", 1),
    ],
    "journalistic": [
        (r"(?i)\b(?:said|according to|reported|announced|statement|official)\b", 2), (r"(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b", 2),
        (r"(?i)\b(?:percent|million|billion|government|company|president)\b", 2),
    ],
    "creative": [
        (r"(?i)\b(?:felt|thought|wondered|realized|seemed|appeared)\b", 2), (r"""["'][^"']*["']""", 0), (r"(?i)\b(?:heart|eyes|hands|voice|silence|darkness|light)\b", 2),
    ],
    "conversational": [
        (r"(?i)\b(?:lol|omg|btw|idk|tbh|imo|ngl)\b", 2), (r"[!?]{2,}|\.{3,}|😀|😂|🤔", 1), (r"(?i)\b(?:like|literally|basically|honestly|actually)\b", 2),
    ],
    "business": [
        (r"(?i)\b(?:please|kindly|regards|sincerely|attached|meeting|schedule)\b", 2), (r"(?i)\b(?:team|project|deadline|deliverable|stakeholder|budget)\b", 2),
        (r"(?i)\b(?:looking forward|best regards|thank you for)\b", 2),
    ],
}
# Mean and deviation of each measure, in the order of MEASURES, and the threshold.
MEASURES = ["richness", "complexity", "formality", "passive", "first_person", "repetition", "burstiness"]
COHORT_RANGES = {
    "academic": ([(0.55, 0.12), (0.65, 0.15), (0.75, 0.10), (0.25, 0.10), (0.15, 0.12), (0.08, 0.04), (0.35, 0.15)], 2.0),
    "technical": ([(0.40, 0.10), (0.45, 0.12), (0.60, 0.12), (0.20, 0.08), (0.25, 0.15), (0.12, 0.05), (0.45, 0.15)], 2.0),
    "journalistic": ([(0.50, 0.12), (0.50, 0.15), (0.65, 0.12), (0.18, 0.08), (0.08, 0.06), (0.06, 0.03), (0.55, 0.15)], 2.0),
    "creative": ([(0.60, 0.15), (0.50, 0.20), (0.35, 0.20), (0.10, 0.08), (0.35, 0.25), (0.10, 0.08), (0.65, 0.18)], 2.5),
    "conversational": ([(0.35, 0.12), (0.30, 0.15), (0.20, 0.15), (0.05, 0.05), (0.45, 0.20), (0.08, 0.05), (0.70, 0.15)], 2.5),
    "business": ([(0.42, 0.10), (0.45, 0.12), (0.70, 0.10), (0.15, 0.08), (0.30, 0.15), (0.10, 0.05), (0.40, 0.12)], 1.8),
    "general": ([(0.50, 0.15), (0.50, 0.18), (0.50, 0.20), (0.15, 0.10), (0.25, 0.18), (0.08, 0.05), (0.50, 0.18)], 2.0),
}
COHORT_COUNTS = {
    "subordinate": r"(?i)\b(?:because|although|while|if|when|since|unless|whereas)\b", "formal": r"(?i)\b(?:therefore|however|moreover|furthermore|consequently|thus|hence)\b",
    "informal": r"(?i)\b(?:like|basically|actually|literally|kinda|sorta|gonna|wanna)\b", "short": r"(?i)\b[A-Za-z0-9_]+'(?:t|s|d|ll|ve|re|m)\b",
    "passives": r"(?i)\b(?:is|are|was|were|been|be|being)\s+[A-Za-z0-9_]+ed\b", "mine": r"(?i)\b(?:I|me|my|mine|we|us|our|ours)\b",
}

# Rewriting in place. For each word the first of its synonyms.
SYNONYM = {
    "good": "great", "bad": "poor", "important": "crucial", "big": "large", "small": "minor", "show": "demonstrate", "help": "assist", "make": "create", "use": "utilize", "get": "obtain",
    "think": "believe", "say": "state", "need": "require", "find": "discover", "give": "provide", "take": "accept", "come": "arrive", "see": "observe", "know": "understand", "become": "turn",
    "delve": "explore", "crucial": "critical", "comprehensive": "thorough", "facilitate": "enable", "leverage": "use", "implement": "execute", "enhance": "improve", "optimize": "improve",
}
DOT = r"[^\n\r\x{2028}\x{2029}]"
LEADING_WORD = rf"^([A-Za-z0-9_]+),\s+({DOT}+)$"
LEADING_CLAUSE = rf"^(Although|While|When|If|Since|Because)\s+({DOT}+),\s+({DOT}+)$"
LATER_CLAUSE = rf"(?i)^({DOT}+)\s+(because|since|as|while|although)\s+({DOT}+)$"
TWO_BEFORE_NOUN = r"(\b[A-Za-z0-9_]+\b)\s+(\b[A-Za-z0-9_]+\b)\s+(noun|thing|person|place|idea|way|time)"
SECOND_ADVERB = r"(?i)^([A-Za-z0-9_]+)\s+(quickly|slowly|carefully|often|always|never|usually)\s+"
WORD_TAGS = [
    ("the|a|an", "DET"), ("is|are|was|were|be|been|being", "BE"), ("has|have|had", "HAVE"), ("will|would|could|should|may|might|can", "MOD"), ("and|or|but|yet|so", "CONJ"),
    ("in|on|at|to|for|with|by|from", "PREP"), ("I|you|he|she|it|we|they|me|him|her|us|them", "PRON"), ("[A-Za-z0-9_]+ly", "ADV"), ("[A-Za-z0-9_]+ing", "VING"), ("[A-Za-z0-9_]+ed", "VED"),
    ("[A-Za-z0-9_]+tion", "NTION"), ("[A-Za-z0-9_]+ness", "NNESS"),
]
NO_CONCEPTS = """the a an is are was were be been have has had do does did will would could should may might can to of in for on with at by from
as into through during before after above below between and or but if then else when where why how all each every both few more most other some such no
not only own same so than too very just also now here there this that these those it its""".split()

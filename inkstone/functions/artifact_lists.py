"""Fixed values of the features of rewritten texts: words, phrases and patterns in which results depend."""

from __future__ import annotations

# Patterns. An edge is one of words of any script.
CONTRACTION = (
    r"(?i)\b(?:i'm|i've|i'll|i'd|you're|you've|you'll|you'd|he's|she's|it's|we're|we've|we'll|we'd|they're|they've|they'll|they'd|"
    r"isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|won't|wouldn't|don't|doesn't|didn't|can't|couldn't|shouldn't|mightn't|mustn't|"
    r"let's|that's|who's|what's|where's|there's|here's|could've|would've|should've|might've|must've|gonna|wanna|gotta|kinda|sorta|outta|'cause|'bout)\b"
)
CASUAL_CONTRACTION = r"(?i)\b(?:gonna|wanna|gotta|kinda|sorta|outta|'cause|'bout|dunno|gimme|lemme|coulda|woulda|shoulda|mighta|oughta)\b"
DISFLUENCY = (
    r"(?i)\b(?:well|so|um|uh|hmm|like|basically|honestly|actually|anyway|anyhow|I mean|you know|I guess|I think|I suppose|kind of|sort of|more or less|in a way)\b"
)
STARTING_DISFLUENCY = r"^(?:Well,|So,|I mean,|You know,|Like,|Basically,|Honestly,|Actually,|Look,|See,|Thing is,|Okay so,|Right,|Anyway,)"
RHETORICAL = (
    r"(?i)\b(?:right\?|you know\?|make sense\?|get it\?|don't you think\?|wouldn't you agree\?|isn't it\?|crazy,? right\?|wild,? huh\?|fair enough\?)\s*"
)
SIGNS = {"ellipsis_count": r"\.{2,}", "em_dash_count": "—|--", "double_punct_count": "[!?]{2,}", "exclamation_count": "!"}
# Phrases looked for anywhere in the lower-case text.
STOCK_PHRASES = [
    "it is important to note", "it's important to note", "it is worth noting", "it's worth noting", "it is essential to", "it's essential to",
    "furthermore", "moreover", "additionally", "in conclusion", "to summarize", "in summary", "this demonstrates", "this illustrates", "this shows that",
    "it can be observed", "one must consider", "plays a pivotal role", "plays a crucial role", "in today's world", "in the modern era",
    "a myriad of", "a plethora of", "a multitude of", "it is crucial to understand", "it is imperative", "the importance of", "the significance of",
    "delve into", "delve deeper", "dive into", "comprehensive understanding", "thorough analysis", "in the realm of", "in the context of",
    "subsequently", "consequently", "henceforth", "notwithstanding", "nevertheless", "nonetheless",
]
PASSIVES = ["is being", "was being", "has been", "have been", "had been", "will be", "is done", "was done", "are done"]
STRUCTURE = ["furthermore", "moreover", "additionally", "in conclusion"]
FRAGMENTS = [
    "crazy.", "wild.", "insane.", "nuts.", "ridiculous.", "absolutely.", "definitely.", "obviously.", "clearly.", "for sure.", "no doubt.", "big time.", "huge.",
    "makes sense.", "fair point.", "good question.", "my bad.", "no way.", "for real.", "no joke.", "seriously.", "honestly.", "basically.",
]
# Words. Entries that are no single word of letters equal no word, so they are left out.
WORDS = {
    "formal": """utilize facilitate implement comprehensive significant demonstrate indicate require provide obtain sufficient approximately
primarily frequently occasionally immediately subsequently consequently furthermore moreover therefore hence thus thereby wherein
whereas insofar notwithstanding aforementioned henceforth heretofore therein thereof""".split(),
    "transition": "furthermore moreover additionally however therefore consequently nevertheless nonetheless".split(),
    "hedging": "probably maybe perhaps possibly likely might could seems appears apparently supposedly arguably presumably".split(),
    "emphatic": "seriously literally absolutely totally completely definitely certainly obviously clearly honestly frankly really truly genuinely actually".split(),
    "typo": """teh hte adn nad taht tht ahve hvae wiht wtih tihs thsi form fomr tehy thye bene thier ther woudl owuld abuot abotu
coudl cuold whcih wich theer tehre wehre becuase beacuse somethign soemthing realy raelly definately definitly porbably probabl diferent
diffrent trough thru acutally actualy rly def prob bc smth sth tmrw tmr""".split(),
    "slang": """cool awesome dope sick fire lit legit vibe vibes mood lowkey highkey cap bet slay stan flex sus
bro bruh dude fam tbh ngl imo imho lol lmao omg wtf idk ikr smh fyi""".split(),
    "common": """the be to of and a in that have i it for not on with he as you do at
this but his by from they we say her she or an will my one all would there their what""".split(),
}

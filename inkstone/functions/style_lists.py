"""Word lists and patterns of the style categories (fixed values)."""

ARCHAIC_VERBS = """doth hath art wilt shalt hast hadst wouldst shouldst couldst didst dost knowest speaketh cometh goeth maketh giveth taketh
saith sayeth""".split()
ARCHAIC_PRONOUNS = "thou thee thy thine ye wherefore whence thence hither thither hence".split()
ARCHAIC_SYNTAX = "unto amongst whilst betwixt ere nigh oft perchance mayhap forsooth verily methinks prithee anon".split()
ANACHRONISMS = """computer internet email phone television radio airplane automobile electricity technology digital online website software
database algorithm basically literally actually totally definitely awesome amazing incredible fantastic""".split()
MODERN_CONTRACTIONS = "don't doesn't didn't won't wouldn't couldn't shouldn't can't isn't aren't wasn't weren't haven't hasn't hadn't".split()
THOU_FORMS = "art wilt shalt hast dost canst mayest".split()

COMMON_BIGRAMS = ["it is", "there are", "this is", "that is", "we can", "can be", "in the", "of the", "to the", "and the", "is a", "are a", "as a", "for a", "with a"]
COMMON_TRIGRAMS = [
    "it is important", "there are many", "one of the", "as well as", "in order to", "due to the", "on the other", "the other hand", "in terms of",
    "the fact that", "it should be", "it can be", "this means that", "in addition to", "as a result",
]

CLAUSE_SIGNS = "(?i)[,;:]|which|that|because|although|while|if|when"
TONES = {
    "formal": ["therefore", "consequently", "furthermore", "moreover", "thus", "hence", "accordingly", "whereby"],
    "informal": ["basically", "actually", "like", "just", "really", "pretty", "kind of", "sort of", "gonna", "wanna"],
    "confident": ["clearly", "obviously", "certainly", "definitely", "undoubtedly", "must", "always", "never"],
    "uncertain": ["maybe", "perhaps", "possibly", "might", "could", "seems", "appears", "somewhat"],
}

CAUTIOUS_PHRASES = [
    "it could be argued", "one might suggest", "it is possible that", "there is potential for", "in some cases", "under certain circumstances",
    "to a certain extent", "in many ways", "arguably", "presumably", "it seems that", "it appears that", "it would seem", "it may be",
    "this suggests that", "this indicates that", "this implies that", "generally speaking", "broadly speaking", "for the most part",
    "with that said", "that being said", "having said that", "it is worth noting", "it is important to note", "it should be noted",
    "it is essential to understand", "it is crucial to recognize", "while there are", "there are several", "there are many",
    "it is widely recognized", "it is generally accepted", "can potentially", "may potentially", "could potentially",
]
STANCE_PHRASES = [
    "i strongly believe", "without a doubt", "absolutely", "definitely", "certainly", "undeniably", "unquestionably", "clearly", "obviously",
    "it is clear that", "there is no doubt", "the fact is", "i am convinced", "i firmly believe", "make no mistake",
]
ASSISTANT_PATTERNS = [
    "(?i)here('s| is) (a |the )?(breakdown|overview|summary|look)", "(?i)let('s| us) (delve|explore|examine|consider|take a look)", r"(?i)(first|1\.|•)\s*(and |then )?(second|2\.|•)",
    "(?i)key (takeaways?|points?|considerations?|factors?)", "(?i)in (essence|summary|conclusion|short)", "(?i)the (bottom line|key point|main takeaway)",
    "(?i)what (this|that) means is", "(?i)when it comes to", "(?i)in terms of",
]
ASSISTANT_OPENINGS = ["here is", "here are", "here's", "let me", "let's", "i'd be happy to", "absolutely!", "great question!", "that's a great", "i can help", "sure!", "of course!"]
BALANCE_TEMPLATES = [
    "(?i)on one hand.*on the other hand", "(?i)while.*however", "(?i)although.*nevertheless", "(?i)pros and cons", "(?i)advantages and disadvantages",
    "(?i)benefits and drawbacks", "(?i)positive.*negative", "(?i)both sides", "(?i)there are arguments (for|both)",
]
PRO_WORDS = "advantage benefit positive good helpful useful important valuable".split()
CON_WORDS = "disadvantage drawback negative bad harmful problematic concerning risk".split()
INTRODUCTIONS = [
    "^(in (today's|the modern|our) (world|era|society))", "^(throughout history)", "^(it is (widely|commonly|generally) (known|accepted|understood))", "^(the (importance|significance|impact) of)",
]
BODY_SIGNS = ["(?i)(first(ly)?|second(ly)?|third(ly)?|finally)", "(?i)(to begin with|moving on|furthermore|in addition)", "(?i)(another (important|key|crucial) (point|aspect|factor))"]
CONCLUSIONS = ["(in conclusion|to conclude|in summary|to summarize)", "(all in all|overall|ultimately|in the end)", "(taking everything into (account|consideration))"]

SENTENCE_FILLERS = ["well,", "so,", "i mean,", "you know,", "like,", "basically,", "honestly,", "actually,", "look,", "see,", "thing is,", "okay so,", "right,", "anyway,", "anyhow,", "now,", "okay,", "alright,"]
INFORMAL_CONTRACTIONS = "gonna wanna gotta kinda sorta outta 'cause 'bout dunno gimme lemme coulda woulda shoulda mighta oughta".split()
STANDARD_CONTRACTIONS = """i'm i've i'll i'd you're you've you'll you'd he's she's it's we're we've we'll we'd they're they've they'll they'd isn't aren't
wasn't weren't hasn't haven't hadn't won't wouldn't don't doesn't didn't can't couldn't shouldn't mightn't mustn't let's that's who's what's where's
there's here's could've would've should've might've must've""".split()
PLANTED_TYPOS = """teh hte adn nad taht tht ahve hvae wiht wtih tihs thsi form fomr tehy thye bene thier ther woudl owuld abuot abotu coudl cuold whcih wich
theer tehre wehre becuase beacuse somethign soemthing realy raelly definately definitly porbably probabl diferent diffrent trough thru acutally
actualy rly def prob bc b/c smth sth tmrw tmr""".split()
SLANG = """cool awesome dope sick fire lit legit vibe vibes mood lowkey highkey cap bet slay stan flex sus bro bruh dude fam tbh ngl imo imho lol lmao omg
wtf idk ikr smh""".split()
FORMAL = """utilize facilitate implement comprehensive significant demonstrate indicate furthermore moreover therefore consequently nevertheless
notwithstanding aforementioned henceforth wherein""".split()
LEFTOVER_PHRASES = [
    "it is important to note", "it's important to note", "it is worth noting", "it's worth noting", "furthermore", "moreover", "additionally", "in conclusion",
    "to summarize", "in summary", "this demonstrates", "this illustrates", "plays a pivotal role", "plays a crucial role", "a myriad of", "a plethora of",
    "a multitude of", "delve into", "delve deeper", "in the realm of",
]
RHETORICAL_QUESTIONS = ["right?", "you know?", "make sense?", "get it?", "don't you think?", "wouldn't you agree?", "isn't it?", "crazy, right?", "wild, huh?", "fair enough?"]

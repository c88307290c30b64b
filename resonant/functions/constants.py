"""Word lists, tables, patterns and formats that results depend on."""

# fmt: off
#: The eight emotions, in order.
EMOTIONS = ("joy", "anger", "fear", "sadness", "surprise", "disgust", "excitement", "neutral")
#: Lexicon label, emotion, weight.
LABEL_WEIGHTS = (
    ("joy", "joy", 1.0), ("anger", "anger", 1.0), ("fear", "fear", 1.0), ("sadness", "sadness", 1.0), ("surprise", "surprise", 1.0), ("disgust", "disgust", 1.0),
    ("anticipation", "excitement", 1.0), ("trust", "neutral", 1.0), ("positive", "joy", 0.5), ("negative", "sadness", 0.5),
)
#: English stop words.
STOP_WORDS = tuple((
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split())
#: Words that topics ignore besides stop words.
TOPIC_STOP_WORDS = (
    "yeah", "oh", "uh", "na", "la", "ya", "choru", "chorus", "verse", "hook", "da", "ah", "woah", "ooh", "hey", "huh", "whoa", "mmm", "mm", "vers", "bridg", "outro",
    "got", "get", "gotta", "got ta", "wan", "want", "gon", "gonna", "im", "em", "ta", "say", "said", "tell", "look", "come", "let", "make",
    "fuck", "shit", "bitch", "nigga", "ass", "damn", "hell", "yo",
)
#: Words masked and words left out in vocabulary reports.
CENSORED = ("fuck", "fucking", "shit", "bitch", "nigga", "nigger", "cunt", "dick", "pussy")
DOMAIN_STOP_WORDS = ("choru", "vers", "intro", "outro", "yeah", "oh", "uh", "na", "la", "doo", "da", "repeat", "refrain")
#: Words that open a section line, and patterns of lines that carry no lyrics.
SECTION_WORDS = (
    "chorus", "verse", "bridge", "intro", "outro", "pre-chorus", "pre chorus", "post-chorus", "post chorus", "hook", "refrain", "interlude", "break",
    "instrumental", "skit", "spoken", "drop", "solo",
)
METADATA_PATTERN = r"read more|contributors|translation|transliteration|lyrics? provided|produced by|written by|copyright|all rights reserved"
PARENTHESISED_LINE = r"^\([^)]{2,30}\)$"
REPEAT_LINE = r"(?i)^\s*(x\s*\d+|\d+\s*x|repeat\s*x?\s*\d+)\s*$"
SECTION_TAIL = r"(\s*(\d+|[ivx]+))?(\s*(x\s*\d+|\d+\s*x))?(\s*[:\-–—]\s*.*)?\s*$"
BRACKETS = r"\[([^\[\]]+)\]"
#: Phrases that tell what a bracket holds.
REPEAT_PHRASE = r"^(x\s*\d+|\d+\s*x|repeat\s*x\s*\d+)$"
SECTION_KEYWORDS = ("verse", "chorus", "hook", "bridge", "intro", "outro", "pre-chorus", "post-chorus", "refrain", "interlude", "break", "drop", "instrumental", "spoken", "skit", "solo")
META_KEYWORDS = ("produced by", "prod.", "written by", "translated by", "genius", "remix")
SPEAKER_PHRASE = r"^[a-z0-9 .,&'’-]{2,40}$"
#: Marks of translated pages and of guest credits.
TRANSLATION_MARKS = ("translation", "traduccion", "traducción", "übersetzung", "tradução", "перевод", "översättning")
CREDIT_MARKS = ("feat", "Feat", "FEAT", "featuring", "ft.", "(with", "Ft.")
#: Contractions in lyrics, in the order in which they are expanded.
LYRIC_CONTRACTIONS = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "cannot"), (r"\bain't\b", "is not"), (r"n't\b", " not"), (r"'re\b", " are"), (r"'m\b", " am"),
    (r"'ll\b", " will"), (r"'ve\b", " have"), (r"'d\b", " would"), (r"\bit's\b", "it is"),
)
#: Contractions in posts.
POST_CONTRACTIONS = {
    "can't": "cannot", "cant": "cannot", "won't": "will not", "don't": "do not", "doesn't": "does not", "didn't": "did not", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "wouldn't": "would not", "shouldn't": "should not",
    "couldn't": "could not", "i'm": "i am", "im": "i am", "you're": "you are", "youre": "you are", "we're": "we are", "they're": "they are", "it's": "it is",
    "that's": "that is", "there's": "there is", "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have", "i'll": "i will", "you'll": "you will",
    "we'll": "we will", "they'll": "they will", "i'd": "i would", "you'd": "you would", "we'd": "we would", "they'd": "they would", "y'all": "you all", "yall": "you all",
}
#: Slang in posts.
SLANG = {
    "rn": "right now", "dm": "direct message", "dms": "direct messages", "idk": "i don't know", "imo": "in my opinion", "imho": "in my humble opinion", "omg": "oh my god",
    "lmao": "laughing", "lol": "laughing", "u": "you", "ur": "your", "thx": "thanks", "pls": "please", "plz": "please", "tbh": "to be honest", "smh": "shaking my head",
    "btw": "by the way", "ngl": "not gonna lie", "fr": "for real", "ikr": "i know right", "brb": "be right back", "lmk": "let me know", "omw": "on my way", "hmu": "hit me up",
    "wyd": "what are you doing", "idc": "i do not care", "ily": "i love you", "jk": "just kidding", "nvm": "never mind", "ttyl": "talk to you later",
}
SLANG_PATTERNS = ((r"(?i)\bw/\b", "with"), (r"(?i)\bw/o\b", "without"), (r"(?i)\bya\b", "you"))
#: Hashtags.
TAG_SUFFIXES = (
    "vibes", "mood", "life", "time", "day", "night", "love", "goals", "energy", "feels", "feeling", "moments", "moment", "happy", "sad",
    "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "weekend",
)
TAG_MAP = {
    "notokay": ["not", "okay"], "mentalhealth": ["mental", "health"], "selfcare": ["self", "care"], "sundayfunday": ["sunday", "fun", "day"],
    "weekendvibes": ["weekend", "vibes"], "smalljoys": ["small", "joys"], "plotwist": ["plot", "twist"], "instamood": ["insta", "mood"],
}
TAG_EXTRA_WORDS = ("not", "okay", "ok", "funday", "selfcare", "small", "joys", "cozy", "cosy", "insta", "plot", "twist")
TAG_SHORT_WORDS = ("not", "fun", "day", "sad", "bad", "big", "new", "old", "wow", "yay")
#: Query expansion.
NOT_EXPANDED = (
    "always", "never", "ever", "why", "where", "when", "how", "this", "that", "these", "those", "it", "now", "then", "mood", "okay", "really", "someone", "after", "about",
    "one", "let", "lets", "letting", "realize", "realizes", "realized", "realizing", "lot",
)
GATE_EXEMPT = (
    "sad", "happy", "angry", "mad", "fear", "scared", "anxious", "anxiety", "excited", "exciting", "surprised", "surprise", "love", "hate", "lonely", "tired", "calm",
    "peace", "peaceful",
)
VERB_SOURCES = (
    "cry", "cries", "cried", "crying", "laugh", "laughs", "laughed", "laughing", "smile", "smiles", "smiled", "smiling", "scream", "screams", "screamed", "screaming",
    "dance", "dances", "danced", "dancing", "sing", "sings", "sang", "sung", "singing", "miss", "misses", "missed", "missing", "hurt", "hurts", "hurted", "hurting",
    "heal", "heals", "healed", "healing", "panic", "panics", "panicked", "panicking", "worry", "worries", "worried", "worrying",
)
NOT_ADDED = ("make", "manner", "style", "sort", "idea", "think", "entirely", "wholly", "all", "mass")
DRIFTING = ("ace", "climate", "temper", "humor", "approve", "sanction", "earn", "profit", "wage", "salary", "income", "revenue", "rent", "lease", "mortgage")
MONEY_WORDS = (
    "money", "cash", "paid", "pay", "paying", "price", "cost", "bucks", "dollar", "dollars", "job", "work", "salary", "wage", "income", "profit", "revenue", "tip", "tips", "bonus",
)
HOUSING_WORDS = (
    "rent", "rented", "renting", "lease", "tenant", "landlord", "apartment", "room", "house", "home", "mortgage", "move", "moved", "moving", "deposit", "utility", "utilities",
)
MONEY_TERMS = ("earn", "profit", "wage", "salary", "income", "revenue")
HOUSING_TERMS = ("rent", "lease", "mortgage")
#: Code points that count as emoji.
EMOJI = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
# fmt: on

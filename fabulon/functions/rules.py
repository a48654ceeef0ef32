"""Fixed values of the text rules: word lists and patterns that results depend on, whole and in their own order.

Patterns are in the syntax that Java and RE2 share, but for two look-aheads (Java only).
"""

from __future__ import annotations

# -- blocks --------------------------------------------------------------------------------------

#: A block that any of these finds is not part of the story.
NON_DIEGETIC = (
    r"^\s*(?:read|continue reading)\b.*\b(?:at|on)\b.*\.(?:com|net|org|me|co)\b",
    r"\b(?:visit|check out|find us at)\b.*\.(?:com|net|org)\b",
    r"^\s*(?:previous|next)\s+chapter\s*$",
    r"^\s*(?:table of )?contents\s*$",
    r"^\s*advertisement\s*$",
    r"^\s*(?:please )?(?:support|donate|patreon|ko-?fi)\b",
    r"^\s*join (?:our|the) discord\b",
    r"^\s*translat(?:or|ed) by\b.*\bedit(?:or|ed) by\b",
    r"^\s*copyright\b|\ball rights reserved\b",
    r"^\s*isbn\b",
)
#: Headings of what follows the story.
APPENDIX_HEADINGS = (
    "pathways guide", "image gallery", "characters", "locations", "map of the lord of the mysteries world",
    "back cover", "front cover", "full cover", "copyright", "synopsis", "table of contents",
    "to be continued in...", "end of volume 1",
)
#: Openings of notes.
AUTHOR_NOTE = r"^\s*(?:author'?s?\s+(?:note|words|thoughts)|a/?n\s*[:\-]|afterword|postscript)\b"
TRANSLATOR_NOTE = r"^\s*(?:translator'?s?\s+note|tl\s*note|t/?n\s*[:\-]|editor'?s?\s+note|note\s*[:\-]\s*(?=.*\btranslat))"
#: Status windows.
SYSTEM_DELIMITERS = (("[", "]"), ("【", "】"), ("<", ">"), ("《", "》"))
KEY_VALUE = r"^\s*[-*+•]?\s*([\w \t'/()-]{1,40}?)\s*[:：]\s*(.+?)\s*$"
SYSTEM_WORDS = r"\b(?:status|window|system|quest|skill|attribute|stat|notification|achievement|level up|ding|alert)\b"

# -- narrative markers ---------------------------------------------------------------------------

#: Fixed values: (kind, patterns, confidence) in the order in which they are looked for.
MARKERS = (
    ("ENTER_DREAM", (
        r"\bhis vision (?:changed|blurred|darkened|shifted)\b",
        r"\bher vision (?:changed|blurred|darkened|shifted)\b",
        r"\bentered the dream realm\b",
        r"\bwas pulled into (?:the |a )?dream\b",
        r"\bthe dream realm (?:began|started|unfolded)\b",
        r"\bfell into (?:a |the )?dream\b",
        r"\bactivated the .{0,30}dream .{0,20}gu\b",
        r"\bthe scene before (?:him|her) (?:changed|shifted|transformed)\b",
        r"\bwhen (?:he|she) opened (?:his|her) eyes (?:again )?,? (?:he|she) (?:was|found)\b",
    ), 0.85),
    ("EXIT_DREAM", (
        r"\bthe dream (?:realm )?(?:faded|ended|collapsed|shattered|dissolved)\b",
        r"\b(?:he|she) (?:awoke|awakened|woke up)\b",
        r"\b(?:left|exited|withdrew from) the dream realm\b",
        r"\bthe memory faded\b",
        r"\breturned to reality\b",
        r"\bthe vision (?:faded|ended|cleared)\b",
        r"\bback in the real world\b",
    ), 0.8),
    ("ENTER_VISION", (
        r"\ba vision (?:appeared|formed|came)\b",
        r"\bsaw (?:a |the )?(?:vision|prophecy|omen)\b",
        r"\bthe (?:prophecy|divination) (?:showed|revealed)\b",
        r"\bin (?:his|her) mind's eye\b",
        r"\bforesaw\b",
    ), 0.7),
    ("TIME_SKIP", (
        r"\b(?:three|four|five|six|seven|eight|nine|ten|\d+) (?:years|months|days|weeks) (?:later|passed|went by)\b",
        r"\b(?:a|one|two) (?:year|month|day|week|decade)s? (?:later|passed|went by)\b",
        r"\btime (?:passed|flew|flowed)\b",
        r"\bin the blink of an eye,? .{0,30}(?:years|months|days)\b",
        r"\bbefore (?:he|she|they) knew it,? .{0,30}(?:years|months|days)\b",
        r"\bthe following (?:year|month|spring|summer|autumn|winter)\b",
        r"\bseasons? (?:changed|passed)\b",
    ), 0.75),
    ("ENTER_FLASHBACK", (
        r"\b(?:many |several |a few )?(?:years|months|days|decades|centuries) (?:ago|earlier|before)\b",
        r"\bback (?:then|when)\b",
        r"\bin (?:his|her|their) (?:previous|past|former) life\b",
        r"\b(?:he|she) recalled (?:that|how|the)\b",
        r"\b(?:he|she) remembered (?:that|how|the)\b",
        r"\bmemories? (?:of|from) .{0,40}(?:surfaced|resurfaced|flooded|returned)\b",
        r"\bat that time\b",
        r"\bthinking back\b",
        r"\bonce upon a time\b",
        r"\bin (?:those|olden) days\b",
    ), 0.5),
    ("EXIT_FLASHBACK", (
        r"\b(?:returning|back) to the present\b",
        r"\bthe memory (?:faded|ended|receded)\b",
        r"\b(?:his|her) thoughts returned\b",
        r"\bsnapped? (?:back )?(?:out of|to) (?:it|his|her)\b",
        r"\bpresent day\b",
    ), 0.5),
)
SCENE_BREAK = r"^\s*(?:\*\s*\*\s*\*|-{3,}|—{3,}|=+|~+|#+)\s*$"
OPTIONAL_KINDS = ("ENTER_DREAM", "EXIT_DREAM", "ENTER_VISION")
UNIVERSAL_KINDS = ("ENTER_FLASHBACK", "EXIT_FLASHBACK", "TIME_SKIP", "SCENE_BREAK")

# -- delivery ------------------------------------------------------------------------------------

#: How a line is delivered, by the words of its speech tag.
DELIVERY = {
    "FLAT": (
        "expressionless", "expressionlessly", "without any emotion", "without emotion", "emotionlessly", "emotionless", "indifferently",
        "indifferent", "flatly", "blandly", "impassively", "calmly", "placidly", "evenly", "dispassionately", "nonchalantly", "casually",
    ),
    "HEIGHTENED": (
        "shouted", "screamed", "shrieked", "roared", "bellowed", "yelled", "exclaimed", "burst out", "loudly", "furiously", "angrily",
        "excitedly", "urgently", "frantically",
    ),
    "HUSHED": ("whispered", "murmured", "muttered", "mumbled", "softly", "quietly", "under his breath", "under her breath", "in a low voice", "faintly"),
    "COLD": (
        "coldly", "icily", "sneered", "scoffed", "snorted", "mockingly", "sarcastically", "disdainfully", "contemptuously", "grimly", "darkly",
        "harshly", "sternly",
    ),
    "WARM": ("warmly", "gently", "kindly", "cheerfully", "happily", "laughed", "chuckled", "smiled", "smilingly"),
    "HESITANT": ("hesitantly", "hesitated", "stammered", "uncertainly", "nervously", "awkwardly", "reluctantly"),
}
QUOTED = "[“”\"‘’'][^“”\"]*?[“”\"]"

# -- crowds --------------------------------------------------------------------------------------

#: Roles of background crowds, and what comes before them.
MOB_ROLES = (
    "disciples", "guards", "elders", "soldiers", "servants", "cultivators", "students", "villagers", "citizens", "clansmen", "warriors",
    "monks", "nuns", "attendants", "subordinates", "followers", "retainers", "bandits", "spectators", "onlookers", "crowd", "mob",
    "troops", "enemies",
)
MOB_QUANTIFIER = r"(?:a|an|the|several|many|dozens of|hundreds of|thousands of|a group of|a crowd of|a bunch of|countless|numerous|surrounding)"
MOB = rf"\b{MOB_QUANTIFIER}\s+(?:surrounding\s+|nearby\s+)?(?:\w+\s+)?({'|'.join(MOB_ROLES)})\b"
MOB_SUBJECT = rf"\b({'|'.join(MOB_ROLES)})\s+surrounded\b"

# -- spans ---------------------------------------------------------------------------------------

#: Verbs of thought near a quoted run.
THOUGHT = (
    "thought", "mused", "pondered", "wondered", "reflected", "recalled", "realised|realized", "sighed inwardly", "sneered inwardly",
    "laughed inwardly", "cursed inwardly", "mumbled inwardly", "muttered inwardly", "said inwardly", "thought inwardly",
    "said in (?:his|her|their) heart", "cried in (?:his|her|their) heart", "sneered in (?:his|her|their) heart",
    "thought to (?:himself|herself|themselves)", "in (?:his|her|their) mind", "inwardly", "silently repeated",
)
#: Narration by what it tells.
EXPOSITION = (
    r"\b(?:it (?:is|was) said|legend|in this world|the world|generally|usually|always|never|those who|anyone who|whoever|"
    r"all .{0,20}(?:cultivators|beyonders|gu masters)|according to|as everyone knew|it was common knowledge|rumour had it|rumor had it|"
    r"in the past|for centuries|since ancient times)\b"
)
ACTION = (
    r"\b(?:walk(?:ed|s|ing)?|ran|run(?:s|ning)?|str(?:ode|ide)|step(?:ped)?|turn(?:ed)?|rais(?:ed|ing)|lower(?:ed)?|reach(?:ed)?|grabb?(?:ed)?|"
    r"seiz(?:ed)?|thrust|swung|struck|slash(?:ed)?|stabb(?:ed)?|leap(?:ed|t)?|jump(?:ed)?|fl(?:ew|ies)|land(?:ed)?|sat|stood|knelt|bow(?:ed)?|"
    r"nodd(?:ed)?|shook|smil(?:ed)?|frown(?:ed)?|glanc(?:ed)?|look(?:ed)?|star(?:ed)|point(?:ed)?|threw|caught|pull(?:ed)?|push(?:ed)?|drew|"
    r"lift(?:ed)?|placed|handed|struck)\b"
)
DESCRIPTION = (
    r"\b(?:was|were|appeared|seemed|looked like|resembled|stood|lay|hung|glowed|shimmer(?:ed)?|covered|filled|surrounded|shaped|coloured|colored)\b"
    r"|\b(?:tall|short|thin|thick|huge|massive|tiny|vast|ancient|crimson|azure|golden|silver|pale|dark|bright|jade|emerald)\b"
)
CROWD = (
    "^[\"“‘']?\\s*(?:(?:wh?at|huh|hmm?|eh|ah|oh|hey|no|yes|impossible|incredible|amazing|unbelievable|damn|heavens|gods?)\\b[^.?!]{0,40})"
    "[?!.…]*\\s*[\"”’']?$"
)
CROWD_MAX = 60

# -- names ---------------------------------------------------------------------------------------

#: What stands before and after names without being part of them.
HONORIFIC_PREFIXES = (
    "elder", "senior", "junior", "master", "grandmaster", "young master", "young miss", "lady", "lord", "sir", "miss", "mister", "mr",
    "mrs", "ms", "uncle", "aunt", "brother", "sister", "patriarch", "matriarch", "sect master", "peak lord", "hall master", "grand elder",
    "supreme elder", "first seat", "first elder",
)
HONORIFIC_SUFFIXES = ("-san", "-sama", "-kun", "-chan", "-senpai", "-shi", "-nim", "-ssi", "-ge", "-jie", "-di", "-mei")
#: Names, verbs of speech and of action around lines.
NAME = r"[A-Z][\w’'\-]*(?:\s+[A-Z][\w’'\-]*){0,3}"
SPEECH_VERBS = (
    "said|says|spoke|speaks|replied|replies|answered|answers|asked|asks|shouted|shouts|yelled|yells|screamed|screams|roared|roars|whispered|"
    "whispers|murmured|murmurs|muttered|mutters|mumbled|mumbles|called|calls|cried|cries|exclaimed|exclaims|declared|declares|continued|"
    "continues|added|adds|responded|responds|retorted|retorts|snapped|snaps|laughed|laughs|chuckled|chuckles|sighed|sighs|sneered|sneers|"
    "scoffed|scoffs|snorted|snorts|urged|urges|explained|explains|interrupted|interrupts|interjected|interjects|greeted|greets|repeated|"
    "repeats|stated|states|remarked|remarks|noted|notes|agreed|agrees|admitted|admits|confessed|confesses|warned|warns|ordered|orders|"
    "commanded|commands|announced|announces|hollered|instructed|instructs"
)
#: The verbs of speech that pronouns are resolved by.
TAG_VERBS = (
    "said|replied|answered|asked|shouted|yelled|screamed|roared|whispered|murmured|muttered|mumbled|called|cried|exclaimed|declared|continued|added|"
    "responded|retorted|snapped|laughed|chuckled|sighed|sneered|scoffed|snorted"
)
ACTION_VERBS = (
    "nodded|frowned|smiled|turned|looked|glanced|stepped|walked|raised|lowered|shook|bowed|paused|hesitated|sighed|stood|sat|leaned|gestured|"
    "pointed|waved|shrugged|blinked|stared|gazed|stretched"
)
ROLE_EPITHETS = ("clan head",)
#: Words before a noun, for the rate at which a surface is a common noun.
DETERMINERS = (
    "a|an|the|every|each|some|many|several|few|all|both|other|another|this|that|these|those|any|no|countless|numerous|various|certain|one|two|"
    "three|four|five|ten|dozens of|hundreds of|thousands of|his|her|their|its|my|your|our"
)
SCALE = (
    r"^(?:rank|stage|level|grade|tier|realm|sequence|step|layer|phase)\s*(?:[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten|first|second|"
    r"third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)$"
)
BARE_SCALE = r"^(?:rank|stage|level|grade|tier|realm|sequence)$"
CREDITS = (
    "translator", "translated", "editor", "edited", "proofreader", "proofread", "typesetter", "uploader", "raws", "raw provider", "tl note",
    "tln", "patreon", "ko-fi", "kofi", "discord", "webnovel", "wuxiaworld", "novelupdates", "sponsor", "chapter sponsor", "support us", "donate",
)
#: Nouns that name a role, and words that make of a phrase an epithet.
ROLE_NOUNS = (
    "man", "woman", "boy", "girl", "child", "elder", "youth", "stranger", "person", "people", "crowd", "guard", "soldier", "servant", "maid",
    "attendant", "merchant", "trader", "innkeeper", "shopkeeper", "clerk", "officer", "constable", "detective", "driver", "waiter", "landlord",
    "landlady", "priest", "monk", "nun", "doctor", "physician", "apothecary", "blacksmith", "farmer", "hunter", "fisherman", "beggar", "thief",
    "bandit", "disciple", "cultivator", "master", "student", "scholar", "official", "minister", "messenger", "courier", "captain", "sailor",
    "worker", "labourer", "laborer", "villager", "citizen",
)
EPITHET_WORDS = (
    "great|grand|dark|light|blood|iron|jade|golden|silver|crimson|azure|eternal|immortal|ancient|first|last|supreme|heavenly|demon|devil|ghost|"
    "sword|blade|flame|frost|thunder|storm|shadow|moon|sun|star"
)

# -- reference -----------------------------------------------------------------------------------

#: Fixed values: (surface, gender, number) of pronouns, cues of gender, words of kinship.
PRONOUNS = (
    ("he", "m", "sg"), ("him", "m", "sg"), ("his", "m", "sg"), ("himself", "m", "sg"), ("she", "f", "sg"), ("her", "f", "sg"), ("hers", "f", "sg"),
    ("herself", "f", "sg"), ("they", "n", "pl"), ("them", "n", "pl"), ("their", "n", "pl"), ("themselves", "n", "pl"), ("it", "n", "sg"), ("its", "n", "sg"),
)
MALE_CUES = r"\b(?:he|him|his|man|men|boy|father|brother|son|uncle|sir|lord|king|emperor|master|monk|priest|gentleman)\b"
FEMALE_CUES = r"\b(?:she|her|hers|woman|women|girl|mother|sister|daughter|aunt|lady|madam|queen|empress|miss|mistress)\b"
KINSHIP = ("uncle", "aunt", "grandfather", "grandmother", "grandpa", "grandma")
#: Fixed values: (kind, pattern with subject and object, confidence, event) of what happens to identities.
DETECTORS = (
    ("TRANSFER", rf"(?:({NAME})\s+)?(?:inherited the title|succeeded|took over as|was appointed|became the next|ascended to the position|passed the mantle|the new)\b(?:\s+({NAME}))?", 0.7, "rebind"),
    ("DECEPTION", rf"(?:({NAME})\s+)?(?:claimed to be|posing as|disguised as|pretending to be|under the guise of|assumed the identity of|impersonating|going by the name)(?:\s+({NAME}))?", 0.75, "link"),
    ("REVEAL", rf"(?:({NAME})\s+)?(?:was none other than|had always been|his true name was|her true name was|his real identity|her real identity|in truth,? (?:he|she) was|also known as|formerly called|turned out to be)(?:\s+({NAME}))?", 0.85, "merge"),
    ("DEATH", rf"({NAME})\s+(?:\w+\s+){{0,2}}?(?:died|perished|fell|was killed|was slain|breathed (?:his|her) last|passed away|met (?:his|her) end|was no more)\b", 0.7, "death"),
    ("RESURRECTION", rf"({NAME})\s+(?:\w+\s+){{0,2}}?(?:was reborn|returned from the dead|revived|resurrected|rose again|came back to life)\b", 0.7, "resurrection"),
    ("REPUTATION", rf"({NAME})(?:'s)?\s+(?:\w+\s+){{0,3}}?(?:name (?:was |had )?(?:spread|become known|resounded)|became (?:famous|renowned|known) (?:throughout|across|in)|reputation (?:spread|grew)|was now known (?:throughout|across))", 0.6, "reputation_spread"),
)

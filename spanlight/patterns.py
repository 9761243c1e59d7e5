"""Patterns and word lists of commercial speech in captions.

Everything here is a fixed value: results are defined by these patterns and lists. They apply
to normalised text (lower case, straight apostrophes, single spaces). `\\b`, `\\w`, `\\d` and
`\\s` mean ASCII; `java` gives the form for Spark.
"""

from __future__ import annotations

import re
from re import _parser

_TLD = "com|io|co|gg|net|org|app|tv|ai|me|dev|tech|store|shop|games|cloud|xyz|ly|link|site"
_CROWD = "you|all|everyone|everybody|viewers?|subscribers?|members?|fans?|audience|community|supporters?"
_THANKED = r"\b(?:thanks?\s+to|thank\s+you\s+to|thank)\s+(?!(?:" + _CROWD + r")\b).{1,60}?\s+for\s+support(?:ing)?\b"

# Disclosures that open a sponsor read without another cue.
STRONG_START = [
    r"\b(?:today'?s|this) (?:video|episode|show|podcast) (?:is )?(?:sponsored|brought to you)\b",
    r"\b(?:this (?:video|episode|show|podcast)|this) is (?:sponsored|brought to you) by\b",
    r"\bthis (?:part|portion|segment) of (?:this|the) (?:video|episode|show) is sponsored by\b",
    r"\b(?:sponsor|sponsorship|partner) (?:of|for) (?:today'?s|this) (?:video|episode|show|podcast)\b",
    r"\b(?:today['’]?s|this (?:video|episode|show|podcast)(?:['’]s|s)?) sponsor(?=\s+(?:is|has|can|will)\b|[,:])",
    r"\bthe sponsor for today is\b",
    r"\b(?:it is|it['’]?s) (?:the |this )?(?:video|episode|show|podcast)(?:['’]s|s)? sponsor\b",
    r"\b(?:before we (?:continue|begin|get started|keep going)|but first|real quick).{0,100}\b(?:sponsor|partner)\b",
    r"\bsupport for (?:this|the) (?:show|podcast|episode|video) comes from\b",
    r"\bpaid promotion\b",
    r"\bi (?:want|have|got|need) to (?:talk|tell you) about (?:(?:today'?s|this)(?: (?:video|episode|show)(?:'s|s)?)?) sponsor\b",
    r"\b(?:thanks?|thank you) to .{1,60} for sponsoring (?:today'?s|this|the|our) (?:video|episode|show|podcast)\b",
]

# Endorsements, and openings that need other evidence.
ENDORSEMENT_START = [r"\b(?:i|we) (?:really |absolutely |especially )?(?:like|love|use|recommend) (?:our|the) sponsor\b"]
CONTEXTUAL_START = [
    r"\b(?:a )?(?:quick|brief) (?:word|message) from\b",
    r"\bmade possible by\b",
    r"\b(?:in partnership with|partnered with|sponsored by|brought to you by|presented by)\b",
    r"\bbut before we (?:get|go|move|return) (?:to|back to) (?:that|it|the (?:story|video|scene|topic|case))\b",
    r"\b(?:our|some) friends at\b",
    r"\bthey reached out to (?:me|us)\b",
    r"\bwhen .{0,40} offered to sponsor\b",
    r"\b(?:today['’]?s|this (?:video|episode|show|podcast)(?:['’]s|s)?) sponsor$",
    _THANKED,
    *ENDORSEMENT_START,
]

# Talk that leads in to an endorsement.
LEAD_IN = [
    r"\bthere (?:is|was) (?:only )?(?:one|a) (?:small |tiny |minor )?problem\b",
    r"\bjust kidding\b",
    r"\b(?:one|another) (?:angle|part|aspect|piece|element|way) of\b",
    r"\b(?:is|are|can be|makes?) (?:a |an )?(?:great|good|excellent|convenient|easy|healthy) (?:option|choice|way)\b",
    r"\bif you['’]?re (?:the kind of (?:person|people)|someone who)\b",
    r"\bif you are (?:the kind of (?:person|people)|someone who)\b",
    r"\b(?:maybe|perhaps) (?:part of )?the reason\b",
    r"\b(?:that['’]?s|this is|which is) (?:exactly )?why\b",
    r"\b(?:it can be|it['’]?s|it is) (?:hard|tough|difficult|expensive|confusing|time-consuming) to\b",
    r"\b(?:all|so much) this talk about .{1,80}\breminded (?:me|us)\b",
    r"\b(?:my team and i|we|i) (?:have |['’]?ve )?(?:seen|noticed|experienced|faced) (?:a |an )?(?:massive |major |significant )?(?:increase|rise|problem|risk|challenge)\b",
    r"\b(?:making|which makes|that makes) (?:my|our|the) .{0,60} (?:harder|riskier|more difficult|less safe)\b",
    r"\bi (?:have |['’]?ve )?(?:actually )?almost (?:clicked|entered|shared|downloaded|fallen for)\b",
    r"\b(?:i am|i['’]?m|we are|we['’]?re) (?:trying|looking) to (?:find|figure out|get|choose|arrange|prepare)\b",
]
PRE_ROLL = [
    r"\b(?:before we (?:continue|begin|get started|keep going)|but first|real quick|quickly before)\b",
    r"\bbut before i\b",
]

# Own goods.
SELF_PROMOTION_START = [r"\bcan i (?:do|show|talk about) (?:the |my |our )?merch(?:andise)? now\b", r"\bmerch alert\b"]
SELF_PROMOTION = [
    r"\b(?:my|our) (?:merch|merchandise|store|shop|course|book|app|game|newsletter|patreon|website)\b",
    r"\bcan i (?:do|show|talk about) (?:the |my |our )?merch(?:andise)? now\b",
    r"\bmerch alert\b",
    r"\bsupport (?:this|the|my|our) channel\b",
    r"\bjoin (?:my|our) (?:discord|community|newsletter|patreon)\b",
    r"\bsupport (?:me|us|the channel) (?:on|through|by)\b",
    r"\b(?:buy|get|preorder) (?:my|our) (?:book|course|merch|game|app)\b",
    r"\bchannel membership\b",
    r"\bbecome a (?:member|patron)\b",
]

# The end of a read, and talk that starts after it has ended.
END = [
    r"\b(?:thanks?|thank you).{0,80}\bto (?:our|the|this) sponsor\b",
    r"\band thank you\s+(?!to\b)(?!(?:all|everyone|everybody|you all)\b).{1,60}?\s+for sponsoring (?:today['’]?s|this|the|our) (?:video|episode|show|podcast)\b",
    r"\bthank you again (?:to|for) sponsoring (?:this|the|our) (?:video|episode|show|podcast)\b",
    r"\b(?:now |and )?(?:let'?s|we can) (?:get |go )?back to (?:it|the|this|our)\b",
    r"\bback to (?:the|our|this) (?:video|story|show|episode|topic|podcast)\b",
    r"\b(?:with that|that'?s).{0,25}\bout of the way\b",
    r"\b(?:now|anyway),? (?:let'?s|we'?ll) (?:continue|move on|get started)\b",
    r"\b(?:and now|now),? back to\b",
    r"\b(?:okay|all right),? [a-z0-9_-]+,? (?:cool|great|nice) (?:app|service|product),? but\b",
]
END_BEFORE = [
    r"\b(?:but |and )?(?:thanks?|thank you)(?: (?:all|everyone|everybody|you all))?(?: so much)? for watching\b",
    r"\bbut (?:yeah,? )?i think that'?s about all i (?:have|had) to say\b",
    r"\bwith that (?:said|covered|done),? (?:let['’]?s|we can) (?:get |go )?back to\b",
    r"\bi think (?:the |our )?(?:contestants?|guests?|players?|participants?|judges?|hosts?|crew|team) (?:is|are)(?: now)? coming back\b",
    r"\b(?:thanks?|thank you) to (?!all\b|everyone\b|everybody\b|you all\b).{1,60}\b(?:so|now|anyway),? (?:how|why|what|when|where|who)\b",
]
FUZZY_END_GATE = r"\b(?:thank|thnk|back|bak|continu|cntinu|sponsor|suport|support|out)\w*"
FUZZY_START_PHRASES = [
    "this video is sponsored by",
    "this episode is sponsored by",
    "brought to you by",
    "support for this show comes from",
    "this portion of the video is sponsored by",
    "thanks to our sponsor",
]
FUZZY_END_PHRASES = ["thank you for sponsoring this video", "let's get back to it", "back to the video", "with that out of the way"]

# Signals by group.
SIGNALS = {
    "sponsor": [r"\b(?:sponsor|sponsored|sponsoring|sponsorship|partnered|partnership)\b", r"\bpaid promotion\b", _THANKED],
    "code": [
        r"\b(?:promo|promotional|discount|referral)\s?code\b",
        r"\buse (?:my|the) (?:promo |promotional |discount |referral )?code\b",
        r"\b(?:use|using|with) (?:my|our|the) (?:promo |promotional |discount |referral )?code\b",
    ],
    "offer": [
        r"\b\d{1,3}\s?(?:%|percent)\s?off\b",
        r"\$\d{1,4}\s?off\b",
        r"\b(?:special|exclusive|limited[- ]time) offer\b",
        r"\b(?:free|risk[- ]free) trial\b",
        r"\bfree (?:assessment|consultation|estimate|quote|evaluation|audit|analysis|demo|plan)\b",
        r"\b(?:full|complete) refund\b",
        r"\b(?:exclusive )?\d{1,3}\s?(?:%|percent) discount\b",
        r"\bmoney[- ]back guarantee\b",
        r"\bfirst \d+\s?(?:people|viewers|subscribers|orders|customers)\b",
        r"\b(?:save|get) \d{1,3}\s?(?:%|percent)\b",
        r"\b(?:try .{0,60} )?(?:completely )?for free for \d{1,3} (?:days?|weeks?|months?)\b",
    ],
    "url": [
        rf"\b[\w-]+\.(?:{_TLD})(?:\/[\w./-]+)?\b",
        rf"\b[\w-]+ dot (?:{_TLD})(?: slash [\w-]+)?\b",
        r"\blink in (?:the )?(?:description|bio|show notes)\b",
        r"\bclick (?:on )?the link below\b",
        r"\bqr code\b",
    ],
    "cta": [
        r"\b(?:go|head) (?:to|over to) (?:the )?(?:link|website|site|app|store|shop)\b",
        r"\b(?:use|follow|open) (?:the |my |our )?link in (?:the )?(?:description|bio|show notes)\b",
        r"\byou should check out\b",
        r"\b(?:do |please )?check out (?:the )?[a-z0-9-]+\b",
        r"\b(?:check|try) (?:it|them|the app|the link|[a-z0-9-]+) out\b",
        r"\brecommend (?:checking|trying) (?:it|them|the app|the service|[a-z0-9-]+) out\b",
        r"\b(?:sign up|subscribe|join|download|install) (?:now|today|for free|with|using)\b",
        r"\b(?:download|install)(?:ing)? (?:the |our |my )?(?:[a-z0-9-]+ )?(?:app|application)\b",
        r"\b(?:get|claim|start) (?:your|a) (?:free|first|trial|discount)\b",
        r"\bavailable (?:now |for free )?(?:on|for) (?:ios|android)\b",
        rf"\bvisit [a-z0-9-]+(?: dot |\.)?(?:{_TLD})?\b",
    ],
    "legal": [
        r"\bterms and conditions apply\b",
        r"\bmust be 21\+?\b",
        r"\b(?:if you (?:or someone you know )?have|for help with) (?:a )?gambling problem\b",
        r"\bplay responsibly\b",
        r"1-?800-?gambler",
        r"\bconsult (?:your|a) (?:doctor|physician)\b",
        r"\bno purchase necessary\b",
    ],
    "pitch": [
        r"\b(?:what|something else that) i (?:really |absolutely )?(?:love|like) about\b",
        r"\bi(?:'ve| have) been (?:using|trying|testing)\b",
        r"\b(?:helps?|lets?|allows?) you\b",
        r"\bhas helped (?:me|us)\b",
        r"\bhelps? (?:with|manage|solve|reduce|avoid)\b",
        r"\ball[- ]in[- ]one (?:solution|platform|suite)\b",
        r"\b(?:solution|platform|software|service) to (?:manage|organize|track|simplify|automate)\b",
        r"\bwithout (?:having to )?(?:switch|pay|spend|hire)\b",
        r"\bin (?:one|a single) (?:platform|place|app|system)\b",
        r"\bchoose (?:which|what|the) (?:apps?|features?|tools?|modules?)\b",
        r"\beasy to (?:manage|scale|use|set up|install|customize|integrate)\b",
        r"\bin one click\b",
        r"\bworks? with (?:android|ios)\b",
        r"\b(?:available|works?|plans?) in (?:more than |over )?\d+ (?:countries|regions)\b",
        r"\bno (?:advanced )?(?:programming|technical knowledge|experience) (?:is )?required\b",
        r"\b24\s*[/ -]?\s*7 (?:live |chat |customer )?support\b",
        r"\bdo you (?:feel|ever feel|struggle with|worry about)\b",
        r"\bimagine (?:being|becoming|having|getting|feeling)\b",
        r"\b(?:experts?|specialists?|professionals?) at\b",
        r"\b(?:personalized|customized|tailored) (?:plan|solution|approach|recommendation)\b",
        r"\bresults speak for themselves\b",
        r"\b(?:five|5)[- ]star reviews?\b",
        r"\bhelped (?:tens of |hundreds of )?thousands of (?:people|customers|clients|businesses)\b",
        r"\b(?:best|easiest|fastest) way to\b",
        r"\b(?:one|another) (?:great|useful|cool) (?:feature|thing)\b",
        r"\b(?:whether you|if you)'?re looking (?:for|to)\b",
        r"\bi (?:absolutely |really )?(?:love|like) (?:this|that|the) (?:feature|tool|service|app|product)\b",
        r"\bworks? by (?:scanning|checking|blocking|protecting|monitoring|encrypting|detecting|filtering)\b",
        r"\b(?:it|this|the (?:app|service|platform|tool|feature|product)) (?:will|can) (?:instantly |automatically )?(?:block|scan|check|protect|prevent|stop|detect|monitor|filter)\b",
        r"\bcertified by (?:independent|leading|trusted) .{0,50}(?:experts?|organizations?|labs?|auditors?)\b",
        r"\b(?:the )?(?:fastest|easiest|most [a-z-]+) .{0,40}\bout there\b",
    ],
    "affiliate": [
        r"\baffiliate link\b",
        r"\bi (?:may|might|will) (?:receive|earn|get) (?:a )?(?:commission|percentage)\b",
        r"\bat no (?:extra|additional) cost to you\b",
        r"\busing my (?:link|code) (?:helps|supports) (?:me|the channel|us)\b",
    ],
}
NEGATIVES = {
    "explicitNegation": [
        r"\b(?:not|isn'?t|wasn'?t|aren'?t|weren'?t) (?:a )?(?:sponsor|sponsored|sponsorship)\b",
        r"\bno sponsor(?:s|ship)?\b",
        r"\bwithout (?:a )?sponsor(?:s|ship)?\b",
        r"\bunsponsored\b",
    ],
    "exampleOrMeta": [
        r"\bexample (?:promo|promotional|discount|referral) code\b",
        r"\bthe concept of sponsorship\b",
        r"\b(?:talking|writing|video|story|report|article) about (?:ads|advertising|sponsors|sponsorships)\b",
        r"\bhow (?:promo|discount|referral) codes? work\b",
        r"""\bsay(?:ing)? ["']?(?:this video is )?sponsored by\b""",
        r"\bsponsored by .{1,60}\b(?:in|back in|during) (?:19|20)\d{2}\b",
        r"\b(?:in|back in|during) (?:19|20)\d{2}.{0,80}\bsponsor(?:ed|ship)?\b",
        r"\b(?:19|20)\d{2}.{0,80}\b(?:was |were )?sponsored by\b",
        r"\b(?:last year|previously|formerly|at the time|back then).{0,80}\bsponsor(?:ed|ship)?\b",
        r"\b(?:phrase|sentence|line|caption|example|script).{0,40}\bsponsored by\b",
        r"\buse code [a-z0-9_-]{2,20} (?:in|as|inside|within|for) (?:the )?(?:config(?:uration)?|source|example|sample|snippet|program|script|file|settings?)\b",
    ],
    "productDiscussion": [
        r"\b(?:honest|independent|unsponsored) review\b",
        r"\b(?:reviewing|comparing|testing) (?:the|this|these)\b",
        r"\b(?:scam|suspicious|malicious|fake) (?:link|url|website|promo code)\b",
        r"\b(?:tutorial|lesson|example) (?:about|on|for)\b",
        r"\b(?:news|report) (?:about|on)\b",
    ],
}

# Weights of the groups, and the groups that seldom err.
WEIGHTS = {"sponsor": 3, "code": 5, "offer": 4, "url": 5, "cta": 2, "legal": 7, "pitch": 1, "affiliate": 4, "brand": 3}
NEGATIVE_WEIGHTS = {"explicitNegation": 12, "exampleOrMeta": 6, "productDiscussion": 3}
PRECISE = ("code", "offer", "url", "legal")
START_BONUS, END_BONUS = 12, 4

# Promo codes, on the original text; domain roots; named brands.
CODE_LABELLED = r"(?i)\b(?:promo|promotional|discount|referral)\s+code(?:\s+(?:is|:))?\s+([a-z0-9_-]{3,20})\b"
CODE_OWNED = r"(?i)\buse\s+(?:my|the)\s+(?:promo\s+|promotional\s+|discount\s+|referral\s+)?code(?:\s+(?:is|:))?\s+([a-z0-9_-]{3,20})\b"
CODE_UPPER = r"\b[Uu]se\s+[Cc]ode\s+([A-Z0-9_-]{3,20})\b"
CODE_PLAIN = r"\buse\s+code\s+([a-z0-9_-]{3,20})\b"
OFFER_CONTEXT = r"\b(?:\d{1,3}\s?(?:%|percent)\s?off|discount|special offer|save \d{1,3})\b"
DOMAIN_ROOT = rf"\b([a-z0-9-]{{3,}})\s*(?:\.| dot )(?:{_TLD})\b"
NAMED_BRAND = [
    r"\b(?:sponsored|sponsoring|presented|supported|brought to you) by\s+([a-z][a-z0-9_-]{2,})\b",
    r"\b(?:thanks?\s+to|thank\s+you\s+to|thank)\s+([a-z][a-z0-9_-]{2,})\s+for\s+support(?:ing)?\b",
    r"\b(?:sponsor (?:is|today is)|friends at|partnered with|in partnership with)\s+([a-z][a-z0-9_-]{2,})\b",
    r"\b(?:go|head) (?:to|over to)\s+([a-z][a-z0-9_-]{2,})\b",
]
CAPITALISED = r"\b[A-Z][A-Za-z0-9-]{3,}\b"
TOKEN = r"[a-z][a-z0-9-]{2,}"

# Words that carry no topic, commercial words, and words that are no brand.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further get getting go going had has have having he her here
hers herself him himself his how i if in into is it its itself just let like may me more most my myself no nor not now
of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs
them themselves then there these they this those through to too under until up very was we were what when where which
while who whom why will with would you your yours yourself yourselves
""".split()
COMMERCIAL_WORDS = """
sponsor sponsored sponsoring sponsorship partner partnership promo promotional code discount offer link description bio
trial free percent sale website app download install signup sign subscribe today video episode channel support
supporting thanks thank use using click check visit
""".split()
NO_BRANDS = [
    *STOP_WORDS,
    *COMMERCIAL_WORDS,
    *"""
com www http https people thing things way first best great really also even much make example tutorial lesson review
fake independent course newsletter member membership merch merchandise store shop community patreon book
""".split(),
]

_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java(pattern: str) -> str:
    """For Java, whose `\\b` knows letters beyond ASCII."""
    return pattern.replace(r"\b", _BOUNDARY)


def either(patterns: list[str]) -> str:
    return "|".join(f"(?:{java(p)})" for p in patterns)


def _needed(tree) -> frozenset[str] | None:
    """Words of which every match of a parsed pattern holds one: of all such sets the one with the longest words, stop words last."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _parser.LITERAL and chr(arg).isalnum():
            run += chr(arg)
            continue
        if run:
            found.append(frozenset((run,)))
            run = ""
        inner = None
        if op is _parser.SUBPATTERN:
            inner = _needed(arg[3])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
            inner = _needed(arg[2])
        elif op is _parser.BRANCH and all(parts := [_needed(x) for x in arg[1]]):
            inner = frozenset().union(*parts)
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(0 if w in STOP_WORDS else len(w) for w in x), -len(x)), default=None)


def gate(patterns: list[str]) -> str:
    """One cheap pattern that every text matches that one of the given ones matches.

    It asks for words without which a pattern cannot match. A word never crosses a space, so
    texts joined by spaces pass only if one of them does.
    """
    words, whole = set(), []
    for p in patterns:
        need = _needed(_parser.parse(p))
        if need and min(map(len, need)) >= 3:
            words |= need
        elif re.search(r" |\\s|\.\{|\[\^", p):
            raise ValueError(f"no word tells whether this can match: {p}")
        else:  # the match itself holds no space
            whole.append(p.replace(r"\b", ""))
    words = sorted(w for w in words if not any(v != w and v in w for v in words))
    return "|".join([*words, *whole])


def re2(patterns: list[str], text: str) -> str:
    """DuckDB SQL that is true where one of the patterns matches the column.

    RE2 has no look-around: an ahead-match is consumed, and an exclusion becomes a second match.
    """
    q = lambda p: "'" + p.replace("'", "''") + "'"
    plain, special = [], []
    for p in patterns:
        if "(?!" in p:
            bare, excluded = p, []
            while "(?!" in bare:
                at = bare.index("(?!")
                depth, k = 0, at
                while True:
                    depth += {"(": 1, ")": -1}.get(bare[k], 0)
                    k += 1
                    if depth == 0:
                        break
                excluded.append(bare[:at] + "(?:" + bare[at + 3 : k - 1] + ")")
                bare = bare[:at] + bare[k:]
            special.append(f"(regexp_matches({text}, {q(bare)})" + "".join(f" AND NOT regexp_matches({text}, {q(x)})" for x in excluded) + ")")
        else:
            plain.append(p.replace("(?=", "(?:"))
    parts = [f"regexp_matches({text}, {q('|'.join(f'(?:{p})' for p in plain))})"] if plain else []
    return "(" + " OR ".join(parts + special) + ")"


#: What any text must match to have a signal, a flag or a negative group.
GATE = gate([*STRONG_START, *CONTEXTUAL_START, *SELF_PROMOTION_START, *SELF_PROMOTION, *END, *END_BEFORE, *(p for ps in (*SIGNALS.values(), *NEGATIVES.values()) for p in ps)])

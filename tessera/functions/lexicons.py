"""Word lists, patterns and limits that results depend on."""

from __future__ import annotations

SUMMARY_WHAT_MIN = 5
SUMMARY_WHY_MIN = 15
SUMMARY_SCOPE_MAX = 100
SUMMARY_MAX = 280
PREVIEW_MAX = 400

WHAT_STOPLIST = [
    "thing", "things", "data", "stuff", "item", "items", "entity", "object", "value",
    "this", "that", "these", "those", "it",
    "the project", "the system", "the entity", "the memory", "the data", "the file", "the thing", "a thing", "an entity", "a project", "a system",
    "todo", "tbd", "n/a", "none", "null", "placeholder", "fixme", "xxx",
]

CONTENT_TYPE_KEYWORDS = {
    "fact": [
        "code", "python", "function", "api", "database", "server", "deploy", "git", "test", "architecture", "design", "pattern", "structure",
        "schema", "interface", "module", "component", "service",
    ],
    "event": [
        "plan", "roadmap", "milestone", "deadline", "sprint", "backlog", "scope", "requirement", "spec", "decided", "chose", "picked",
        "switched", "migrated", "replaced",
    ],
    "discovery": [
        "bug", "error", "problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved", "debug", "refactor",
    ],
    "preference": ["prefer", "like", "dislike", "favorite", "always", "never", "style", "convention"],
    "advice": ["trade-off", "alternative", "option", "approach", "priority", "recommendation", "suggestion", "best practice"],
}

MARKERS = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b",
        r"\bi'?m going (to|with)\b", r"\bbetter (to|than|approach|option|choice)\b", r"\binstead of\b", r"\brather than\b",
        r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b", r"\bpros and cons\b", r"\bover\b.*\bbecause\b",
        r"\barchitecture\b", r"\bapproach\b", r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b", r"\binfrastructure\b",
        r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ],
    "preference": [
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b",
        r"\bi like (to|when|how)\b", r"\bi hate (when|how|it when)\b", r"\bplease (always|never|don'?t)\b",
        r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b", r"\bfunctional\b.*\bstyle\b", r"\bimperative\b",
        r"\bsnake_?case\b", r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ],
    "milestone": [
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b",
        r"\bnailed it\b", r"\bcracked (it|the)\b", r"\bfinally\b", r"\bfirst time\b", r"\bfirst ever\b", r"\bnever (done|been|had) before\b",
        r"\bdiscovered\b", r"\brealized\b", r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b",
        r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b", r"\bcreated\b", r"\bimplemented\b", r"\bshipped\b",
        r"\blaunched\b", r"\bdeployed\b", r"\breleased\b", r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b", r"\bversion \d",
        r"\bv\d+\.\d+", r"\d+x (compression|faster|slower|better|improvement|reduction)", r"\d+% (reduction|improvement|faster|better|smaller)",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b",
        r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b", r"\bthe (problem|issue|bug) (is|was)\b",
        r"\bturns out\b.*\b(was|because|due to)\b", r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b",
        r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b", r"\bpatched\b", r"\bthe answer (is|was)\b",
        r"\b(had|need) to\b.*\binstead\b",
    ],
    "emotional": [
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b",
        r"\bsorry\b", r"\bgrateful\b", r"\bangry\b", r"\bworried\b", r"\blonely\b", r"\bbeautiful\b", r"\bamazing\b", r"\bwonderful\b",
        r"i feel", r"i'm scared", r"i love you", r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone",
        r"nobody knows", r"\*[^*]+\*",
    ],
}

POSITIVE_WORDS = [
    "pride", "proud", "joy", "happy", "love", "loving", "beautiful", "amazing", "wonderful", "incredible", "fantastic", "brilliant", "perfect",
    "excited", "thrilled", "grateful", "warm", "breakthrough", "success", "works", "working", "solved", "fixed", "nailed", "heart", "hug",
    "precious", "adore",
]
NEGATIVE_WORDS = [
    "bug", "error", "crash", "crashing", "crashed", "fail", "failed", "failing", "failure", "broken", "broke", "breaking", "breaks", "issue",
    "problem", "wrong", "stuck", "blocked", "unable", "impossible", "missing", "terrible", "horrible", "awful", "worse", "worst", "panic",
    "disaster", "mess",
]
RESOLUTION_PATTERNS = [
    r"\bfixed\b", r"\bsolved\b", r"\bresolved\b", r"\bpatched\b", r"\bgot it working\b", r"\bit works\b", r"\bnailed it\b",
    r"\bfigured (it )?out\b", r"\bthe (fix|answer|solution)\b",
]
CODE_LINE_PATTERNS = [
    r"^\s*[\$#]\s",
    r"^\s*(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s",
    r"^\s*```",
    r"^\s*(import|from|def|class|function|const|let|var|return)\s",
    r"^\s*[A-Z_]{2,}=",
    r"^\s*\|",
    r"^\s*[-]{2,}",
    r"^\s*[{}\[\]]\s*$",
    r"^\s*(if|for|while|try|except|elif|else:)\b",
    r"^\s*\w+\.\w+\(",
    r"^\s*\w+ = \w+\.\w+",
]
PROMPT_STOPWORDS = [
    "the", "and", "for", "with", "you", "but", "not", "are", "was", "this", "that", "from", "have", "has", "had", "what", "when", "why", "how",
    "who", "which", "does", "did", "can", "could", "should", "would", "there", "where", "about", "their", "they", "your", "our", "ours", "one",
    "two", "all", "any",
]
QUERY_STOPWORDS = [
    "what", "when", "where", "who", "how", "which", "did", "do", "was", "were", "have", "has", "had", "is", "are", "the", "a", "an", "my", "me",
    "i", "you", "your", "their", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "from", "ago", "last", "that", "this", "there",
    "about", "get", "got", "give", "gave", "buy", "bought", "made", "make", "said",
]
NOT_NAMES = [
    "What", "When", "Where", "Who", "How", "Which", "Did", "Do", "Was", "Were", "Have", "Has", "Had", "Is", "Are", "The", "My", "Our", "Their",
    "Can", "Could", "Would", "Should", "Will", "Shall", "May", "Might", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday",
    "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "In", "On",
    "At", "For", "To", "Of", "With", "By", "From", "And", "But", "I", "It", "Its", "This", "That", "These", "Those", "Previously", "Recently", "Also",
    "Just", "Very", "More",
]
#: (pattern, days or * and days for each unit of the number, tolerance in days), the first that matches counts.
RELATIVE_DATES = [
    (r"(\d+)\s+days?\s+ago", "*1", 2),
    (r"a\s+couple\s+(?:of\s+)?days?\s+ago", "2", 2),
    (r"yesterday", "1", 1),
    (r"a\s+week\s+ago", "7", 3),
    (r"(\d+)\s+weeks?\s+ago", "*7", 5),
    (r"last\s+week", "7", 3),
    (r"a\s+month\s+ago", "30", 7),
    (r"(\d+)\s+months?\s+ago", "*30", 10),
    (r"last\s+month", "30", 7),
    (r"last\s+year", "365", 30),
    (r"a\s+year\s+ago", "365", 30),
    (r"recently", "14", 14),
]
ASSISTANT_REFERENCES = [
    "you suggested", "you told me", "you mentioned", "you said", "you recommended", "remind me what you", "you provided", "you listed",
    "you gave me", "you described", "what did you", "you came up with", "you helped me", "you explained", "can you remind me", "you identified",
]
PREFERENCE_PATTERNS = [
    r"i(?:'ve been| have been) having (?:trouble|issues?|problems?) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) feeling ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:struggling|dealing) with ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i(?:'m| am) (?:worried|concerned) about ([^,\.!?]{5,80})",
    r"i prefer ([^,\.!?]{5,60})",
    r"i usually ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:trying|attempting) to ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:considering|thinking about) ([^,\.!?]{5,80})",
    r"lately[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"recently[,\s]+(?:i've been|i have been|i'm|i am) ([^,\.!?]{5,80})",
    r"i(?:'ve been| have been) (?:working on|focused on|interested in) ([^,\.!?]{5,80})",
    r"i want to ([^,\.!?]{5,60})",
    r"i(?:'m| am) looking (?:to|for) ([^,\.!?]{5,60})",
    r"i(?:'m| am) thinking (?:about|of) ([^,\.!?]{5,60})",
    r"i(?:'ve been| have been) (?:noticing|experiencing) ([^,\.!?]{5,80})",
    r"i (?:still )?remember (?:the |my )?([^,\.!?]{5,80})",
    r"i used to ([^,\.!?]{5,60})",
    r"when i was (?:in high school|in college|young|a kid|growing up)[,\s]+([^,\.!?]{5,80})",
    r"growing up[,\s]+([^,\.!?]{5,80})",
    # the group around the whole of this pattern is added here, as the first group is what is extracted
    r"((?:happy|fond|good|positive) (?:high school|college|childhood|school) (?:experience|memory|memories|time)[^,\.!?]{0,60})",
]

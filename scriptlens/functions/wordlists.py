"""Fixed values that must equal the behaviour being re-created.

Everything in this module is data, not logic: word lists, the show registry and
alias table, the dimension letters and regex character classes shared by the
Spark expressions and the DuckDB oracle SQL.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop words (the public NLTK English list, 179 entries,
# in its published order).
# ---------------------------------------------------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't",
    "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan",
    "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't",
    "won", "won't", "wouldn", "wouldn't",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: character names removed from search tokens (as listed, with
# the repeat of "Wolowitz"; compared lower-case).
# ---------------------------------------------------------------------------
SEARCH_NAMES = [
    "Sheldon", "Cooper", "Leonard", "Hofstadter", "Penny", "Howard",
    "Wolowitz", "Rajesh", "Koothrappali",
    "Amy", "Farrah", "Fowler", "Bernadette", "Rostenkowski", "Wolowitz",
    "Rachel", "Green", "Monica", "Geller", "Phoebe", "Buffay", "Ross",
    "Chandler", "Bing", "Joey", "Tribbiani",
    "Jay", "Pritchett", "Gloria", "Delgado", "Phil", "Dunphy", "Claire",
    "Mitchell", "Cameron", "Lily", "Manny",
    "Jerry", "Seinfeld", "George", "Costanza", "Elaine", "Benes", "Kramer",
    "Michael", "Scott", "Dwight", "Schrute", "Jim", "Halpert", "Pam",
    "Beesly", "Kevin", "Malone", "Stanley", "Hudson", "Kelly", "Kapoor",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: character names removed by the classifier normalisers (as
# listed, repeats included; compared lower-case against whitespace tokens).
# ---------------------------------------------------------------------------
CLASSIFIER_NAMES = [
    "Sheldon", "Cooper",
    "Leonard", "Hofstadter",
    "Penny", "Hofstadter",
    "Howard", "Wolowitz",
    "Rajesh", "Koothrappali",
    "Amy", "Farrah", "Fowler",
    "Bernadette", "Rostenkowski", "Wolowitz",
    "Rachel", "Green",
    "Monica", "Geller",
    "Phoebe", "Buffay",
    "Ross", "Geller",
    "Chandler", "Bing",
    "Joey", "Tribbiani",
    "Jay", "Pritchett",
    "Gloria", "Pritchett",
    "Manny", "Delgado",
    "Joe", "Pritchett",
    "Phil", "Dunphy",
    "Claire", "Dunphy",
    "Haley", "Dunphy",
    "Alex", "Dunphy",
    "Luke", "Dunphy",
    "Mitchell", "Pritchett",
    "Cameron", "Tucker",
    "Lily", "Tucker", "Pritchett",
    "Jerry", "Seinfeld",
    "George", "Costanza",
    "Elaine", "Benes",
    "Cosmo", "Kramer",
    "Michael", "Scott",
    "Dwight", "Schrute",
    "Jim", "Halpert",
    "Pam", "Beesly",
    "Ryan", "Howard",
    "Kelly", "Kapoor",
    "Angela", "Martin",
    "Oscar", "Martinez",
    "Kevin", "Malone",
    "Stanley", "Hudson",
    "Phyllis", "Vance",
    "Meredith", "Palmer",
    "Creed", "Bratton",
    "Toby", "Flenderson",
    "Darryl", "Philbin",
    "Andy", "Bernard",
    "Erin", "Hannon",
    "Robert", "California",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: the sixteen four-letter personality type words (lower-case).
# ---------------------------------------------------------------------------
TYPE_WORDS = [
    "infp", "infj", "intp", "intj", "entp", "enfp", "istp", "isfp",
    "entj", "istj", "enfj", "isfj", "estp", "esfp", "esfj", "estj",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: the four binary axes; letter for label 1, letter for label 0.
# ---------------------------------------------------------------------------
DIMENSIONS = [
    ("EI", "E", "I"),
    ("SN", "S", "N"),
    ("TF", "T", "F"),
    ("JP", "J", "P"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: show registry (key -> display name) and aliases (typed name ->
# key). One canonical key per show: "the_office" (search used "office").
# ---------------------------------------------------------------------------
SHOW_NAMES = {
    "friends": "Friends",
    "modern_family": "Modern Family",
    "seinfeld": "Seinfeld",
    "tbbt": "The Big Bang Theory",
    "the_office": "The Office (US)",
}

SHOW_ALIASES = {
    "friends": "friends",
    "friend": "friends",
    "modern family": "modern_family",
    "modern_family": "modern_family",
    "mf": "modern_family",
    "seinfeld": "seinfeld",
    "tbbt": "tbbt",
    "the big bang theory": "tbbt",
    "big bang theory": "tbbt",
    "the office": "the_office",
    "office": "the_office",
    "the_office": "the_office",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: defaults of the search and analysis commands.
# ---------------------------------------------------------------------------
DEFAULT_TOP_K = 5
DEFAULT_TITLE_WEIGHT = 2
DEFAULT_PERSONALITY_LIMIT = 10
DEFAULT_SNIPPET_CHARS = 240
QUOTE_DISPLAY_CHARS = 200
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
# fixed values: the words that stand for sentence marks in baseline text
SENTENCE_MARKS = ((".", "EOSTokenDot"), ("?", "EOSTokenQuest"), ("!", "EOSTokenExs"))
TFIDF_MAX_FEATURES = 1500
NB_ALPHA = 1.0
CV_FOLDS = 3
HEAD_EPOCHS = 10
HEAD_PATIENCE = 3
MAX_INPUT_TOKENS = 500
MIN_STYLE_LINES = 120
STYLE_EXAMPLES = 5
HIGHLIGHT_OPEN = "\x1b[1;33m"
HIGHLIGHT_CLOSE = "\x1b[0m"

# ---------------------------------------------------------------------------
# Regex character classes valid in both Java regex (Spark) and RE2 (DuckDB).
# WS is Python's str.isspace() set, WORD is Python's str-pattern \w.
# ---------------------------------------------------------------------------
WS_CHARS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + WS_CHARS + "]"
NOT_WS = "[^" + WS_CHARS + "]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = "[" + WORD_CHARS + "]"
NOT_WORD = "[^" + WORD_CHARS + "]"


def lower_distinct(words):
    """Lower-case, de-duplicated, order of first appearance kept."""
    return list(dict.fromkeys(w.lower() for w in words))

"""Constants, formats and patterns that results depend on.

Everything in this file is data.  Values under "Fixed values" must stay as they
are for ids, filters and rankings to agree with corpora built earlier; values
under "Defaults" are only defaults of function parameters.
"""

# --- Fixed values -----------------------------------------------------------

# The characters Python's str.strip()/str.split() treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for use inside a [...] class of a Java or RE2 pattern.
WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NBSP = "\xa0"
ELLIPSIS = "…"

# Characters that form keywords; any run of other characters separates words.
WORD_CHARS = "a-zа-яіїєґ0-9"
MIN_KEYWORD_LEN = 4
MAX_ORDERED_KEYWORDS = 12

# Identity: hex digits of the content hash and of the document id.
CONTENT_HASH_LEN = 10
DOC_ID_LEN = 16

# Noise rule: shortest useful text, most bars / pluses / bar-space-bar runs.
NOISE_MIN_CHARS = 60
NOISE_MAX_BARS = 25
NOISE_MAX_PLUSES = 25
NOISE_MAX_EMPTY_CELLS = 10

# Page line rule: shortest line, most bars / pluses in a line.
LINE_MIN_CHARS = 2
LINE_MAX_BARS = 10
LINE_MAX_PLUSES = 10
# Main text shorter than this falls back to the whole visible text.
MAIN_TEXT_MIN_CHARS = 200
PAGE_MIN_CHARS = 500

# Sentences not longer than this do not enter a summary.
SUMMARY_MIN_SENTENCE = 20
SUMMARY_SNIP = 220
SNIP = 320
TABLE_SNIP = 180
ANSWER_SNIP = 1200

# Answer assembly.
BULLET_RANKS = 5
BULLET_MAX = 3
BULLET_MIN_CHARS = 30
CONTEXT_MAX_CHARS = 6500
CONTEXT_MAX_CHUNKS = 6
FEEDBACK_SOURCES = 10

# Channel handles, message keys, permalinks and titles.
LINK_PREFIXES = ("https://t.me/", "http://t.me/", "t.me/")
PERMALINK_PREFIX = "https://t.me/"
MESSAGE_KEY_PREFIX = "tg:"
MESSAGE_TITLE_PREFIX = "Telegram: "

# --- Defaults ---------------------------------------------------------------

CHUNK_SIZE = 900
CHUNK_OVERLAP = 120
MESSAGE_CHUNK_SIZE = 600
MESSAGE_CHUNK_OVERLAP = 80
MESSAGE_LIMIT = 200
SYNC_MESSAGE_LIMIT = 300
SINCE_DAYS = 120

TOP_K = 5
MIN_SCORE = 0.35
INTERNAL_K_MIN = 30
INTERNAL_K_FACTOR = 8
RERANK_TOP_N = 30
SCORE_DIGITS = 6

DEFAULT_TITLE = "document"
SOURCE_FALLBACK_TITLE = "source"
UNKNOWN_TYPE = "unknown"
MEDIA_PLACEHOLDER = "[media post without text]"
SOURCES_LABEL = "sources"
NO_SOURCES_TEXT = "nothing cited"
# How a model admits that it cannot answer; the first one is what prompts ask for.
NO_DATA_PHRASES = ("the passages do not say", "passages leave this open", "no passage answers")
VERDICTS = ("good", "bad_answer", "bad_retrieval", "no_answer")


def internal_k(top_k: int = TOP_K) -> int:
    """Candidates fetched before the post-filters run."""
    return max(INTERNAL_K_MIN, INTERNAL_K_FACTOR * top_k)

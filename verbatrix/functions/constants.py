"""Values that results depend on."""

# Words that carry no topic, in natural order.
STOP_WORDS = (
    "a an and are at be been but by can could did do does for from had has have he her him his i in is it its may me "
    "might my no not of on or our shall she should that the their them these they this those to us was we were will "
    "with would you your 一个 不 与 也 了 从 他们 你们 及 和 在 就 我们 或 把 是 没有 的 着 而 被 这个 这些 那个 那些 都"
).split()

# Suffixes that stemming takes off, the first that fits.
SUFFIXES = "ation ition ment ness less able ible al ial ful ous ings ions ents ing ion ent ive ize ise ly ed es er est s".split()

# Phrases of page furniture, in natural order.
NOISE_PHRASES = [
    "about us",
    "advertisement",
    "all rights reserved",
    "breadcrumb",
    "click here",
    "contact us",
    "cookie",
    "copyright",
    "facebook",
    "follow us",
    "in this article",
    "instagram",
    "linkedin",
    "loading",
    "log in",
    "log out",
    "menu",
    "navigation",
    "newsletter",
    "on this page",
    "please enable javascript",
    "privacy policy",
    "read more",
    "related articles",
    "search...",
    "share this",
    "sign in",
    "sign up",
    "skip to content",
    "sponsored",
    "subscribe",
    "table of contents",
    "terms of service",
    "tweet",
    "you may also like",
]

# What is trimmed from both ends of a token.
TOKEN_TRIM = ".,;:!?\"'()[]{}<>「」『』【】《》、，。！？；："

# Where the main content of a page may be, the first that is long enough.
CONTENT_SELECTORS = ["main", "article", "[role=main]", ".post-content", ".entry-content", ".article-content", ".content", "#content", "#main-content"]

# Character sets that mis-decoded text is tried in, in order.
REPAIR_CODECS = ["gbk", "hz", "big5", "cp932", "euc_jp", "cp949", "latin-1", "cp1252"]

#: All characters with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Fixed values of scoring.
K1, B = 1.5, 0.75
PAGE_DOCS, PAGE_DF, PAGE_LENGTH = 10, 1, 200
STEM_BONUS, WORD_BONUS, BIGRAM_BONUS = 0.3, 0.3, 0.5
POSITION_BONUS, CODE_BONUS, NOISE_PENALTY = 0.2, 0.1, 0.3

# Fixed values of limits and budgets.
MIN_SENTENCE, MIN_CLEAN = 10, 15
MIN_LIMIT, MAX_LIMIT, LIMIT_STEP = 2000, 64000, 1000
MIN_RESULTS, MAX_RESULTS, DEFAULT_RESULTS = 5, 50, 10
SEARCH_LIMIT, TOP_BUDGET, REST_BUDGET = 2000, 3000, 1500
MIN_REGION = 200
NO_SNIPPET = "(no description available)"
SEPARATOR = "\n\n---\n\n"

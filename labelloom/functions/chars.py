"""Regular-expression classes for the JVM engine that behave like Unicode text classes.

Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII by default and its Unicode mode puts
combining marks into ``\\w``; both would corrupt Devanagari. All values here are fixed.
"""

# Whitespace, including the four separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]"
NON_SPACE = r"(?U)[^\s\x1c-\x1f]"

# Word characters: letters, numbers, underscore; combining marks are not included.
WORD = r"[\p{L}\p{N}_]"
WORD_WITH_MARKS = r"[\p{L}\p{N}_\x{0900}-\x{097F}]"

# Runs of word characters or anything of the Devanagari block (danda included).
TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
TOKEN_WITHOUT_DANDA = r"[\p{L}\p{N}_\x{0900}-\x{0963}\x{0966}-\x{097F}]+"

# The common default of vectorizers: two or more word characters, marks split words.
PLAIN_TOKEN = r"[\p{L}\p{N}_]{2,}"

HTTP_URL = r"https?://" + NON_SPACE + "+"
WWW_URL = r"www\." + NON_SPACE + "+"
MENTION = "@" + WORD + "+"
MENTION_WITH_MARKS = "@" + WORD_WITH_MARKS + "+"
HASHTAG = "#(" + WORD + "+)"
SPACE_RUN = SPACE + "+"

LATIN = r"[A-Za-z]"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
DECIMAL_DIGIT = r"\p{Nd}"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
BLANK = r"\A" + SPACE + r"*\z"

# Decimal digits plus superscripts, circled digits and the like.
ANY_DIGIT = (
    r"[\p{Nd}\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)

# Noise audit: name -> pattern, in report order.
NOISE = {
    "http_url": HTTP_URL,
    "www_url": WWW_URL,
    "mention": MENTION,
    "hashtag": HASHTAG,
    "latin": LATIN,
    "digit": DECIMAL_DIGIT,
    "emoji": EMOJI,
    "blank": BLANK,
}

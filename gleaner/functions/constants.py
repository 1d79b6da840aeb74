"""Fixed values.

These lists, edges, labels and patterns decide the results and are therefore stated as they are.
"""

# Right-closed band edges and their labels (the last label is open-ended).
PLAYTIME_EDGES = [29, 119, 599, 1499, 2999, 5999]
PLAYTIME_LABELS = ["<30m", "30m-1h59m", "2h-9h59m", "10h-24h59m", "25h-49h59m", "50h-99h59m", "100h+"]
REVIEWER_EDGES = [0, 1, 4, 9]
REVIEWER_LABELS = ["0", "1", "2-4", "5-9", "10+"]
LIBRARY_EDGES = [9, 49, 99, 499]
LIBRARY_LABELS = ["0-9", "10-49", "50-99", "100-499", "500+"]
WORDS_EDGES = [9, 49, 99, 249]
WORDS_LABELS = ["0-9", "10-49", "50-99", "100-249", "250+"]

# Spellings of booleans in landed text, compared after trimming and lower-casing.
TRUE_WORDS = ["true", "1", "yes", "t"]
FALSE_WORDS = ["false", "0", "no", "f"]

# Spellings of a missing string.
BLANK_STRINGS = ["", "nan", "None"]
BLANK_LANGUAGES = ["", "nan"]

# The emotion categories, in report order.
EMOTIONS = [
    "positive", "joy", "anticipation", "trust", "surprise",
    "negative", "fear", "sadness", "anger", "disgust",
]

# The segments of every by-polarity report.
SEGMENTS = ["overall", "positive", "negative"]

# Code points of Unicode whitespace, the four ASCII separators included.
WHITESPACE_POINTS = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(map(chr, WHITESPACE_POINTS))
# A run of them, by which words are counted. The engine's own Unicode class lacks the four separators. Runs of anything else
# give the same words, but matched in turn with the tokens of the same texts they cost several times as much.
GAP_PATTERN = r"(?U)[\s\x1c-\x1f]++"

# A token is word characters, with apostrophes and hyphens allowed inside. Possessive repeats, as no shorter match is
# ever wanted; the plain ASCII ranges first, as they are tested fastest.
_WORD = r"a-z0-9_\p{L}\p{N}"
# Digits, super- and subscript and circled digits included.
_DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
# Tokens made only of digits are passed over.
TOKEN_PATTERN = rf"(?![{_DIGIT}]++['-]*+(?![{_WORD}]))[{_WORD}]++(?:['-]++[{_WORD}]++)*+"

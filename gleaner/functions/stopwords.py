"""Stop words per language. The token filters take any list; these are the defaults."""

# Stop words per language label, the domain words ("game", "juego", ...) last.

# Theme matching keeps the domain words, everything else drops them.
ENGLISH_WITHOUT_DOMAIN_WORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "than", "to", "of", "in", "on", "at", "for", "from", "with",
    "without", "by", "is", "are", "was", "were", "be", "been", "being", "it", "its", "this", "that", "these", "those",
    "as", "i", "you", "he", "she", "we", "they", "them", "my", "your", "his", "her", "our", "their", "me", "him",
    "us", "do", "does", "did", "not", "no", "yes", "so", "very", "just", "can", "could", "would", "should", "will",
    "really",
]

_SPANISH = [
    "el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "pero", "si", "de", "del", "al", "en", "por",
    "para", "con", "sin", "es", "son", "fue", "eran", "ser", "ha", "han", "que", "como", "muy", "más", "menos", "yo",
    "tú", "tu", "él", "ella", "nos", "nosotros", "ellos", "ellas", "mi", "mis", "su", "sus", "me", "te", "se", "lo",
    "le", "les", "ya", "no", "sí", "juego", "juegos",
]

_RUSSIAN = [
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да",
    "ты", "к", "у", "же", "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от", "меня", "еще", "нет",
    "о", "из", "ему", "теперь", "когда", "даже", "ну", "вдруг", "ли", "если", "или", "ни", "быть", "был", "него",
    "до", "вас", "игра", "игры",
]

_GERMAN = [
    "der", "die", "das", "ein", "eine", "und", "oder", "aber", "wenn", "dann", "zu", "von", "in", "im", "am", "für",
    "mit", "ohne", "ist", "sind", "war", "waren", "sein", "ich", "du", "er", "sie", "wir", "ihr", "mein", "dein",
    "unser", "nicht", "ja", "so", "sehr", "nur", "spiel", "spiele",
]

_FRENCH = [
    "le", "la", "les", "un", "une", "des", "et", "ou", "mais", "si", "de", "du", "dans", "sur", "à", "au", "aux",
    "pour", "avec", "sans", "est", "sont", "était", "être", "je", "tu", "il", "elle", "nous", "vous", "ils", "elles",
    "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses", "pas", "oui", "très", "plus", "jeu", "jeux",
]

_PORTUGUESE = [
    "o", "a", "os", "as", "um", "uma", "uns", "umas", "e", "ou", "mas", "se", "de", "do", "da", "dos", "das", "em",
    "no", "na", "por", "para", "com", "sem", "é", "são", "foi", "ser", "eu", "tu", "ele", "ela", "nós", "vocês",
    "eles", "elas", "meu", "minha", "seu", "sua", "não", "sim", "muito", "mais", "jogo", "jogos",
]

_ITALIAN = [
    "il", "lo", "la", "i", "gli", "le", "un", "una", "e", "o", "ma", "se", "di", "del", "della", "in", "nel", "sul",
    "per", "con", "senza", "è", "sono", "era", "essere", "io", "tu", "lui", "lei", "noi", "voi", "loro", "mio", "mia",
    "tuo", "tua", "suo", "sua", "non", "sì", "molto", "più", "gioco", "giochi",
]

STOPWORDS = {
    "english": ENGLISH_WITHOUT_DOMAIN_WORDS + ["game", "games"],
    "spanish": _SPANISH,
    "russian": _RUSSIAN,
    "german": _GERMAN,
    "french": _FRENCH,
    "portuguese": _PORTUGUESE,
    "brazilian": _PORTUGUESE,
    "italian": _ITALIAN,
}

# The word-frequency report uses a German list without "unser".
WORD_CLOUD_STOPWORDS = {**STOPWORDS, "german": [w for w in STOPWORDS["german"] if w != "unser"]}

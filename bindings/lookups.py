"""Small lookups for the invented vocabulary of the documents."""

from __future__ import annotations

# Word -> emotions; `zzzz` never occurs.
LEXICON = {
    "th": ["positive", "trust"], "er": ["negative", "fear"], "nd": ["joy"], "ha": ["joy", "positive"],
    "re": ["anger", "negative"], "rewh": ["surprise"], "es": ["sadness"], "orre": ["anticipation", "positive"],
    "thatin": ["disgust"], "zzzz": ["joy"],
}

# Theme -> terms, with a shared word, phrases, a phrase broken by stop words and a theme without hits.
THEMES = {
    "alpha": ["th", "er", "orre"],
    "beta": ["th", "orre orre", "anea eriner"],
    "gamma": ["of the"],
    "delta": ["ha"],
    "empty": ["zzzz"],
}

# Stop words of the document languages.
STOPS = {
    "english": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "french": ["de", "la", "le", "que"],
    "german": ["der", "die", "und"],
    "spanish": ["de", "la", "en", "el"],
}

LEXICON_PAIRS = [(w, e) for w, emotions in LEXICON.items() for e in emotions]

"""Tokenising and n-grams as native expressions; texts never leave the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X

Stopwords = Mapping[str, Sequence[str]] | Sequence[str] | None


def _is_stopword(stopwords: Stopwords, language: str) -> str:
    """SQL test of token `t`: against one list, or against the list of the row's language. Spark turns the literal
    lists into hash sets, so the test costs one lookup per token."""
    if not stopwords:
        return "false"
    if not isinstance(stopwords, Mapping):
        return f"t in ({X.sql_list(stopwords)})"
    whens = " ".join(f"when {X.sql_string(lang)} then t in ({X.sql_list(words)})" for lang, words in stopwords.items())
    return f"case {language} {whens} else false end"


def tokens(text: str, stopwords: Stopwords = None, min_length: int = 2, language: str = "language") -> Column:
    """Lower-cased tokens in text order, without all-digit tokens, short tokens and stop words."""
    found = f"regexp_extract_all(lower(`{text}`), {X.sql_string(K.TOKEN_PATTERN)}, 0)"
    stop = _is_stopword(stopwords, f"lower(`{language}`)")
    return F.expr(f"filter({found}, t -> char_length(t) >= {int(min_length)} and not {stop})")


def ngrams(tokens_column: str, n: int) -> Column:
    """Space-joined n-grams in order; empty when there are fewer than `n` tokens."""
    t = F.col(tokens_column)
    if n == 1:
        return t
    grams = F.transform(
        F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")
    )
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

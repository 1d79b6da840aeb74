"""Emotion profile of reviews from a word lexicon `(word, emotion)`."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X
from gleaner.functions.durable import durable
from gleaner.functions.lookups import SMALL_ROWS, constant_lookup, rows_if_small
from gleaner.functions.stopwords import STOPWORDS
from gleaner.operators import categories as C
from gleaner.operators.text import text_subset

TOKENS, MATCHES = "token_count_for_emotion_analysis", "emotion_token_count"


def emotion_subset(
    df: DataFrame, target: str = "english", min_length: int = 2, remove_stopwords: bool = True
) -> DataFrame:
    """Reviews of the target language with at least one token; the English stop words apply."""
    return text_subset(df, min_length, STOPWORDS["english"] if remove_stopwords else None, target, token_count=TOKENS)


def enrich_with_emotions(text: DataFrame, lexicon: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Matched tokens, and hits and hits per 100 tokens for each emotion. Rows need no id.

    A lexicon of up to `limit` words becomes a constant lookup table inside a projection: no join, no shuffle. A larger one is
    joined with the tokens. The result is the same.
    """
    lexicon = lexicon.filter(F.col("emotion").isin(K.EMOTIONS))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, e in enumerate(K.EMOTIONS) for x in (e, 1 << i)]), F.col("emotion"))
    words = lexicon.groupBy("word").agg(F.bit_or(bit).alias("bits"))
    rows = rows_if_small(words.select("word", "bits"), limit)
    counted = _count_by_join(text, words) if rows is None else _count_in_place(text, {r.word: r.bits for r in rows})
    return counted.withColumns({f"{e}_per_100_tokens": C.rate(e, TOKENS) for e in K.EMOTIONS})


#: A token is frequent if it makes up this share of all tokens, so there are at most as many as its inverse.
FREQUENT = 0.001


def _has(emotion: str) -> Callable[[Column], Column]:
    return lambda bits: bits.bitwiseAND(1 << K.EMOTIONS.index(emotion)) != 0


def _count_in_place(text: DataFrame, bits: Mapping[str, int]) -> DataFrame:
    found = F.filter(F.transform("tokens", constant_lookup(bits, "int")), lambda b: b.isNotNull())
    return text.withColumn("__bits", found).withColumns({
        MATCHES: F.size("__bits").cast("bigint"),
        **{f"{e}_count": F.size(F.filter("__bits", _has(e))).cast("bigint") for e in K.EMOTIONS},
    }).drop("__bits")


def _count_by_join(text: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens leave their row with its number, meet the lexicon, and their counts come back to it.

    Frequent tokens, a thousand at most, meet their entries by a broadcast of these. All others meet the lexicon by shuffle,
    where no token has more than a thousandth of the rows.
    """
    rows = durable(text.withColumn("__row", F.monotonically_increasing_id()))
    tokens = rows.select("__row", F.explode("tokens").alias("word"))
    counts = durable(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter(F.col("n") >= max(1, FREQUENT * total)).select("word")
    known = durable(frequent.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("known")))
    marked = tokens.join(F.broadcast(known), "word", "left")
    rare = marked.filter("known is null").select("__row", "word").join(words, "word").select("__row", "bits")
    both = marked.filter("known > 0").select("__row", F.col("known").alias("bits")).unionByName(rare)
    counts_per_row = both.groupBy("__row").agg(
        F.count(F.lit(1)).alias(MATCHES), *[F.count_if(_has(e)(F.col("bits"))).alias(f"{e}_count") for e in K.EMOTIONS]
    )
    new = [MATCHES, *[f"{e}_count" for e in K.EMOTIONS]]
    return rows.join(counts_per_row, "__row", "left").fillna(0, new).drop("__row").select(*text.columns, *new)


def emotion_overview(
    cleaned: DataFrame, enriched: DataFrame, target: str = "english", keys: Sequence[str] = ()
) -> DataFrame:
    return C.overview(
        cleaned, enriched, keys, K.EMOTIONS, target, TOKENS, MATCHES, "emotion", "total_emotion_token_matches"
    )


def emotion_distribution(enriched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return C.distribution(enriched, keys, K.EMOTIONS, TOKENS, MATCHES, "emotion")


def emotion_by_polarity(enriched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return C.by_polarity(enriched, keys, K.EMOTIONS, TOKENS, MATCHES)


def emotion_by_band(enriched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows without a band are left out."""
    banded = enriched.filter(F.col("playtime_at_review_band").isNotNull())
    return C.by_group(banded, [*keys, "playtime_at_review_band"], K.EMOTIONS, TOKENS, MATCHES)


def emotion_by_month(enriched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return C.by_group(enriched, [*keys, "review_created_year_month"], K.EMOTIONS, TOKENS, MATCHES)


def emotion_top_terms(text: DataFrame, lexicon: DataFrame, n: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent words of each emotion, per 1000 hits of the emotion before the cut.

    Tokens are counted first, so the lexicon meets a vocabulary and not a corpus.
    """
    lexicon = lexicon.filter(F.col("emotion").isin(K.EMOTIONS)).select(F.col("word").alias("token"), "emotion").distinct()
    counts = text.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(
        F.count(F.lit(1)).alias("frequency")
    )
    hits = counts.join(lexicon, "token")
    group = [*keys, "emotion"]
    totals = hits.groupBy(*group).agg(F.sum("frequency").alias("__total"))
    top = X.top_ranked(hits, group, n, F.desc("frequency"), F.asc("token"))
    relative = X.per_thousand(F.col("frequency"), F.col("__total")).alias("relative_frequency_per_1000_emotion_hits")
    return X.attach(top, totals, group, ["__total"]).select(*group, "rank", "token", "frequency", relative)

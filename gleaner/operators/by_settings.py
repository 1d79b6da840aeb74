"""Text tables of many products in one job, each with its own settings: parameters are columns joined by product.

A settings table has one row per product. A product without a row, and a setting that a row leaves out, have the defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.functions import tokens as TK
from gleaner.functions.stopwords import STOPWORDS
from gleaner.operators import text
from gleaner.sources.tables import Settings

PRODUCT = "app_id"
#: Settings by the part of a product's configuration that holds them, with their types.
PARTS = {
    "text_metrics": {
        "min_reviews_per_language": "bigint", "min_share_per_language": "double", "top_n_unigrams": "bigint",
        "top_n_bigrams": "bigint", "top_n_trigrams": "bigint", "min_token_length": "bigint", "remove_stopwords": "boolean",
    },
    "emotion_metrics": {"target_language": "string", "top_n_emotion_terms": "bigint"},
    "theme_metrics": {"count_multiple_hits_per_theme": "boolean"},
}
NAMES = [name for part in PARTS.values() for name in part]


def parse_settings(df: DataFrame, column: str = "value", key: str = PRODUCT) -> DataFrame:
    """Configurations as JSON text to one row per product with a column per setting; what is missing or unreadable is the default."""
    schema = ", ".join(f"{part} struct<{', '.join(f'{n}: {t}' for n, t in names.items())}>" for part, names in PARTS.items())
    parsed = df.select(key, F.from_json(column, schema).alias("c"))
    return parsed.select(key, *[_or_default(n, F.col(f"c.{part}.{n}")) for part, names in PARTS.items() for n in names])


def _or_default(name: str, value: Column) -> Column:
    given = F.lower(X.strip(value)) if name == "target_language" else value
    return F.coalesce(given, F.lit(getattr(Settings(), name))).alias(name)


def with_settings(df: DataFrame, settings: DataFrame, names: Sequence[str], key: str = PRODUCT) -> DataFrame:
    """Each row with the named settings of its product, as columns that begin with two underscores."""
    chosen = settings.select(key, *[F.col(n).alias(f"__{n}") for n in names])
    joined = X.join_on(df, chosen, [key])
    return joined.withColumns({f"__{n}": _or_default(n, F.col(f"__{n}")) for n in names})


def corpus(
    df: DataFrame, settings: DataFrame, stopwords: TK.Stopwords = STOPWORDS, language: bool = False, key: str = PRODUCT
) -> DataFrame:
    """Tokenised texts by each product's token length and stop-word choice; with `language` only of its target language.

    A text is tokenised once, in the case of one expression that its product asks for.
    """
    own = with_settings(df, settings, ["min_token_length", "remove_stopwords", "target_language"], key)
    if language:
        own = own.filter(X.or_unknown(F.col("language")) == F.col("__target_language"))
    known = own.filter(F.col("review").isNotNull()).withColumns({"language": X.or_unknown(F.col("language")), "review": X.strip(F.col("review"))})
    made = F.when(F.col("__remove_stopwords"), TK.tokens("review", stopwords, 1)).otherwise(TK.tokens("review", None, 1))
    rows = known.filter(F.col("review") != "").select("*", F.explode(F.array(made)).alias("__made"))
    rows = rows.withColumn("tokens", F.filter("__made", lambda t: F.char_length(t) >= F.col("__min_token_length")))
    return rows.filter(F.size("tokens") > 0).withColumn("token_count", F.size("tokens").cast("bigint")).select(*df.columns, "tokens", "token_count")


def of_selected_languages(corpus: DataFrame, settings: DataFrame, key: str = PRODUCT) -> DataFrame:
    """The texts in languages that have enough reviews, or a large enough share, by their product's own bounds."""
    languages = with_settings(text.language_shares(corpus, [key]), settings, ["min_reviews_per_language", "min_share_per_language"], key)
    chosen = languages.filter(text.enough(F.col("__min_reviews_per_language"), F.col("__min_share_per_language")))
    return text.in_chosen(corpus, chosen.select(key, "language"), nulls=True)


def frequency_table(
    counts: DataFrame, settings: DataFrame, limit: str, label: str = "token", segment: str = "overall",
    keys: Sequence[str] = (), key: str = PRODUCT,
) -> DataFrame:
    """`text.frequency_table` per product, as many rows of each as its setting `limit` says.

    The largest limit of all products cuts the ranks before the shuffle; the product's own one cuts them after it.
    """
    most = settings.agg(F.max(limit)).first()[0]  # one number
    table = text.frequency_table(counts, max(most or 0, getattr(Settings(), limit)), label, segment, [key, *keys])
    return with_settings(table, settings, [limit], key).filter(F.col("rank") <= F.col(f"__{limit}")).drop(f"__{limit}")

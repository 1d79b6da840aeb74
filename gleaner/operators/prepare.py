"""Raw reviews to the cleaned 61-column table.

Everything up to the dedup is a narrow projection: one scan, no shuffle, whole-stage code. The dedup is the only
shuffle of the chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X
from gleaner.sources import schema as S


# ---------------------------------------------------------------- normalisation

def ensure_columns(df: DataFrame) -> DataFrame:
    """Add the raw columns that are missing, as typed nulls."""
    missing = [c for c in S.RAW_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(S.raw_type(c)) for c in missing}) if missing else df


def normalise_strings(df: DataFrame, columns: Sequence[str] = S.STRING_COLUMNS) -> DataFrame:
    return df.withColumns({c: X.normal_string(F.col(c)) for c in columns})


def normalise_numbers(df: DataFrame, columns: Sequence[str] = S.LONG_COLUMNS) -> DataFrame:
    kept = dict(df.dtypes)
    return df.withColumns({
        c: F.col(c).cast("bigint") if kept[c] in ("tinyint", "smallint", "int", "bigint") else X.lenient_long(F.col(c))
        for c in columns
    })


def normalise_booleans(df: DataFrame, columns: Sequence[str] = S.BOOLEAN_COLUMNS) -> DataFrame:
    kept = dict(df.dtypes)
    return df.withColumns({
        c: F.col(c) if kept[c] == "boolean" else X.normal_boolean(F.col(c)) for c in columns
    })


def lost_values(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(column, filled, lost)`: values of numeric and boolean columns, and how many of them the casts turn into nulls."""
    casts = {c: X.lenient_long(F.col(c)) for c in S.LONG_COLUMNS} | {c: X.normal_boolean(F.col(c)) for c in S.BOOLEAN_COLUMNS}
    filled = {c: X.normal_string(F.col(c)).isNotNull() for c in casts}
    one = df.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(filled[c]).alias("filled"), F.count_if(filled[c] & cast.isNull()).alias("lost"))
        for c, cast in casts.items()
    ]).alias("rows"))
    return one.select(*keys, F.inline("rows"))


def normalise_language(df: DataFrame) -> DataFrame:
    return df.withColumn("language", X.normal_language(F.col("language")))


def normalise_text(df: DataFrame) -> DataFrame:
    return df.withColumn("review", X.clean_text(F.col("review")))


# ---------------------------------------------------------------- derived columns

# Unix-second column -> (timestamp column, date column)
TIMES = {
    "timestamp_created": ("review_created_datetime_utc", "review_created_date"),
    "timestamp_updated": ("review_updated_datetime_utc", "review_updated_date"),
    "last_played": ("last_played_datetime_utc", "last_played_date"),
    "timestamp_dev_responded": ("developer_responded_datetime_utc", "developer_responded_date"),
}


def add_times(df: DataFrame) -> DataFrame:
    """Unix seconds to timestamps, dates, and the year and month of creation. The session zone must be UTC."""
    out = df.withColumns({ts: F.timestamp_seconds(F.col(seconds)) for seconds, (ts, _) in TIMES.items()})
    created = F.col("review_created_datetime_utc")
    return out.withColumns({
        **{day: X.day_label(F.col(ts)) for ts, day in TIMES.values()},
        "review_created_year": F.year(created).cast("bigint"),
        "review_created_month": F.month(created).cast("bigint"),
        "review_created_year_month": X.month_label(created),
    })


def add_lengths(df: DataFrame) -> DataFrame:
    """Characters, characters without whitespace, words and lines. Only the lines of a missing text are null."""
    text = F.coalesce(F.col("review"), F.lit(""))
    return df.withColumns({
        "review_length_chars": F.length(text).cast("bigint"),
        "review_length_chars_no_spaces": F.length(F.translate(text, K.WHITESPACE, "")).cast("bigint"),
        "review_length_words": X.word_count(text),
        "review_length_lines": (F.regexp_count(F.col("review"), F.lit("\n")) + 1).cast("bigint"),
    })


def _above_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)) > 0


def add_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_positive": F.col("voted_up"),
        "is_negative": ~F.col("voted_up"),
        "has_text_review": F.col("review").isNotNull(),
        "has_developer_response": F.col("developer_response").isNotNull(),
        "has_comments": _above_zero("comment_count"),
        "has_helpful_votes": _above_zero("votes_up"),
        "has_funny_votes": _above_zero("votes_funny"),
        "is_steam_purchase": F.col("steam_purchase"),
        "is_free_copy": F.col("received_for_free"),
        "is_early_access_review": F.col("written_during_early_access"),
        "is_primarily_steam_deck": F.col("primarily_steam_deck"),
    })


def add_playtime(df: DataFrame) -> DataFrame:
    """Play-time after the review and play flags; a flag with a missing input stays null."""
    after = F.col("playtime_forever") - F.col("playtime_at_review")
    return df.withColumns({
        "playtime_post_review": F.when(after >= 0, after),
        "played_after_review": F.col("playtime_forever") > F.col("playtime_at_review"),
        "review_updated_after_creation": F.col("timestamp_updated") > F.col("timestamp_created"),
        "used_steam_deck_at_review": F.col("deck_playtime_at_review") > 0,
        "recent_playtime_recorded": F.col("playtime_last_two_weeks") > 0,
    })


def add_intervals(df: DataFrame) -> DataFrame:
    """Days from creation to update, last play and response, to three places; negative intervals are kept."""
    def days(end: str) -> Column:
        return F.round((F.col(end) - F.col("timestamp_created")) / 86400, 3)

    return df.withColumns({
        "days_between_creation_and_update": days("timestamp_updated"),
        "days_between_review_and_last_played": days("last_played"),
        "days_to_developer_response": days("timestamp_dev_responded"),
    })


def add_bands(df: DataFrame) -> DataFrame:
    """Bands of play-time, reviewer activity, library size and word count, for the columns that exist."""
    bands = {
        "playtime_at_review": (K.PLAYTIME_EDGES, K.PLAYTIME_LABELS),
        "num_reviews": (K.REVIEWER_EDGES, K.REVIEWER_LABELS),
        "num_games_owned": (K.LIBRARY_EDGES, K.LIBRARY_LABELS),
        "review_length_words": (K.WORDS_EDGES, K.WORDS_LABELS),
    }
    return df.withColumns({
        f"{c}_band": X.band(F.col(c), edges, labels) for c, (edges, labels) in bands.items() if c in df.columns
    })


def add_periods(df: DataFrame) -> DataFrame:
    """Day, week and month of creation, month of update and month of response, for the columns that exist."""
    created = F.col("review_created_datetime_utc")
    periods = {}
    if "review_created_datetime_utc" in df.columns:
        periods["review_created_date_day"] = X.day_label(created)
        periods["review_created_date_week"] = X.week_label(created)
        periods["review_created_date_month"] = X.month_label(created)
    if "review_updated_datetime_utc" in df.columns:
        periods["review_updated_date_month"] = X.month_label(F.col("review_updated_datetime_utc"))
    if "developer_responded_datetime_utc" in df.columns:
        periods["developer_responded_date_month"] = X.month_label(F.col("developer_responded_datetime_utc"))
    return df.withColumns(periods)


def add_product(df: DataFrame, app_id: int, slug: str, title: str) -> DataFrame:
    """Product columns for a one-product table; tables of many products carry their own."""
    return df.withColumns({"app_id": F.lit(app_id).cast("bigint"), "game_slug": F.lit(slug), "game_title": F.lit(title)})


# ---------------------------------------------------------------- dedup and the whole chain

def keep_first(
    df: DataFrame, ids: Sequence[str], order: Sequence[str], drop_null_ids: bool = True
) -> DataFrame:
    """The first row per id in the given order.

    The filter on the row number is pushed below the shuffle as a group limit, so every map task sends at most one row
    per id: an id that fills a third of the table costs its reducer one row per map task.
    """
    if drop_null_ids:
        for c in ids:
            df = df.filter(F.col(c).isNotNull())
    w = Window.partitionBy(*ids).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).filter(F.col("__row") == 1).drop("__row")


def normalise(df: DataFrame) -> DataFrame:
    df = normalise_strings(ensure_columns(df))
    df = normalise_booleans(normalise_numbers(df))
    return normalise_text(normalise_language(df))


def derive(df: DataFrame) -> DataFrame:
    """All derived columns of a normalised table."""
    return add_intervals(add_playtime(add_flags(add_lengths(add_times(df)))))


def prepare_reviews(
    df: DataFrame,
    product: tuple[int, str, str] | None = None,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("seq",),
    drop_null_ids: bool = True,
) -> DataFrame:
    """Landed rows to the cleaned table: normalise, dedup by id keeping the first in `order`, derive, fix the order.

    The dedup runs before the derived columns are added, so the shuffle carries the narrow row.
    """
    df = normalise(df)
    if product is not None:
        df = add_product(df, *product)
    df = derive(keep_first(df, [*keys, "recommendationid"], order, drop_null_ids))
    return in_order(df)


def in_order(df: DataFrame) -> DataFrame:
    """The fixed columns first, unknown ones after them."""
    fixed = [c for c in S.CLEANED_COLUMNS if c in df.columns]
    return df.select(*fixed, *[c for c in df.columns if c not in S.CLEANED_COLUMNS])

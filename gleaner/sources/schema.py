"""Column lists and types of the landed and the cleaned review table."""

from __future__ import annotations

from pyspark.sql import types as T

# The landed columns by type.
STRING_COLUMNS = [
    "recommendationid", "steamid", "language", "review", "weighted_vote_score", "developer_response",
]
LONG_COLUMNS = [
    "num_games_owned", "num_reviews", "playtime_forever", "playtime_last_two_weeks", "playtime_at_review",
    "deck_playtime_at_review", "last_played", "timestamp_created", "timestamp_updated", "votes_up", "votes_funny",
    "comment_count", "timestamp_dev_responded",
]
BOOLEAN_COLUMNS = [
    "voted_up", "steam_purchase", "received_for_free", "written_during_early_access", "primarily_steam_deck",
]

# The landed review row, in order.
RAW_COLUMNS = [
    "recommendationid", "steamid", "num_games_owned", "num_reviews", "playtime_forever", "playtime_last_two_weeks",
    "playtime_at_review", "deck_playtime_at_review", "last_played", "language", "review", "timestamp_created",
    "timestamp_updated", "voted_up", "votes_up", "votes_funny", "weighted_vote_score", "comment_count",
    "steam_purchase", "received_for_free", "written_during_early_access", "developer_response",
    "timestamp_dev_responded", "primarily_steam_deck",
]

# Fields of a landed review that sit in its nested author.
AUTHOR_COLUMNS = [
    "steamid", "num_games_owned", "num_reviews", "playtime_forever", "playtime_last_two_weeks",
    "playtime_at_review", "deck_playtime_at_review", "last_played",
]

# The cleaned review row, in order.
CLEANED_COLUMNS = [
    "app_id", "game_slug", "game_title", "recommendationid", "steamid", "language", "review",
    "is_positive", "is_negative", "voted_up", "steam_purchase", "received_for_free", "written_during_early_access",
    "primarily_steam_deck", "is_steam_purchase", "is_free_copy", "is_early_access_review", "is_primarily_steam_deck",
    "has_text_review", "has_developer_response", "has_comments", "has_helpful_votes", "has_funny_votes",
    "num_games_owned", "num_reviews", "playtime_forever", "playtime_last_two_weeks", "playtime_at_review",
    "deck_playtime_at_review", "playtime_post_review", "played_after_review", "used_steam_deck_at_review",
    "recent_playtime_recorded", "last_played", "timestamp_created", "timestamp_updated", "timestamp_dev_responded",
    "review_created_datetime_utc", "review_updated_datetime_utc", "last_played_datetime_utc",
    "developer_responded_datetime_utc", "review_created_date", "review_updated_date", "last_played_date",
    "developer_responded_date", "review_created_year", "review_created_month", "review_created_year_month",
    "days_between_creation_and_update", "days_between_review_and_last_played", "days_to_developer_response",
    "review_updated_after_creation", "review_length_chars", "review_length_chars_no_spaces", "review_length_words",
    "review_length_lines", "votes_up", "votes_funny", "weighted_vote_score", "comment_count", "developer_response",
]


def raw_type(column: str) -> T.DataType:
    if column in LONG_COLUMNS:
        return T.LongType()
    if column in BOOLEAN_COLUMNS:
        return T.BooleanType()
    return T.StringType()


def raw_schema(as_text: bool = False) -> T.StructType:
    """The landed row; `as_text` reads every column as a string, for files whose spelling is not trusted."""
    return T.StructType([T.StructField(c, T.StringType() if as_text else raw_type(c)) for c in RAW_COLUMNS])


def page_schema() -> T.StructType:
    """One landed page. Leaves are strings so that a single odd value never empties a whole record."""
    text = T.StringType()
    author = T.StructType([T.StructField(c, text) for c in AUTHOR_COLUMNS])
    own = [T.StructField(c, text) for c in RAW_COLUMNS if c not in AUTHOR_COLUMNS]
    review = T.StructType([*own, T.StructField("author", author)])
    summary = T.StructType([T.StructField("num_reviews", T.LongType()), T.StructField("total_reviews", T.LongType())])
    return T.StructType([
        T.StructField("success", T.IntegerType()),
        T.StructField("cursor", text),
        T.StructField("query_summary", summary),
        T.StructField("reviews", T.ArrayType(review)),
    ])

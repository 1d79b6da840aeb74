"""Descriptive tables of a cleaned review table. Every function takes leading `keys` (for example the product)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.operators import profile as P

# The variables of each summary, in report order.
PROFILE_VARIABLES = ["num_games_owned", "num_reviews"]
PLAYTIME_VARIABLES = [
    "playtime_forever", "playtime_last_two_weeks", "playtime_at_review", "deck_playtime_at_review",
    "playtime_post_review",
]
INTERACTION_VARIABLES = ["votes_up", "votes_funny", "comment_count"]
TEXT_VARIABLES = [
    "review_length_chars", "review_length_chars_no_spaces", "review_length_words", "review_length_lines",
]
INTERVAL_VARIABLES = [
    "days_between_creation_and_update", "days_between_review_and_last_played", "days_to_developer_response",
]
CONCENTRATION_VARIABLES = ["votes_up", "votes_funny", "comment_count", "playtime_forever", "review_length_words"]

# Reported metric -> flag column.
ACCESS_FLAGS = {
    "steam_purchase_true": "is_steam_purchase",
    "free_copy_true": "is_free_copy",
    "early_access_review_true": "is_early_access_review",
    "primarily_steam_deck_true": "is_primarily_steam_deck",
    "developer_response_true": "has_developer_response",
    "played_after_review_true": "played_after_review",
    "review_updated_after_creation_true": "review_updated_after_creation",
    "recent_playtime_recorded_true": "recent_playtime_recorded",
    "used_steam_deck_at_review_true": "used_steam_deck_at_review",
}


def _context(df: DataFrame) -> dict:
    """Product columns present in the table; constant per product, so any value of the group is the value."""
    return {c: F.any_value(c, ignoreNulls=True) for c in ("app_id", "game_slug", "game_title") if c in df.columns}


def dataset_overview(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    context = {k: v for k, v in _context(df).items() if k not in keys}
    counts = {
        "total_reviews": F.count(F.lit(1)),
        "unique_recommendation_ids": F.count_distinct("recommendationid"),
        "unique_reviewers": F.count_distinct("steamid"),
        "reviews_with_text": F.count_if("has_text_review"),
        "languages_detected": F.count_distinct("language"),
    }
    one = df.groupBy(*keys).agg(*[c.alias(n) for n, c in {**context, **counts}.items()])
    return X.metric_rows(one, keys, {n: F.col(n) for n in [*context, *counts]})


def polarity_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_positive").alias("pos"), F.count_if("is_negative").alias("neg")
    )
    n, pos, neg = F.col("n"), F.col("pos"), F.col("neg")
    return X.metric_rows(one, keys, {
        "total_reviews": n,
        "positive_reviews": pos,
        "negative_reviews": neg,
        "positive_percentage": X.pct(pos, n),
        "negative_percentage": X.pct(neg, n),
        "positive_negative_ratio": X.ratio(pos, neg),
    })


def language_distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*keys, X.or_unknown(F.col("language")).alias("language")).agg(
        F.count(F.lit(1)).alias("review_count")
    )
    total = F.sum("review_count").over(X.over_keys(keys))
    return counts.withColumn("review_percentage", X.pct(F.col("review_count"), total)).orderBy(
        *keys, F.desc("review_count"), "language"
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Fifteen statistics per column, rounded to four places."""
    marks = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
    stats = P.numeric_profile(df, keys, columns, list(marks.values()))

    def r(name: str, alias: str | None = None):
        return F.round(F.col(name), 4).alias(alias or name)

    return stats.select(
        *keys, "variable", "count_non_null", "count_null", "count_zero",
        r("mean"), r(P.quantile_column(0.5), "median"), r("std"), r("min"),
        *[r(P.quantile_column(p), name) for name, p in marks.items()],
        r("max"), r("sum"),
    )


def flag_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """True count and percentage of all rows for the access and play flags that exist."""
    flags = {m: c for m, c in ACCESS_FLAGS.items() if c in df.columns}
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(m) for m, c in flags.items()])
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("count_true"),
                 X.pct(F.col(m), F.col("n")).alias("percentage_true"))
        for m in flags
    ]
    return one.select(*keys, F.inline(F.array(*rows)))


def missingness_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Null count of every column, from a single aggregation pass."""
    columns = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(X.quoted(c)).alias(f"__{c}") for c in columns]
    )
    n = F.col("__n")
    rows = [
        F.struct(
            F.lit(c).alias("column"), n.alias("row_count"), X.quoted(f"__{c}").alias("non_null_count"),
            (n - X.quoted(f"__{c}")).alias("null_count"), X.pct(n - X.quoted(f"__{c}"), n).alias("null_percentage"),
        )
        for c in columns
    ]
    return one.select(*keys, F.inline(F.array(*rows))).orderBy(*keys, F.desc("null_count"), "column")


def concentration_summary(
    df: DataFrame, columns: Sequence[str] = CONCENTRATION_VARIABLES, keys: Sequence[str] = ()
) -> DataFrame:
    """Share of a column's sum held by the top 1, 5 and 10 per cent of rows; columns without values are left out."""
    return P.top_shares(df, keys, [c for c in columns if c in df.columns], {
        "share_top_1_percent": 0.01, "share_top_5_percent": 0.05, "share_top_10_percent": 0.10,
    })


def cross_tab(
    df: DataFrame, row: str, column: str, values: Sequence, keys: Sequence[str] = (), percentages: bool = True
) -> DataFrame:
    """One count column per value, nulls under `unknown`, and each cell's percentage of the grand total.

    The values are passed in, so no extra job looks for them; any others count under `other`, which booleans do not need.
    """
    names = {_label(v): F.count_if(X.quoted(column) == F.lit(v)) for v in values}
    names["unknown"] = F.count_if(X.quoted(column).isNull())
    if not {False, True} <= {v for v in values if isinstance(v, bool)}:
        names["other"] = F.count_if(~X.quoted(column).isin(*values))
    flat = df.groupBy(*keys, X.or_unknown(F.col(row).cast("string")).alias(row)).agg(
        *[c.alias(n) for n, c in names.items()]
    )
    if not percentages:
        return flat
    cells = [X.quoted(n) for n in names]
    total = F.sum(sum(cells[1:], cells[0])).over(X.over_keys(keys))
    counted = flat.withColumn("__total", total)
    return counted.withColumns({
        f"{n}_percentage_of_total": X.pct(X.quoted(n), F.col("__total")) for n in names
    }).drop("__total")


def _label(value) -> str:
    """Booleans are labelled True and False, as text."""
    return str(value)


def polarity_by(df: DataFrame, row: str, keys: Sequence[str] = ()) -> DataFrame:
    return cross_tab(df, row, "is_positive", [False, True], keys)


def monthly_review_volume(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    month = "review_created_year_month"
    out = df.groupBy(*keys, month).agg(
        F.count("recommendationid").alias("review_count"),
        F.count_if("is_positive").alias("positive_reviews"),
        F.count_if("is_negative").alias("negative_reviews"),
    )
    n = F.col("review_count")
    return out.withColumns({
        "positive_percentage": X.pct(F.col("positive_reviews"), n),
        "negative_percentage": X.pct(F.col("negative_reviews"), n),
    }).orderBy(*keys, F.asc_nulls_last(month))

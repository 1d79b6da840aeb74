"""Time tables. Window functions run only over already aggregated periods: their size is bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X
from gleaner.operators import profile as P

DAY, WEEK, MONTH = "review_created_date_day", "review_created_date_week", "review_created_date_month"
RESPONSE_MONTH = "developer_responded_date_month"


# ---------------------------------------------------------------- building blocks

def numeric_by_period(
    df: DataFrame, period: str, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Nine statistics per period for several columns at once, prefixed with the column; null periods are left out."""
    hist = P.histogram(df.filter(F.col(period).isNotNull()), [*keys, period], columns)
    return period_statistics(hist, period, columns, keys)


def period_statistics(hist: DataFrame, period: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The statistics of `numeric_by_period` out of a histogram over keys and period."""
    group = [*keys, period]
    stats = P.profile_of_histogram(hist, [0.25, 0.5, 0.75, 0.9])
    names = {
        "count_non_null": "count_non_null", "mean": "mean", "median": P.quantile_column(0.5), "std": "std",
        "min": "min", "p25": P.quantile_column(0.25), "p75": P.quantile_column(0.75),
        "p90": P.quantile_column(0.9), "max": "max",
    }
    picks = []
    for c in columns:
        for label, source in names.items():
            value = F.max(F.when(F.col("variable") == c, F.col(source)))
            picks.append((value if label == "count_non_null" else F.round(value, 4)).alias(f"{c}_{label}"))
    return stats.groupBy(*group).agg(*picks)


def _flag_aggregates(flag: str) -> list[Column]:
    return [F.count(F.lit(1)).alias(f"{flag}_review_count"), F.count_if(flag).alias(f"{flag}_true_count")]


def _flag_percentages(flags: Sequence[str]) -> dict[str, Column]:
    return {f"{f}_percentage": X.pct(F.col(f"{f}_true_count"), F.col(f"{f}_review_count")) for f in flags}


def flag_rate_by_period(df: DataFrame, period: str, flags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows, true count and percentage per period for several flags at once; null periods are left out."""
    return _counts_by_period(df, period, keys, flags=flags)


def period_crosstab(
    df: DataFrame, period: str, column: str, labels: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Counts per period and label; null periods and null labels count as `unknown`, labels not named as `other`."""
    cells = {label: F.count_if(F.col(column) == label) for label in labels}
    cells |= {"unknown": F.count_if(F.col(column).isNull()), "other": F.count_if(~F.col(column).isin(*labels))}
    return df.groupBy(*keys, X.or_unknown(F.col(period)).alias(period)).agg(*[c.alias(n) for n, c in cells.items()])


def _band_counts(column: str, labels: Sequence[str]) -> list[Column]:
    cells = [F.count_if(F.col(column) == label).alias(f"{column}_{label}") for label in labels]
    return [*cells, F.count_if(F.col(column).isNull()).alias(f"{column}_unknown")]


def _counts_by_period(
    df: DataFrame, period: str, keys: Sequence[str], flags: Sequence[str] = (), bands: dict | None = None
) -> DataFrame:
    """Flag rates and band counts of all periods in a single aggregation."""
    aggregates = [a for f in flags for a in _flag_aggregates(f)]
    aggregates += [a for column, labels in (bands or {}).items() for a in _band_counts(column, labels)]
    out = df.filter(F.col(period).isNotNull()).groupBy(*keys, period).agg(*aggregates)
    return out.withColumns(_flag_percentages(flags)) if flags else out


def _volume(df: DataFrame, period: str, keys: Sequence[str], *more: Column) -> DataFrame:
    out = df.groupBy(*keys, period).agg(
        F.count("recommendationid").alias("review_count"),
        F.count_if("is_positive").alias("positive_reviews"),
        F.count_if("is_negative").alias("negative_reviews"),
        *more,
    )
    return with_percentages(out)


def with_percentages(out: DataFrame) -> DataFrame:
    n = F.col("review_count")
    return out.withColumns({
        "positive_percentage": X.pct(F.col("positive_reviews"), n),
        "negative_percentage": X.pct(F.col("negative_reviews"), n),
    })


def _in_time(keys: Sequence[str], period: str):
    return X.ordered_within(keys, F.asc_nulls_last(period))


def _change(column: str, w) -> Column:
    return F.col(column) - F.lag(column).over(w)


def _mean_of_percentages(column: str, w) -> Column:
    """Mean of four-place percentages, halves rounded up exactly: computed in whole ten-thousandths."""
    total = F.sum(F.round(F.col(column) * 10_000).cast("bigint")).over(w)
    n = F.count(column).over(w)
    return F.when(n > 0, F.floor((2 * total + n) / (2 * n)) / 10_000)


def _running(df: DataFrame, period: str, unit: str, keys: Sequence[str]) -> DataFrame:
    """Running total, change of count and change of percentage against the previous row (gaps are not filled)."""
    w = _in_time(keys, period)
    return df.withColumns({
        "cumulative_reviews": F.sum("review_count").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        f"review_count_change_vs_previous_{unit}": _change("review_count", w),
        f"positive_percentage_change_vs_previous_{unit}": F.round(_change("positive_percentage", w), 4),
    })


# ---------------------------------------------------------------- tables

def temporal_coverage(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last review, whole days covered plus one, months with reviews."""
    created = F.col("review_created_datetime_utc")
    context = [c for c in ("app_id", "game_slug", "game_title") if c in df.columns and c not in keys]
    one = df.groupBy(*keys).agg(
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in context],
        F.min(created).alias("first"), F.max(created).alias("last"),
        F.count_distinct(MONTH).alias("months"),
    )
    first, last = F.col("first"), F.col("last")
    shown = "yyyy-MM-dd HH:mm:ss"
    return X.metric_rows(one, keys, {
        **{c: F.col(c) for c in context},
        "first_review_datetime_utc": F.date_format(first, shown),
        "last_review_datetime_utc": F.date_format(last, shown),
        "days_covered": F.floor((F.unix_seconds(last) - F.unix_seconds(first)) / 86400) + 1,
        "months_covered": F.col("months"),
    })


def daily_volume(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _running(_volume(df, DAY, keys), DAY, "day", keys)


def weekly_volume(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _running(_volume(df, WEEK, keys), WEEK, "week", keys)


def monthly_volume_extended(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return extended(_volume(df, MONTH, keys, F.count_distinct("steamid").alias("unique_reviewers")), keys)


def extended(volume: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monthly volumes with running totals, changes and means over three rows."""
    three = _in_time(keys, MONTH).rowsBetween(-2, 0)
    return _running(volume, MONTH, "month", keys).withColumns({
        "review_count_rolling_mean_3m": F.round(F.avg("review_count").over(three), 4),
        "positive_percentage_rolling_mean_3m": _mean_of_percentages("positive_percentage", three),
    })


def monthly_polarity_trends(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    change = F.round(_change("positive_percentage", _in_time(keys, MONTH)), 4)
    return _volume(df, MONTH, keys).withColumns({
        "positive_negative_ratio": X.ratio(F.col("positive_reviews"), F.col("negative_reviews")),
        "positive_percentage_change_vs_previous_month": change,
    })


def monthly_language_trends(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Month and language: count, share within the month, positive share. Null months have no month total."""
    counts = df.groupBy(*keys, MONTH, X.or_unknown(F.col("language")).alias("language")).agg(
        F.count(F.lit(1)).alias("review_count"), F.count_if("is_positive").alias("positive_reviews")
    )
    total = F.when(F.col(MONTH).isNotNull(), F.sum("review_count").over(Window.partitionBy(*keys, MONTH)))
    return counts.withColumn("month_total_reviews", total).withColumns({
        "review_percentage_within_month": X.pct(F.col("review_count"), F.col("month_total_reviews")),
        "positive_percentage_within_language_month": X.pct(F.col("positive_reviews"), F.col("review_count")),
    })


def monthly_text_length(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Length statistics per month and the share of each word band within it; an absent band has no share."""
    group, band = [*keys, MONTH], "review_length_words_band"
    lengths = numeric_by_period(df, MONTH, ["review_length_words", "review_length_chars", "review_length_lines"], keys)
    bands = df.filter(F.col(MONTH).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), *_band_counts(band, K.WORDS_LABELS)
    )
    shares = bands.select(*group, *[
        X.pct(F.nullif(X.quoted(f"{band}_{label}"), F.lit(0)), F.col("__n")).alias(f"{band}_{label}_percentage")
        for label in K.WORDS_LABELS
    ])
    return X.join_on(lengths, shares, group)


def _monthly(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], flags: Sequence[str] = (), bands: dict | None = None
) -> DataFrame:
    stats = numeric_by_period(df, MONTH, columns, keys)
    return X.join_on(stats, _counts_by_period(df, MONTH, keys, flags, bands), [*keys, MONTH])


def monthly_playtime(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _monthly(
        df, ["playtime_at_review", "playtime_forever", "playtime_post_review"], keys,
        ["played_after_review", "recent_playtime_recorded", "used_steam_deck_at_review"],
        {"playtime_at_review_band": K.PLAYTIME_LABELS},
    )


def monthly_reviewer_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _monthly(df, ["num_reviews", "num_games_owned"], keys, (), {
        "num_reviews_band": K.REVIEWER_LABELS, "num_games_owned_band": K.LIBRARY_LABELS,
    })


def monthly_interaction(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _monthly(df, ["votes_up", "votes_funny", "comment_count"], keys,
                    ["has_helpful_votes", "has_funny_votes", "has_comments"])


def _days(df: DataFrame, column: str, group: Sequence[str]) -> DataFrame:
    stats = P.numeric_profile(df, group, [column], [0.5])
    return stats.select(
        *group, F.round("mean", 4).alias(f"mean_{column}"),
        F.round(P.quantile_column(0.5), 4).alias(f"median_{column}"),
    )


def review_updates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Updated reviews and days until the update, by month of creation."""
    group = [*keys, MONTH]
    counts = df.groupBy(*group).agg(
        F.count("recommendationid").alias("review_count"),
        F.count_if("review_updated_after_creation").alias("updated_reviews"),
    ).withColumn("updated_reviews_percentage", X.pct(F.col("updated_reviews"), F.col("review_count")))
    return X.join_on(counts, _days(df, "days_between_creation_and_update", group), group)


def response_timeline(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Developer responses by month of the review, next to responses written in that month.

    A month without negative (positive) reviews has null in their columns; a month without responses written has null,
    not zero; months that only have responses do not appear.
    """
    group = [*keys, MONTH]
    answered, review_id = F.col("has_developer_response"), F.col("recommendationid")

    def side(flag: str, name: str) -> list[Column]:
        rows = F.count_if(flag)
        return [
            F.when(rows > 0, F.count(F.when(F.col(flag), review_id))).alias(f"{name}_reviews"),
            F.when(rows > 0, F.count_if(F.col(flag) & answered)).alias(f"{name}_reviews_with_response"),
        ]

    base = df.groupBy(*group).agg(
        F.count(review_id).alias("review_count"),
        F.count_if(answered).alias("reviews_with_developer_response"),
        *side("is_negative", "negative"), *side("is_positive", "positive"),
    ).withColumns({
        "developer_response_percentage": X.pct(F.col("reviews_with_developer_response"), F.col("review_count")),
        "negative_response_percentage": X.pct(F.col("negative_reviews_with_response"), F.col("negative_reviews")),
        "positive_response_percentage": X.pct(F.col("positive_reviews_with_response"), F.col("positive_reviews")),
    })
    written = (
        df.filter(answered).groupBy(*keys, F.col(RESPONSE_MONTH).alias(MONTH))
        .agg(F.count(F.lit(1)).alias("developer_responses_created_in_month"))
    )
    timed = X.join_on(base, _days(df, "days_to_developer_response", group), group)
    return X.join_on(timed, written, group)


def _monthly_polarity(df: DataFrame, by: Column, name: str, keys: Sequence[str]) -> DataFrame:
    out = df.groupBy(*keys, MONTH, by.alias(name)).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.count_if("is_positive").alias("positive_reviews"),
        F.count_if("is_negative").alias("negative_reviews"),
    )
    n = F.col("review_count")
    return out.withColumns({
        "positive_percentage": X.pct(F.col("positive_reviews"), n),
        "negative_percentage": X.pct(F.col("negative_reviews"), n),
    })


def monthly_polarity_by_language(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _monthly_polarity(df, X.or_unknown(F.col("language")), "language", keys)


def monthly_polarity_by_band(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows without a band stay together as the null band."""
    return _monthly_polarity(df, F.col("playtime_at_review_band"), "playtime_at_review_band", keys)


def peak_activity(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Busiest day, week and month; the earliest of equals. Rows are counted once, by day; weeks and months add days up."""
    units = {"day": DAY, "week": WEEK, "month": MONTH}
    days = df.groupBy(*keys, *units.values()).agg(F.count("recommendationid").alias("n"))
    each = days.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(unit).alias("unit"), F.col(period).alias("period"), "n") for unit, period in units.items()
    ])))
    counts = each.groupBy(*keys, "unit", "period").agg(F.sum("n").alias("n"))
    one = counts.groupBy(*keys).agg(*[
        F.min_by(F.struct("period", "n"), F.when(F.col("unit") == unit, F.struct(-F.col("n"), "period"))).alias(unit) for unit in units
    ])
    return X.metric_rows(one, keys, {
        f"peak_{unit}_{name}": F.col(f"{unit}.{c}") for unit in units for name, c in (("period", "period"), ("review_count", "n"))
    })

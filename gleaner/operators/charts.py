"""Chart-ready reshapes of the finished tables, and the index of figures.

All inputs are finished report tables, whose size is bounded by the calendar, the languages or a top-n. With `keys`, the tables
hold several products, and each chart is made for every product.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X

MONTH = "review_created_date_month"


def polarity_distribution(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positive and negative counts out of the long polarity summary."""
    kept = summary.filter(F.col("metric").isin("positive_reviews", "negative_reviews"))
    return kept.select(
        *keys, F.regexp_replace("metric", "_reviews$", "").alias("polarity"),
        F.col("value").try_cast("bigint").alias("review_count"),
    )


def language_top10(distribution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    table = distribution.select(*keys, "language", "review_count")
    return _first(table, keys, 10, F.desc("review_count"), F.asc("language"))


def _first(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return X.top_ranked(df, keys, n, *order).drop("rank") if keys else df.orderBy(*order).limit(n)


def polarity_by_band(cross_tab: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cross_tab.select(
        *keys, "playtime_at_review_band", F.col("False").alias("negative_reviews"), F.col("True").alias("positive_reviews")
    )


def columns(*names: str) -> Callable[..., DataFrame]:
    """The named columns, as far as the table has them."""
    return lambda df, keys=(): df.select(*keys, *[X.quoted(c) for c in names if c in df.columns])


def language_trends_top5(trends: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Months by the five languages with most reviews, one column per language.

    The five names come from the finished table; they are the result's columns and have to be known before the plan. With
    keys, each product has five languages of its own, so there is one row per month and language instead.
    """
    totals = trends.groupBy(*keys, "language").agg(F.sum("review_count").alias("n"))
    if keys:
        five = X.top_ranked(totals, keys, 5, F.desc("n"), F.asc("language")).select(*keys, "language")
        return X.join_on(trends.filter(F.col(MONTH).isNotNull()), five, [*keys, "language"], "inner").select(*keys, MONTH, "language", "review_count")
    names = [r.language for r in totals.orderBy(F.desc("n"), "language").limit(5).collect()]
    kept = trends.filter(F.col("language").isin(names) & F.col(MONTH).isNotNull())
    cells = [F.coalesce(F.sum(F.when(F.col("language") == n, F.col("review_count"))), F.lit(0)).alias(n) for n in sorted(names)]
    return kept.groupBy(MONTH).agg(*cells)


def first_terms(value: str, n: int = 20) -> Callable[..., DataFrame]:
    """The first `n` terms of a ranked table; ties are decided as in the table itself."""
    def transform(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        if "rank" in df.columns:
            return df.filter(F.col("rank") <= n).select(*keys, "token", value)
        a = next(c for c in df.columns if c.endswith("_frequency"))
        return _first(df, keys, n, F.desc(value), F.desc(a), F.asc("token")).select(*keys, "token", value)
    return transform


def by_polarity(suffix: str, name: str, categories: Sequence[str] | None = None) -> Callable[..., DataFrame]:
    """Segment rows with one column per category, turned into category rows with one column per segment."""
    def transform(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        found = categories or sorted(c.removesuffix(suffix) for c in df.columns if c.endswith(suffix))
        long = df.filter(F.col("segment").isin("positive", "negative")).select(
            *keys, "segment", *[X.quoted(f"{c}{suffix}").cast("double").alias(c) for c in found]
        ).unpivot([*keys, "segment"], list(found), name, "share")
        return long.groupBy(*keys, name).agg(
            *[F.max(F.when(F.col("segment") == s, F.col("share"))).alias(s) for s in ("positive", "negative")]
        )
    return transform


@dataclass(frozen=True)
class Figure:
    """One chart: which report table feeds it and how."""

    figure_id: str
    family: str
    title: str
    chart_type: str
    source_table: str
    transform: Callable[..., DataFrame]
    notes: str


# The figures in order, with their titles, chart types and notes.
FIGURES = [
    Figure("figure_01", "basic_metrics", "Polarity distribution", "bar", "polarity_summary",
           polarity_distribution, "Based on positive and negative review totals."),
    Figure("figure_02", "basic_metrics", "Language distribution (top 10)", "bar", "language_distribution",
           language_top10, "Top 10 languages ranked by review count."),
    Figure("figure_03", "basic_metrics", "Polarity by playtime band", "bar_stacked",
           "cross_tab_polarity_by_playtime_band", polarity_by_band,
           "Counts of positive and negative reviews by playtime band."),
    Figure("figure_04", "temporal_metrics", "Monthly review volume", "line", "monthly_review_volume_extended",
           columns(MONTH, "review_count"), "Review count by month."),
    Figure("figure_05", "temporal_metrics", "Monthly polarity trends", "line", "monthly_polarity_trends",
           columns(MONTH, "positive_reviews", "negative_reviews"), "Positive and negative review counts by month."),
    Figure("figure_06", "temporal_metrics", "Monthly positive percentage", "line", "monthly_polarity_trends",
           columns(MONTH, "positive_percentage"), "Percentage of positive reviews by month."),
    Figure("figure_07", "temporal_metrics", "Monthly language trends (top 5)", "line", "monthly_language_trends",
           language_trends_top5, "Top 5 languages by global review count across months."),
    Figure("figure_08", "temporal_metrics", "Developer response timeline", "line", "developer_response_timeline",
           columns(MONTH, "reviews_with_developer_response"),
           "Reviews with developer response by review-creation month."),
    Figure("figure_09", "text_metrics", "Top unigrams in positive reviews", "bar", "top_unigrams_positive",
           first_terms("frequency"), "Top 20 unigrams in positive reviews."),
    Figure("figure_10", "text_metrics", "Top unigrams in negative reviews", "bar", "top_unigrams_negative",
           first_terms("frequency"), "Top 20 unigrams in negative reviews."),
    Figure("figure_11", "text_metrics", "Distinctive terms: positive vs negative", "bar",
           "distinctive_terms_positive_vs_negative", first_terms("difference_per_1000"),
           "Top 20 terms most overrepresented in positive reviews."),
    Figure("figure_12", "text_metrics", "Distinctive terms: negative vs positive", "bar",
           "distinctive_terms_negative_vs_positive", first_terms("difference_per_1000"),
           "Top 20 terms most overrepresented in negative reviews."),
    Figure("figure_13", "emotion_metrics", "Emotion distribution summary", "bar", "emotion_distribution_summary",
           columns("emotion", "mean_per_100_tokens"), "Mean emotion signal per 100 tokens."),
    Figure("figure_14", "emotion_metrics", "Emotion profiles by polarity", "bar", "emotion_by_polarity",
           by_polarity("_mean_per_100_tokens", "emotion", K.EMOTIONS),
           "Emotion mean per 100 tokens for positive and negative segments."),
    Figure("figure_15", "emotion_metrics", "Selected emotions by month", "line", "emotion_by_month",
           columns("review_created_year_month", "joy_mean_per_100_tokens", "trust_mean_per_100_tokens",
                   "negative_mean_per_100_tokens", "anger_mean_per_100_tokens"),
           "Selected emotional dimensions over time."),
    Figure("figure_16", "theme_metrics", "Theme distribution summary", "bar", "theme_distribution_summary",
           columns("theme", "review_share_with_theme"), "Percentage of analysed reviews containing each theme."),
    Figure("figure_17", "theme_metrics", "Themes by polarity", "bar", "theme_by_polarity",
           by_polarity("_review_share", "theme"), "Theme review share for positive and negative segments."),
    Figure("figure_18", "theme_metrics", "Selected themes by month", "line", "theme_by_month",
           columns("review_created_year_month", "difficulty_review_share", "combat_review_share",
                   "performance_technical_review_share", "story_review_share"), "Selected themes over time."),
]


def figure_tables(
    tables: Mapping[str, DataFrame], figures: Sequence[Figure] = FIGURES, keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """The chart data of every figure whose source table is there."""
    return {f.figure_id: f.transform(tables[f.source_table], keys) for f in figures if f.source_table in tables}


def figure_index(
    charts: Mapping[str, DataFrame], figures: Sequence[Figure] = FIGURES, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per figure, and product that it has data for, with the size of its chart data."""
    rows = []
    for f in figures:
        if f.figure_id in charts:
            data = charts[f.figure_id]
            rows.append(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).select(
                *keys, F.lit(f.figure_id).alias("figure_id"), F.lit(f.family).alias("family"), F.lit(f.title).alias("title"),
                F.lit(f.chart_type).alias("chart_type"), F.lit(f.source_table).alias("source_table"), "row_count",
                F.lit(len(data.columns) - len(keys)).cast("bigint").alias("column_count"), F.lit(f.notes).alias("notes"),
            ))
    return reduce(DataFrame.unionByName, rows)

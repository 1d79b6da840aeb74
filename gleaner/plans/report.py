"""The report families: which tables belong together, computed from one cleaned table and written side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.functions.durable import durable
from gleaner.functions.stopwords import STOPWORDS
from gleaner.operators import charts, describe, emotions, prepare, quality, temporal, text, themes
from gleaner.sources import tables as io
from gleaner.sources.tables import Settings

Tables = dict[str, DataFrame]


def basic_tables(df: DataFrame, keys: Sequence[str] = ()) -> Tables:
    df = prepare.add_bands(df)
    return {
        "dataset_overview": describe.dataset_overview(df, keys),
        "polarity_summary": describe.polarity_summary(df, keys),
        "language_distribution": describe.language_distribution(df, keys),
        "reviewer_profile_summary": describe.numeric_summary(df, describe.PROFILE_VARIABLES, keys),
        "playtime_summary": describe.numeric_summary(df, describe.PLAYTIME_VARIABLES, keys),
        "interaction_summary": describe.numeric_summary(df, describe.INTERACTION_VARIABLES, keys),
        "text_summary": describe.numeric_summary(df, describe.TEXT_VARIABLES, keys),
        "temporal_interval_summary": describe.numeric_summary(df, describe.INTERVAL_VARIABLES, keys),
        "purchase_and_access_summary": describe.flag_summary(df, keys),
        "missingness_summary": describe.missingness_summary(df, keys),
        "concentration_summary": describe.concentration_summary(df, keys=keys),
        "cross_tab_polarity_by_language": describe.polarity_by(df, "language", keys),
        "cross_tab_polarity_by_playtime_band": describe.polarity_by(df, "playtime_at_review_band", keys),
        "cross_tab_polarity_by_reviewer_activity_band": describe.polarity_by(df, "num_reviews_band", keys),
        "cross_tab_polarity_by_library_size_band": describe.polarity_by(df, "num_games_owned_band", keys),
        "monthly_review_volume": describe.monthly_review_volume(df, keys),
    }


def temporal_tables(df: DataFrame, keys: Sequence[str] = ()) -> Tables:
    df = prepare.add_bands(prepare.add_periods(df))
    return {
        "temporal_coverage": temporal.temporal_coverage(df, keys),
        "daily_review_volume": temporal.daily_volume(df, keys),
        "weekly_review_volume": temporal.weekly_volume(df, keys),
        "monthly_review_volume_extended": temporal.monthly_volume_extended(df, keys),
        "monthly_polarity_trends": temporal.monthly_polarity_trends(df, keys),
        "monthly_language_trends": temporal.monthly_language_trends(df, keys),
        "monthly_text_length_trends": temporal.monthly_text_length(df, keys),
        "monthly_playtime_trends": temporal.monthly_playtime(df, keys),
        "monthly_reviewer_profile_trends": temporal.monthly_reviewer_profile(df, keys),
        "monthly_interaction_trends": temporal.monthly_interaction(df, keys),
        "review_update_metrics": temporal.review_updates(df, keys),
        "developer_response_timeline": temporal.response_timeline(df, keys),
        "monthly_polarity_by_language": temporal.monthly_polarity_by_language(df, keys),
        "monthly_polarity_by_playtime_band": temporal.monthly_polarity_by_band(df, keys),
        "peak_activity_summary": temporal.peak_activity(df, keys),
    }


def _shared_text_tables(corpus: DataFrame, keys: Sequence[str], s: Settings, scope: str) -> Tables:
    """The tables that the whole corpus and each language have in common; term counts are computed once and stored."""
    words, pairs = durable(text.term_counts(corpus, 1, keys)), durable(text.term_counts(corpus, 2, keys))
    out = {
        "text_corpus_overview": text.text_corpus_overview(
            corpus, keys, s.min_reviews_per_language, s.min_share_per_language, scope
        ),
        "text_metrics_by_polarity": text.text_by_polarity(corpus, keys),
        "text_metrics_by_playtime_band": text.text_by_band(corpus, keys),
        "distinctive_terms_positive_vs_negative":
            text.distinctive_terms(words, "positive", "negative", s.top_n_unigrams, keys),
        "distinctive_terms_negative_vs_positive":
            text.distinctive_terms(words, "negative", "positive", s.top_n_unigrams, keys),
    }
    for segment in ("overall", "positive", "negative"):
        out[f"top_unigrams_{segment}"] = text.frequency_table(words, s.top_n_unigrams, "token", segment, keys)
        out[f"top_bigrams_{segment}"] = text.frequency_table(pairs, s.top_n_bigrams, "bigram", segment, keys)
    return out


def corpus_of(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The tokenised texts, stored because every lexical table reads them."""
    made = text.text_subset(prepare.add_bands(df), s.min_token_length, STOPWORDS if s.remove_stopwords else None)
    wanted = ["app_id", "game_slug", "game_title", "language", "is_positive", "is_negative", "playtime_at_review_band",
              "review_length_words", "review_length_chars", "tokens", "token_count"]
    return durable(made.select(*[c for c in wanted if c in made.columns]))


def text_tables(corpus: DataFrame, keys: Sequence[str] = (), s: Settings = Settings()) -> Tables:
    """The fourteen tables of the whole corpus."""
    return {
        **_shared_text_tables(corpus, keys, s, "global"),
        "text_metrics_by_language": text.text_by_language(corpus, keys),
        "top_terms_by_language": text.top_terms_by_language(corpus, s.top_n_unigrams, keys),
        "top_trigrams_overall":
            text.frequency_table(text.term_counts(corpus, 3, keys), s.top_n_trigrams, "trigram", keys=keys),
    }


def language_tables(corpus: DataFrame, keys: Sequence[str] = (), s: Settings = Settings()) -> Tables:
    """The eleven tables of each selected language, all languages at once: the language is one more key."""
    chosen = text.of_selected_languages(corpus, s.min_reviews_per_language, s.min_share_per_language, keys)
    return _shared_text_tables(chosen, [*keys, "language"], s, "by_language")


def emotion_tables(df: DataFrame, lexicon: DataFrame, keys: Sequence[str] = (), s: Settings = Settings()) -> Tables:
    df = prepare.add_bands(df)
    subset = emotions.emotion_subset(df, s.target_language, s.min_token_length, s.remove_stopwords)
    enriched = emotions.enrich_with_emotions(subset, lexicon)
    return {
        "emotion_enriched_reviews": enriched,
        "emotion_corpus_overview": emotions.emotion_overview(df, enriched, s.target_language, keys),
        "emotion_distribution_summary": emotions.emotion_distribution(enriched, keys),
        "emotion_by_polarity": emotions.emotion_by_polarity(enriched, keys),
        "emotion_by_playtime_band": emotions.emotion_by_band(enriched, keys),
        "emotion_by_month": emotions.emotion_by_month(enriched, keys),
        "emotion_top_terms_by_emotion": emotions.emotion_top_terms(subset, lexicon, s.top_n_emotion_terms, keys),
    }


def theme_tables(df: DataFrame, dictionary: themes.Themes, keys: Sequence[str] = (), s: Settings = Settings()) -> Tables:
    df = prepare.add_bands(df)
    subset = themes.theme_subset(df, s.target_language, s.min_token_length, s.remove_stopwords)
    enriched = themes.enrich_with_themes(subset, dictionary, s.count_multiple_hits_per_theme)
    return {
        "theme_enriched_reviews": enriched,
        "theme_corpus_overview": themes.theme_overview(df, enriched, dictionary, s.target_language, keys),
        "theme_distribution_summary": themes.theme_distribution(enriched, dictionary, keys),
        "theme_by_polarity": themes.theme_by_polarity(enriched, dictionary, keys),
        "theme_by_playtime_band": themes.theme_by_band(enriched, dictionary, keys),
        "theme_by_month": themes.theme_by_month(enriched, dictionary, keys),
        "theme_top_terms_by_theme": themes.theme_top_terms(enriched, keys),
    }


def word_cloud_tables(df: DataFrame, keys: Sequence[str] = (), s: Settings = Settings()) -> Tables:
    corpus = text.cloud_subset(df, s.cloud_target_language, s.min_token_length, s.remove_stopwords)
    return {
        **{f"wordcloud_{label}s": text.cloud_table(corpus, n, label, low, top, keys)
           for label, (n, low, top) in s.cloud_limits.items()},
        "wordcloud_summary": text.cloud_summary(df, corpus, dict(s.cloud_limits), keys),
    }


def checks_of(cleaned: DataFrame, tables: Mapping[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """The structural and consistency checks of a finished report."""
    required = {
        "polarity_summary": ["metric", "value"],
        "monthly_polarity_trends": [
            "review_created_date_month", "review_count", "positive_reviews", "negative_reviews", "positive_percentage",
        ],
        "top_unigrams_positive": ["rank", "token", "frequency"],
        "top_unigrams_negative": ["rank", "token", "frequency"],
        "emotion_by_polarity": ["segment", "review_count", "total_tokens", "emotion_token_count"],
        "theme_by_polarity": ["segment", "review_count", "total_tokens", "theme_match_count_total"],
    }
    checks = [
        quality.required_columns(cleaned, ["recommendationid", "review", "language", "voted_up"], "cleaned_required_columns", keys=keys),
        quality.non_empty(cleaned, "cleaned_non_empty", keys=keys),
        quality.unique_ids(cleaned, check_id="cleaned_recommendationid_uniqueness", keys=keys),
    ]
    checks += [quality.required_columns(tables[t], c, f"{t}_required_columns", keys=keys) for t, c in required.items() if t in tables]
    if "polarity_summary" in tables:
        checks.append(quality.polarity_total(tables["polarity_summary"], keys))
    if "monthly_polarity_trends" in tables:
        checks.append(quality.non_empty(tables["monthly_polarity_trends"], "monthly_polarity_trends_non_empty", "warning", keys))
    checks += [
        quality.expected_segments(tables[t], f"{t}_expected_segments", keys=keys)
        for t in ("emotion_by_polarity", "theme_by_polarity") if t in tables
    ]
    return quality.all_checks(*checks)


def write_tables(tables: Mapping[str, DataFrame], folder: str, as_csv: bool = True) -> None:
    """Each table to its own folder, as CSV (or Parquet, which keeps types and arrays)."""
    for name, df in tables.items():
        nested = any(t.startswith(("array", "struct", "map")) for _, t in df.dtypes)
        if as_csv and not nested:
            io.write_csv(df, f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_by_language(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table with a folder per language, named by the language's slug."""
    for name, df in tables.items():
        named = df.withColumn("language_slug", X.slug(F.col("language")))
        named.write.mode("overwrite").partitionBy("language_slug").parquet(f"{folder}/{name}")


def write_report(
    df: DataFrame, folder: str, lexicon: DataFrame | None = None, dictionary: themes.Themes | None = None,
    keys: Sequence[str] = (), s: Settings = Settings(),
) -> DataFrame:
    """All families of a cleaned table under `folder`; returns the checks."""
    corpus = corpus_of(df, s)
    families: dict[str, Tables] = {
        "basic_metrics": basic_tables(df, keys),
        "temporal_metrics": temporal_tables(df, keys),
        "text_metrics": text_tables(corpus, keys, s),
        "word_clouds": word_cloud_tables(df, keys, s),
    }
    if s.export_per_language:
        families["text_metrics_by_language"] = language_tables(corpus, keys, s)
    if lexicon is not None:
        families["emotion_metrics"] = emotion_tables(df, lexicon, keys, s)
    if dictionary:
        families["theme_metrics"] = theme_tables(df, dictionary, keys, s)
    written: Tables = {}
    for family, tables in families.items():
        if family == "text_metrics_by_language":
            write_by_language(tables, f"{folder}/{family}")
            continue
        write_tables(tables, f"{folder}/{family}", as_csv=False)
        written.update({name: df.sparkSession.read.parquet(f"{folder}/{family}/{name}") for name in tables})
    figures = charts.figure_tables(written, keys=keys)
    write_tables({**figures, "figure_index": charts.figure_index(figures, keys=keys)}, f"{folder}/figures")
    checks = checks_of(df, written, keys)
    write_tables({"checks": checks, "check_summary": quality.check_summary(checks, keys)}, f"{folder}/checks")
    return checks

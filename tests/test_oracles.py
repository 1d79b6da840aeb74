"""Queries against their SQL counterparts. FULL_ORACLES=1 runs all of them, else one or two of each family."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "flatten_reviews", "ingest_dedup", "chunk_index", "incremental_anti_join", "theme_dictionary_load", "lexicon_load",
    "clean_text", "normalise_booleans", "prepare_reviews", "text_lengths", "period_keys", "polarity_summary",
    "numeric_summary", "concentration_summary", "xtab_playtime", "monthly_polarity_trends", "monthly_volume_extended",
    "monthly_playtime", "response_timeline", "peak_activity", "tokenise", "top_bigrams_positive", "text_by_polarity",
    "distinctive_pos_vs_neg", "per_language_distinctive", "per_language_by_polarity", "per_language_bigrams_negative", "emotion_enrich", "emotion_by_polarity", "theme_enrich",
    "theme_top_terms", "fig_language_top5", "cloud_trigrams", "dq_summary", "stream_resume", "stream_weekly_volume", "stream_progress",
    "incremental_bucketed", "stream_lost_state", "stream_progress_log", "theme_phrases_of_tokens", "emotion_enrich_by_join", "json_whole_rows",
    "rejected_pages", "combined_in_one_job", "settings_top_unigrams", "weekly_playtime_from_days", "monthly_volume_from_days",
    "dq_polarity_total_by_product", "dq_unique_id_by_product", "dq_required_columns", "cross_tab", "period_crosstab", "slugify",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_is_named_alike():
    assert set(ORACLES) <= set(QUERIES)
    assert {q for q in set(QUERIES) - set(ORACLES) if not q.startswith(("op", "pipeline"))} == set()


@pytest.mark.parametrize("name", sorted(x for x in ORACLES if not x.startswith("op")) if os.environ.get("FULL_ORACLES") else SAMPLE)
def test_same_as_sql(spark, con, sf_dir, name):
    text, rows = difference(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert text == ""
    assert rows > 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0

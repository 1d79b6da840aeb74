"""Relations that must hold between results, on whole small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bindings import fixtures as B
from bindings import lookups as L
from bindings import queries as Q
from gleaner.operators import charts, describe, emotions, quality, temporal, text, themes
from gleaner.operators.prepare import keep_first
from gleaner.plans import report
from gleaner.sources import landing, tables
from gleaner.sources.tables import Settings
from gleaner.streaming import reviews as streams


@pytest.fixture(scope="module")
def num(spark, sf_dir):
    return B.num(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def txt(spark, sf_dir):
    return B.txt(spark, sf_dir).persist()


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


KEYED = {
    "polarity": describe.polarity_summary,
    "numbers": lambda df, keys=(): describe.numeric_summary(df, describe.PLAYTIME_VARIABLES, keys),
    "concentration": lambda df, keys=(): describe.concentration_summary(df, keys=keys),
    "cross tab": lambda df, keys=(): describe.polarity_by(df, "language", keys),
    "daily": temporal.daily_volume,
    "responses": temporal.response_timeline,
    "peaks": temporal.peak_activity,
    "figure 1": lambda df, keys=(): charts.polarity_distribution(describe.polarity_summary(df, keys), keys),
    "figure 2": lambda df, keys=(): charts.language_top10(describe.language_distribution(df, keys), keys),
    "figure 3": lambda df, keys=(): charts.polarity_by_band(describe.polarity_by(df, "playtime_at_review_band", keys), keys),
    "polarity check": lambda df, keys=(): quality.polarity_total(describe.polarity_summary(df, keys), keys),
    "id check": lambda df, keys=(): quality.unique_ids(df, keys=keys),
}


@pytest.mark.parametrize("name", KEYED)
def test_all_products_at_once_equal_one_by_one(num, name):
    f = KEYED[name]
    together = f(num, keys=["app_id"])
    for app in (0, 1, 2):
        single = f(num.filter(F.col("app_id") == app).drop("app_id"))
        assert rows(together.filter(F.col("app_id") == app).drop("app_id")) == rows(single)


def test_keyed_text_tables_equal_one_by_one(txt):
    corpus = text.text_subset(txt, 2, L.STOPS)
    for f in (
        lambda c, keys: text.frequency_table(text.term_counts(c, 1, keys), 25, keys=keys),
        lambda c, keys: text.distinctive_terms(text.term_counts(c, 1, keys), "positive", "negative", 25, keys),
        lambda c, keys: text.text_by_polarity(c, keys),
    ):
        together = f(corpus, ["language"])
        single = f(corpus.filter(F.col("language") == "english"), [])
        assert rows(together.filter(F.col("language") == "english").drop("language")) == rows(single)


def test_an_id_with_a_third_of_all_rows_is_kept_once(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("recommendationid"), F.col("id").alias("seq")
    )
    kept = keep_first(df, ["recommendationid"], ["seq"])
    assert kept.count() == 6001
    assert kept.filter(F.col("recommendationid") == "hot").first().seq == 0
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_counts_add_up(txt):
    corpus = text.text_subset(txt, 2, L.STOPS)
    tokens = corpus.agg(F.sum("token_count")).first()[0]
    assert text.term_counts(corpus).agg(F.sum("overall")).first()[0] == tokens
    bigrams = corpus.agg(F.sum(F.greatest(F.col("token_count") - 1, F.lit(0)))).first()[0]
    assert text.term_counts(corpus, 2).agg(F.sum("overall")).first()[0] == bigrams


def test_contrasts_mirror_each_other(txt):
    counts = text.term_counts(text.text_subset(txt, 2, L.STOPS))
    a = {r.token: r for r in text.distinctive_terms(counts, "positive", "negative", 10**6).collect()}
    b = {r.token: r for r in text.distinctive_terms(counts, "negative", "positive", 10**6).collect()}
    assert a.keys() == b.keys()
    assert all(a[t].difference_per_1000 == -b[t].difference_per_1000 for t in a)


def test_running_total_ends_at_the_total(num):
    daily = temporal.daily_volume(num)
    assert daily.agg(F.max("cumulative_reviews")).first()[0] == num.count()


def test_lexicon_in_place_equals_a_join(spark, txt):
    """The lookup inside the row against the tokens joined with the lexicon; ids are unique in this table."""
    subset, lexicon = emotions.emotion_subset(txt), Q.lexicon(spark)
    got = emotions.enrich_with_emotions(subset, lexicon).select("recommendationid", emotions.MATCHES, "joy_count", "negative_count")
    hits = subset.select("recommendationid", F.posexplode("tokens").alias("at", "word")).join(lexicon, "word")
    want = subset.select("recommendationid").join(hits, "recommendationid", "left").groupBy("recommendationid").agg(
        F.count_distinct("at").alias(emotions.MATCHES), F.count_if(F.col("emotion") == "joy").alias("joy_count"),
        F.count_if(F.col("emotion") == "negative").alias("negative_count"),
    )
    assert rows(got) == rows(want)


def test_themes(spark):
    df = spark.createDataFrame(
        [(["boss", "fight", "boss", "fights", "bug"],), (["aa", "aa", "aa"],), (["none"],)], "tokens array<string>"
    ).withColumn(themes.TOKENS, F.size("tokens").cast("bigint"))
    dictionary = {"Bosses ": ["boss", " Boss fight", ""], "tech": ["bug"], "combat": ["bug", "aa aa"], "": ["x"], "blank": [" "]}
    got = themes.enrich_with_themes(df, dictionary).collect()
    assert (got[0].bosses_count, got[0].bosses_matched_terms, got[0].tech_count, got[0].combat_count) == (4, "boss; boss fight", 1, 1)
    assert (got[1].combat_count, got[2].themes_present_count) == (1, 0)
    once = themes.enrich_with_themes(df, dictionary, count_every_hit=False).collect()
    assert (once[0].bosses_count, once[0].theme_match_count_total) == (2, 4)


def test_chunks_are_full_and_in_order(spark):
    made = landing.with_chunks(spark.range(2500).select((F.col("id") * 7 % 2503).alias("seq")).repartition(6), 400)
    per = made.groupBy("chunk_number").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("chunk_number").collect()
    assert [r.n for r in per] == [400] * 6 + [100]
    assert all(a.hi < b.lo for a, b in zip(per, per[1:]))


def test_page_files_round_trip(spark, sf_dir, tmp_path):
    pages = Q.pages(spark, sf_dir)
    pages.select("value").write.text(str(tmp_path / "pages"))
    read = spark.read.schema(landing.S.page_schema()).json(str(tmp_path / "pages"))
    got = landing.flatten_pages(read).drop("position")
    assert rows(got) == rows(Q.flattened(spark, sf_dir).drop("position", "page"))


def test_page_leaves_are_cast_leniently(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"success": 1,\n "cursor": "x", "reviews": [{"recommendationid": 7, "voted_up": "false", "votes_up": "x", "author": {"steamid": "9", "num_reviews": 3}},'
        ' {"recommendationid": "8", "author": null}]}'
    )
    got = landing.flatten_pages(landing.read_pages(spark, str(tmp_path / "p.json"))).orderBy("position").collect()
    assert (got[0].recommendationid, got[0].voted_up, got[0].votes_up, got[0].num_reviews) == ("7", False, None, 3)
    assert (got[1].recommendationid, got[1].steamid) == ("8", None)


def test_chunk_files_are_read_with_their_number(spark, tmp_path):
    for n, ids in ((1, "a\nb"), (2, "b\n\"\"")):
        body = "\n".join(",".join([i] + [""] * 23) for i in ids.split("\n"))
        (tmp_path / f"x_reviews_part_{n:04d}.csv").write_text(",".join(landing.S.RAW_COLUMNS) + "\n" + body + "\n")
    chunks = landing.read_chunks(spark, str(tmp_path))
    counts = landing.combine_counts(chunks).first()
    assert (counts.rows_written, counts.duplicate_rows_skipped) == (2, 2)
    first = {r.recommendationid: r.chunk_number for r in landing.combine_chunks(chunks, ["chunk_number"]).collect()}
    assert first == {"a": 1, "b": 1}


def test_segments_and_status_of_checks(spark):
    table = spark.createDataFrame([("overall",), ("positive",)], "segment string")
    check = quality.expected_segments(table, "c").first()
    assert (check.passed, check.message) == (False, "Missing segments: negative")
    summary = quality.check_summary(quality.expected_segments(table, "c")).first()
    assert (summary.warning_failures, summary.final_status) == (1, "passed")
    failing = quality.required_columns(table, ["x"], "r")
    assert quality.check_summary(failing).first().final_status == "failed"


def test_settings_come_from_configuration():
    s = Settings.from_json({"text_metrics": {"top_n_unigrams": "7"}, "word_cloud": {"max_words_bigrams": 9, "target_language": "English "}})
    assert (s.top_n_unigrams, s.top_n_bigrams, s.cloud_target_language, s.cloud_limits["bigram"]) == (7, 100, "english", (2, 2, 9))


def test_json_records_hold_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5, None)], "a double, b double, c double, d string")
    assert tables.json_records(df).first().value == '{"a":null,"b":null,"c":1.5,"d":null}'


def test_whole_report(spark, sf_dir, tmp_path):
    cleaned = Q.cleaned_columns(B.document_reviews(spark, sf_dir)).drop("app_id").persist()
    checks = report.write_report(cleaned, str(tmp_path / "report"), Q.lexicon(spark), L.THEMES).collect()
    failed = {c.check_id for c in checks if not c.passed}
    assert failed == {"polarity_total_consistency"}  # reviews without polarity
    index = spark.read.option("header", True).csv(str(tmp_path / "report/figures/figure_index"))
    assert index.count() == len(charts.FIGURES) == 18


# ---------------------------------------------------------------- completeness

def test_values_outside_the_list_count_as_other(spark):
    table = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", None), ("b", "z"), (None, "y")], "row string, label string")
    got = {r.row: (r.x, r.y, r.unknown, r.other) for r in describe.cross_tab(table, "row", "label", ["x", "y"]).collect()}
    assert got == {"a": (1, 0, 0, 1), "b": (0, 0, 1, 1), "unknown": (0, 1, 0, 0)}
    got = {r.row: (r.x, r.unknown, r.other) for r in temporal.period_crosstab(table, "row", "label", ["x"]).collect()}
    assert got == {"a": (1, 0, 1), "b": (0, 1, 1), "unknown": (0, 0, 1)}


def test_repeated_ids_keep_their_own_emotions(spark):
    words = spark.createDataFrame([("joyful", "joy"), ("sad", "sadness")], "word string, emotion string")
    rows = spark.createDataFrame([("1", ["joyful"], 1), ("1", ["sad", "sad"], 2)], f"recommendationid string, tokens array<string>, {emotions.TOKENS} bigint")
    for limit in (2, 1):
        got = emotions.enrich_with_emotions(rows, words, limit=limit).select("joy_count", "sadness_count").collect()
        assert sorted(map(tuple, got)) == [(0, 2), (1, 0)]


def test_checks_look_at_each_product_alone(spark):
    rows = [("a", "total_reviews", "3"), ("a", "positive_reviews", "2"), ("a", "negative_reviews", "1"), ("b", "total_reviews", "3"), ("b", "positive_reviews", "0"), ("b", "negative_reviews", "3")]
    summary = spark.createDataFrame(rows, "app string, metric string, value string")
    assert [r.passed for r in quality.polarity_total(summary, ["app"]).collect()] == [True, True]
    ids = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "app string, recommendationid string")
    assert [r.passed for r in quality.unique_ids(ids, keys=["app"]).collect()] == [True, True]
    segments = spark.createDataFrame([("a", "overall"), ("a", "positive"), ("a", "negative"), ("b", "overall")], "app string, segment string")
    assert {r.app: r.passed for r in quality.expected_segments(segments, "s", keys=["app"]).collect()} == {"a": True, "b": False}


def test_progress_of_more_than_a_hundred_batches(spark, tmp_path):
    table = spark.range(0, 105, 1, 105)
    table.write.parquet(str(tmp_path / "in"))
    with streams.Batches(spark) as batches:
        streams.run_to_files(streams.read_files(spark, str(tmp_path / "in"), table.schema, 1), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = streams.progress(batches).collect()
    assert len(rows) == 105 and rows[-1].rows_kept_cumulative == 105


def test_dedup_forgets_ids_beyond_the_horizon(spark, tmp_path):
    for number, day in ((1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-02-01"), (1, "2024-03-01")):
        rows = spark.createDataFrame([(number, day)], "id long, day string").selectExpr("id", "cast(day as timestamp) as ts")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.read_files(spark, str(tmp_path / "in"), rows.schema, 1)
        streams.run_to_files(streams.dedup(source, ["id"], "ts", "7 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    kept = spark.read.parquet(str(tmp_path / "out")).selectExpr("cast(ts as date) as d").collect()
    assert sorted(str(r.d) for r in kept) == ["2024-01-01", "2024-02-01", "2024-03-01"]

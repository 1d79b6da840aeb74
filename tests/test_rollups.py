"""Daily states that merge, settings by product, and tables that are counted and checked while they are written."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from bindings import fixtures as B
from bindings import lookups as L
from bindings import queries as Q
from gleaner.operators import by_settings as BS
from gleaner.operators import rollups, temporal, text
from gleaner.sources import landing, tables


@pytest.fixture(scope="module")
def num(spark, sf_dir):
    return B.num(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def txt(spark, sf_dir):
    return B.txt(spark, sf_dir).persist()


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def jobs_of(spark, work):
    """What `work` returns, and how many jobs ran for it."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    found = work()
    spark.sparkContext.setJobGroup("", "")
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


# ---------------------------------------------------------------- daily states

def test_days_in_parts_equal_all_reviews(spark, num, tmp_path):
    path, n = str(tmp_path), F.crc32("recommendationid") % 3
    for batch in (0, 1, 2, 1):  # the last one again, as after a failure
        rollups.write_days(num.filter(n == batch), path, batch, Q.PLAYTIMES, ["steamid"], ["app_id"])
    days = rollups.read_days(spark, path)
    for period in (temporal.DAY, temporal.WEEK, temporal.MONTH):
        want = temporal.numeric_by_period(num, period, Q.PLAYTIMES, ["app_id"])
        assert rows(rollups.numeric_by_period(days, period, Q.PLAYTIMES, ["app_id"])) == rows(want)
    want = temporal.monthly_volume_extended(num, ["app_id"])
    assert rows(rollups.monthly_volume_extended(days, ["app_id"])) == rows(want)


def test_days_of_nothing(spark, num, tmp_path):
    rollups.write_days(num.limit(0), str(tmp_path), 0, Q.PLAYTIMES, ["steamid"])
    days = rollups.read_days(spark, str(tmp_path))
    assert rollups.monthly_volume_extended(days).count() == 0
    assert rollups.numeric_by_period(days, temporal.MONTH, Q.PLAYTIMES).count() == 0


def test_bitmaps_are_exact_for_any_whole_number(spark):
    values = [None, "0", "-1", "-32768", "32768", "32769", "76561198000000000", str(2**63 - 1), "5", "5"]
    df = spark.createDataFrame([(f"2024-01-0{i % 3 + 1}", v) for i, v in enumerate(values)], f"{temporal.DAY} string, id string")
    days = rollups.daily_ids(df, ["id"])
    assert rows(rollups.distinct_ids(days)) == [repr((8, "id"))]
    assert rows(rollups.distinct_ids(days, [temporal.DAY])) == rows(
        df.groupBy(temporal.DAY).agg(F.count_distinct("id").alias("distinct"), F.lit("id").alias("variable"))
    )


def test_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).select(F.concat(F.lit("person "), F.col("id") % 40_000).alias("id"), F.concat(F.lit("2024-01-0"), F.col("id") % 7 + 1).alias(temporal.DAY), (F.col("id") % 2).alias("app_id"))
    found = rollups.distinct_sketched(rollups.daily_sketches(df, ["id"], ["app_id"])).first()["distinct"]
    assert abs(found / 40_000 - 1) < 3 * 1.04 / 2 ** (rollups.SKETCH_LG / 2)


# ---------------------------------------------------------------- settings

def test_products_with_settings_of_their_own_equal_one_job_each(spark, sf_dir, txt):
    settings = Q.product_settings(spark, sf_dir)
    together = BS.corpus(txt, settings, L.STOPS)
    top = BS.frequency_table(text.term_counts(together, 1, ["app_id"]), settings, "top_n_unigrams")
    languages = BS.of_selected_languages(together, settings)
    for s in settings.collect():
        one = txt.filter(F.col("app_id") == s.app_id)
        own = text.text_subset(one, s.min_token_length, L.STOPS if s.remove_stopwords else None)
        assert rows(together.filter(F.col("app_id") == s.app_id).select(*own.columns)) == rows(own)
        table = text.frequency_table(text.term_counts(own, 1), s.top_n_unigrams)
        assert rows(top.filter(F.col("app_id") == s.app_id).select(*table.columns)) == rows(table)
        chosen = text.of_selected_languages(own, s.min_reviews_per_language, s.min_share_per_language)
        assert rows(languages.filter(F.col("app_id") == s.app_id).select(*chosen.columns)) == rows(chosen)


def test_missing_settings_are_the_defaults(spark):
    configs = spark.createDataFrame([(1, "{}"), (2, "no json"), (3, None), (4, '{"text_metrics": {"top_n_unigrams": 3}}')], "app_id long, value string")
    settings = BS.parse_settings(configs)
    default = tables.Settings()
    for r in settings.filter("app_id < 4").collect():
        assert {n: r[n] for n in BS.NAMES} == {n: getattr(default, n) for n in BS.NAMES}
    products = spark.createDataFrame([(None,), (4,), (9,)], "app_id long")
    found = BS.with_settings(products, settings, ["top_n_unigrams", "target_language"]).collect()
    assert sorted((r["app_id"] or 0, r["__top_n_unigrams"], r["__target_language"]) for r in found) == [(0, 200, "english"), (4, 3, "english"), (9, 200, "english")]


# ---------------------------------------------------------------- rejected pages, counts while writing

PAGES = [
    '{"success": 1, "cursor": "a", "reviews": [{"recommendationid": "1", "review": "two\\nlines", "author": {"steamid": "7"}}]}',
    '{"success": 1, "reviews": []}', '{"success": 1, "reviews": [{"recommend', "", "   ", None, "[1, 2]", "no json", '{"success": 1}',
    '{"success": 2, "reviews": []}', '{"reviews": [{"recommendationid": "2"}, {"recommendationid": null}]}',
]
REASONS = [None, None, landing.NO_JSON, *[landing.NO_TEXT] * 3, landing.NO_JSON, landing.NO_JSON, landing.NO_REVIEWS, landing.NO_SUCCESS, None]


def test_every_page_is_landed_or_rejected_with_its_reason(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page long, value string")
    found = {r.page: (r.reason, r.rejected_text) for r in landing.checked_pages(df).collect()}
    assert found == {i: (why, PAGES[i] if why else None) for i, why in enumerate(REASONS)}
    counts, jobs = jobs_of(spark, lambda: landing.land_pages(df, str(tmp_path / "landed")))
    assert counts == {"pages": REASONS.count(None), "rejected_pages": len(PAGES) - REASONS.count(None)} and jobs == 1
    good = landing.landed_pages(spark, str(tmp_path / "landed"))
    assert good.count() == counts["pages"] and landing.landed_pages(spark, str(tmp_path / "landed"), rejected=True).count() == counts["rejected_pages"]
    reviews = landing.flatten_pages(good, ["page"]).select("page", "recommendationid", "review", "steamid")
    assert sorted(map(repr, map(tuple, reviews.collect()))) == sorted(map(repr, [(0, "1", "two\nlines", "7"), (10, "2", None, None), (10, None, None, None)]))


def test_a_large_file_of_pages_is_split(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text("\n".join(f'{{"success": 1, "cursor": "{i}", "reviews": []}}' for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 << 10)
    try:
        lines = landing.read_page_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4 and landing.checked_pages(lines).filter("reason is null").count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_job_writes_and_counts(spark, sf_dir, tmp_path):
    chunks = spark.createDataFrame([(1, "a"), (2, " a "), (3, None), (4, ""), (5, "b"), (6, "  "), (7, "a")], "seq long, recommendationid string")
    counts, jobs = jobs_of(spark, lambda: landing.write_combined(chunks, str(tmp_path / "combined"), ["seq"]))
    assert counts == {"rows_written": 2, "duplicate_rows_skipped": 5}
    assert rows(spark.read.parquet(str(tmp_path / "combined"))) == rows(landing.combine_chunks(chunks, ["seq"]))
    _, plain = jobs_of(spark, lambda: landing.combine_chunks(chunks, ["seq"]).write.parquet(str(tmp_path / "plain")))
    assert jobs == plain
    none = landing.write_combined(chunks.limit(0), str(tmp_path / "none"), ["seq"])
    assert none == {"rows_written": 0, "duplicate_rows_skipped": 0}


def test_metadata_of_an_empty_table(spark, sf_dir, tmp_path):
    cleaned = Q.cleaned_columns(B.order_reviews(spark, sf_dir))
    found = tables.write_cleaned_counted(cleaned.filter("recommendationid = 'none'"), str(tmp_path / "empty"))
    assert found["rows_exported"] == 0 and found["languages_detected"] == 0

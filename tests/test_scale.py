"""Steps that must not gather a few large groups, or wide rows, in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bindings import queries as Q
from gleaner.operators import by_settings as BS
from gleaner.operators import prepare, rollups, temporal, text


@pytest.fixture
def by_shuffle(spark):
    """Plans as they are where nothing is small enough to be broadcast by the planner's own choice."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _corpus(spark):
    """Four hundred reviews in one language, ten in another, some without a product."""
    lang = F.when(F.col("id") < 400, "english").otherwise("french")
    product = F.when(F.col("id") % 41 != 0, F.lit(7).cast("bigint"))
    return spark.range(0, 410, 1, 8).select(product.alias("app_id"), lang.alias("language"), F.col("id"), F.lit(True).alias("is_positive"), F.lit(False).alias("is_negative"),
                                            F.array(F.lit("a"), F.concat(F.lit("w"), F.col("id"))).alias("tokens"))


def _largest(df) -> int:
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_selected_language_does_not_meet_in_one_task(spark, by_shuffle, monkeypatch, most):
    monkeypatch.setattr(text, "BROADCAST_LANGUAGES", most, raising=False)
    rows = _corpus(spark)
    chosen = text.of_selected_languages(rows, 100, 50.0)
    assert sorted(r.id for r in chosen.collect()) == list(range(400))
    assert sorted(chosen.columns) == sorted(rows.columns) and _largest(chosen) < 200
    by_product = text.of_selected_languages(rows, 100, 50.0, ["app_id"])
    assert sorted(r.id for r in by_product.collect()) == [i for i in range(400) if i % 41]
    counts = text.term_counts(chosen, 1, ["language"])
    assert {r.term: r.overall for r in counts.filter("overall > 1").collect()} == {"a": 400} and counts.count() == 401
    settings = BS.parse_settings(spark.createDataFrame([(7, "{}"), (None, "{}")], "app_id long, value string"))
    by_settings = BS.of_selected_languages(rows, settings)
    expected = text.language_shares(rows, ["app_id"]).filter(text.enough(100, 1.0)).select("app_id", "language")
    known = {tuple(r) for r in expected.collect()}
    assert sorted(r.id for r in by_settings.collect()) == sorted(r.id for r in rows.collect() if (r.app_id, r.language) in known)
    assert _largest(by_settings) < 200


def test_only_numbers_are_shuffled_for_bitmaps(spark, by_shuffle):
    df = spark.range(0, 20_000, 1, 8).select(F.concat(F.lit("2024-01-0"), F.col("id") % 10_000 % 2 + 1).alias(temporal.DAY), (F.col("id") % 10_000 * 7).cast("string").alias("person"))
    days = rollups.daily_ids(df, ["person"])
    plan = days._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
    shuffles = [i for i, x in enumerate(lines) if x.startswith("Exchange")]
    made = [i for i, x in enumerate(lines) if "bitmap_construct_agg" in x]
    assert len(shuffles) == 2 and max(made) < min(shuffles)  # plans are printed from the result down
    assert rollups.distinct_ids(days).first()["distinct"] == 10_000


def test_figures_share_the_rows_they_are_made_of(spark, sf_dir):
    plan = Q.figure_index(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # texts have been tokenised before, once per kind of rows


def test_an_overview_tokenises_the_texts_once(spark):
    rows = spark.createDataFrame(
        [(1, "english", "good good game day", True), (1, "english", "bad\x1cday", False), (1, "french", "  ", True)],
        "app_id long, language string, review string, is_positive boolean",
    ).withColumn("is_negative", ~F.col("is_positive"))
    corpus = text.text_subset(prepare.add_lengths(rows), 2, ["game"])
    overview = text.text_corpus_overview(corpus, ["language"], scope="by_language")
    # the stored rows have the vocabulary, so no pattern is left in what follows
    assert "regexp_extract_all" not in overview._jdf.queryExecution().optimizedPlan().toString()
    found = {r.metric: r.value for r in overview.filter("language = 'english'").collect()}
    assert (found["total_tokens"], found["total_unique_tokens"], found["average_review_length_words"]) == ("5", "3", "3.0")


def test_ngrams_are_counted_in_parts_of_a_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "TASK_BYTES", 200, raising=False)
    docs = spark.range(0, 101, 1, 1).selectExpr(
        "id as doc_id", "case when id % 2 = 0 then 'en' else 'fr' end as lang", "case when id < 100 then concat('good little words ', id) end as text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select cast(1 as bigint) as doc_id, 1 as quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.sql("select cast(1 as bigint) as o_orderkey, cast(1 as bigint) as o_custkey, '1-URGENT' as o_orderpriority, 'F' as o_orderstatus, date'2024-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select cast(1 as bigint) as l_orderkey, 1.0 as l_quantity, date'2024-01-02' as l_shipdate, 'R' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries = Q.queries()
    for name, first in (("top_trigrams", ("good little words", 100)), ("per_language_bigrams_overall", ("good little", 50))):
        found = queries[name](spark, str(tmp_path))
        assert "Repartition 10, true" in found._jdf.queryExecution().optimizedPlan().toString()  # 1,990 bytes of text
        assert tuple(found.filter("rank = 1").first()[found.columns.index("rank") + 1:][:2]) == first


def test_single_words_of_languages_are_counted_in_stored_rows(spark, sf_dir):
    names = [n for n in Q.queries() if n.startswith("per_language_") and "bigrams" not in n and n != "per_language_overview"]
    assert len(names) == 7
    for name in names:
        plan = Q.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan, name  # else each pass joins and tokenises the texts anew


def test_terms_of_a_language_do_not_meet_in_one_task(spark, by_shuffle):
    known = F.col("id") % 41 != 0
    language = F.when(known, "english")  # a null key has totals of its own
    rows = spark.range(0, 410, 1, 8).select(language.alias("language"), F.concat(F.lit("w"), F.col("id")).alias("term"),
                                            F.lit(1).alias("positive"), (F.col("id") % 2).alias("negative"))
    counted = text._with_totals(rows, ["language"], __a="positive", __b="negative")
    assert sorted(counted.columns) == sorted([*rows.columns, "__a", "__b"]) and _largest(counted) < 200
    assert {(r.language, r["__a"], r["__b"]) for r in counted.collect()} == {("english", 400, 200), (None, 10, 5)}
    assert counted.count() == 410
    ranked = text.distinctive_terms(rows, "positive", "negative", 3, ["language"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index(", Final"):plan.index(", Partial")]  # the first are taken before the shuffle, too
    assert [r.token for r in ranked.filter("language is not null").collect()] == ["w10", "w100", "w102"]

"""Every operator bound to the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import fixtures as B
from bindings import lookups as L
from gleaner.functions import constants as K
from gleaner.functions import exprs as X
from gleaner.functions import tokens as TK
from gleaner.functions.durable import checkpoint_folder, durable, stored
from gleaner.functions.stopwords import STOPWORDS
from gleaner.operators import by_settings as BS
from gleaner.operators import charts, describe, emotions, prepare, quality, rollups, temporal, text, themes
from gleaner.sources import id_store, landing, tables
from gleaner.sources import schema as S
from gleaner.streaming import ingest
from gleaner.streaming import reviews as streams

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession) -> str:
    """The full address of a new folder next to the checkpoints, which all executors reach."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def over(source: Callable, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source(spark, sf_dir))


def num(f: Callable[[DataFrame], DataFrame]) -> Query:
    return over(B.num, f)


def txt(f: Callable[[DataFrame], DataFrame]) -> Query:
    return over(B.txt, f)


def raw(f: Callable[[DataFrame], DataFrame]) -> Query:
    return over(B.raw_reviews, f)


def of_words(n: int) -> Callable[[SparkSession, str], DataFrame]:
    """The reviews that terms of `n` words are counted in."""
    return B.txt if n == 1 else B.txt_dealt


def corpus(f: Callable[[DataFrame], DataFrame], n: int = 1) -> Query:
    return over(of_words(n), lambda df: f(text.text_subset(df, 2, L.STOPS)))


def terms(n: int, f: Callable[[DataFrame], DataFrame]) -> Query:
    return corpus(lambda t: f(text.term_counts(t, n)), n)


# ---------------------------------------------------------------- ingest

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document reviews as landed pages: JSON text with a hundred reviews each and the author nested."""
    df = prepare.ensure_columns(B.document_reviews(spark, sf_dir)).withColumn("k", F.col("recommendationid").cast("bigint"))
    own = [c for c in S.RAW_COLUMNS if c not in S.AUTHOR_COLUMNS]
    review = F.struct("k", *own, F.struct(*S.AUTHOR_COLUMNS).alias("author"))
    page = df.groupBy(F.floor(F.col("k") / 100).cast("bigint").alias("page")).agg(
        F.array_sort(F.collect_list(review)).alias("reviews"), F.max("k").alias("last")
    )
    body = F.struct(
        F.lit(1).alias("success"), F.col("page").cast("string").alias("cursor"),
        F.struct(F.size("reviews").alias("num_reviews"), (F.col("last") + 1).alias("total_reviews")).alias("query_summary"),
        "reviews",
    )
    return page.select("page", F.to_json(body).alias("value"))


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.flatten_pages(landing.parse_pages(pages(spark, sf_dir)), ["page"])


def lenient_casts(df: DataFrame) -> DataFrame:
    return df.select("seq", *[landing.cast_raw(c, F.col(c)).alias(c) for c in [*S.LONG_COLUMNS, *S.BOOLEAN_COLUMNS]])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.order_reviews(spark, sf_dir).select("recommendationid", F.col("recommendationid").cast("bigint").alias("seq"))
    return landing.with_chunks(df, 1000)


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.order_reviews(spark, sf_dir)
    new = landing.only_new(df, df.filter(F.col("voted_up").isNotNull()))
    return new.select("recommendationid", "steamid", "timestamp_created")


def incremental_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later part against ids stored in a bucketed table."""
    df = landing.usable_ids(B.order_reviews(spark, sf_dir))
    store = id_store.open_ids(spark, _folder(spark))
    store.add(df.filter(F.col("voted_up").isNotNull()))
    return store.unseen(df).select("recommendationid", "steamid", "timestamp_created")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = landing.parse_pages(pages(spark, sf_dir))
    return landing.ingest_summary(parsed, landing.flatten_pages(parsed), 1000)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + "/csv"
    tables.write_csv(prepare.ensure_columns(B.document_reviews(spark, sf_dir)).select(*S.RAW_COLUMNS), path)
    kept = ["recommendationid", "language", "review", "timestamp_created", "voted_up", "playtime_forever"]
    return prepare.normalise(tables.read_raw_csv(spark, path)).select(*kept)


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written to folders of their own and read back in the order of their numbers."""
    folder = _folder(spark)
    df = prepare.ensure_columns(B.order_reviews(spark, sf_dir)).withColumn("seq", F.col("recommendationid").cast("bigint"))
    made = landing.with_chunks(df.select(*S.RAW_COLUMNS, "seq"), 1000).withColumn("name", F.format_string("reviews_part_%04d", "chunk_number"))
    tables.write_csv(made.drop("seq", "chunk_number"), f"{folder}/chunks", ["name"])
    read = landing.read_chunks(spark, f"{folder}/chunks")
    return landing.combine_chunks(read, ["chunk_number"]).select("chunk_number", "recommendationid", "steamid", "playtime_forever")


def json_records(df: DataFrame) -> DataFrame:
    return tables.json_records(
        df.select("recommendationid", "language", "voted_up", "votes_up", "days_to_developer_response")
    )


def json_whole_rows(df: DataFrame) -> DataFrame:
    """Whole cleaned rows as JSON text and read back; timestamps stay the text that they were written as."""
    whole = cleaned_columns(df)
    schema = ", ".join(f"`{c}` {'string' if t == 'timestamp' else t}" for c, t in whole.dtypes)
    return tables.json_records(whole).select(F.from_json("value", schema).alias("r")).select("r.*")


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages, some of them cut off, empty, unsuccessful or without reviews."""
    k, value = F.col("page"), F.col("value")
    text = (
        F.when(k % 7 == 0, F.substr(value, F.lit(1), F.length(value) - 5)).when(k % 11 == 0, '{"success": 1}')
        .when(k % 13 == 0, " ").when(k % 5 == 0, '{"success": 2, "reviews": []}').otherwise(value)
    )
    return pages(spark, sf_dir).select("page", text.alias("value"))


def landed(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    path = _folder(spark) + "/landed"
    return path, landing.land_pages(damaged_pages(spark, sf_dir), path)


def rejected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = landed(spark, sf_dir)
    return landing.landed_pages(spark, path, rejected=True).filter("rejected_text is not null").select("page", "reason")


def good_page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = landed(spark, sf_dir)
    return landing.flatten_pages(landing.landed_pages(spark, path), ["page"]).drop("position")


def combined_in_one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined table as written, each row with the counts of the job that wrote it."""
    path = _folder(spark) + "/combined"
    counts = landing.write_combined(B.raw_reviews(spark, sf_dir), path, ["seq"])
    return spark.read.parquet(path).select("seq", "recommendationid", *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()])


def metadata_in_one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.write_cleaned_counted(cleaned_columns(B.order_reviews(spark, sf_dir)), _folder(spark) + "/cleaned")
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} bigint" for k in found))


def product_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each product, spelled from its number; product 2 leaves most to the defaults."""
    products = B.order_reviews(spark, sf_dir).select("app_id").distinct()
    config = F.when(F.col("app_id") < 2, F.format_string(
        '{"text_metrics": {"top_n_unigrams": %d, "min_token_length": %d, "remove_stopwords": %s, "min_reviews_per_language": %d, "min_share_per_language": 30}, '
        '"emotion_metrics": {"target_language": " %s "}}',
        F.col("app_id") * 5 + 10, F.col("app_id") + 2, (F.col("app_id") == 0).cast("string"), F.col("app_id") * 40 + 30,
        F.when(F.col("app_id") == 0, "English").otherwise("german"),
    )).otherwise('{"text_metrics": {"top_n_unigrams": 7}}')
    return BS.parse_settings(products.select("app_id", config.alias("value")))


def by_settings(f: Callable[[DataFrame, DataFrame], DataFrame], **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        settings = product_settings(spark, sf_dir)
        return f(BS.corpus(B.txt(spark, sf_dir), settings, L.STOPS, **options), settings)

    return query


def settings_top_unigrams(corpus: DataFrame, settings: DataFrame) -> DataFrame:
    return BS.frequency_table(text.term_counts(corpus, 1, ["app_id"]), settings, "top_n_unigrams")


def settings_languages(corpus: DataFrame, settings: DataFrame) -> DataFrame:
    chosen = BS.of_selected_languages(corpus, settings)
    return chosen.groupBy("app_id", "language").agg(F.count(F.lit(1)).alias("reviews"), F.sum("token_count").alias("tokens"))


PLAYTIMES = ["playtime_at_review", "playtime_forever", "playtime_post_review"]


def from_days(f: Callable[[rollups.Days], DataFrame], keys: tuple[str, ...] = ()) -> Query:
    """A report out of daily states, which two batches of reviews have left in storage."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = _folder(spark) + "/days", B.num(spark, sf_dir)
        later = F.coalesce(F.crc32("recommendationid") % 3 == 0, F.lit(False))
        for batch, part in enumerate([df.filter(~later), df.filter(later)]):
            rollups.write_days(part, path, batch, PLAYTIMES, ["steamid", "recommendationid"], keys)
        return f(rollups.read_days(spark, path))

    return query


def lexicon_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon lines spelled from the orders, with bad lines, unknown categories and zero flags among them."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    emotion = F.element_at(F.array(*[F.lit(e) for e in [*K.EMOTIONS, "other"]]), (key % 11 + 1).cast("int"))
    word = F.concat(F.lit("w"), (customer % 500).cast("string"))
    line = F.concat_ws("\t", word, emotion, F.when(key % 13 != 0, (key % 2).cast("string")))
    return tables.parse_lexicon(B.table(spark, sf_dir, "orders").select(F.concat(line, F.lit("  ")).alias("value")))


def theme_dictionary_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries spelled from the orders, with padding, capitals, blanks and an entry that is no list."""
    body = F.format_string(
        '{" Theme %d ": ["Term%d", " long TERM %d ", " "], "note": "no list", "count": 3}',
        F.col("o_custkey") % 9, F.col("o_custkey") % 50, F.col("o_orderkey") % 20,
    )
    return tables.parse_themes(B.table(spark, sf_dir, "orders").select(body.alias("value")))


# ---------------------------------------------------------------- normalisation and derived columns

def unix_to_ts(df: DataFrame) -> DataFrame:
    shown = {ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts) for ts, _ in prepare.TIMES.values()}
    return df.select("recommendationid", *shown.values())


def prepared(df: DataFrame) -> DataFrame:
    cleaned = prepare.prepare_reviews(df)
    return cleaned.drop(*[ts for ts, _ in prepare.TIMES.values()])


def of_product(df: DataFrame) -> DataFrame:
    """The preparation of one product's reviews, which get its columns."""
    return prepare.prepare_reviews(df.drop("app_id"), (440, "a_game", "A Game")).select("recommendationid", "app_id", "game_slug", "game_title")


def pick(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("recommendationid", *columns)


DATE_COLUMNS = [
    *[day for _, day in prepare.TIMES.values()], "review_created_year", "review_created_month", "review_created_year_month",
]
FLAG_COLUMNS = [
    "is_positive", "is_negative", "has_text_review", "has_developer_response", "has_comments", "has_helpful_votes",
    "has_funny_votes", "is_steam_purchase", "is_free_copy", "is_early_access_review", "is_primarily_steam_deck",
]
PLAY_COLUMNS = [
    "playtime_post_review", "played_after_review", "review_updated_after_creation", "used_steam_deck_at_review",
    "recent_playtime_recorded",
]
BAND_COLUMNS = ["playtime_at_review_band", "num_reviews_band", "num_games_owned_band", "review_length_words_band"]
PERIOD_COLUMNS = [
    temporal.DAY, temporal.WEEK, temporal.MONTH, "review_updated_date_month", "developer_responded_date_month",
]


def without_context(df: DataFrame) -> DataFrame:
    """One corpus of several products has no single product to name."""
    return df.drop("app_id")


def cleaned_columns(df: DataFrame) -> DataFrame:
    return prepare.in_order(prepare.derive(prepare.ensure_columns(df)))


def missingness(df: DataFrame) -> DataFrame:
    return describe.missingness_summary(cleaned_columns(df).drop(*[ts for ts, _ in prepare.TIMES.values()]))


# ---------------------------------------------------------------- text, emotions, themes

def as_text(df: DataFrame, *more: str) -> DataFrame:
    return df.select("recommendationid", F.array_join("tokens", " ").alias("tokens"), *more)


def slugs(df: DataFrame) -> DataFrame:
    """Slugs of whole texts."""
    return df.select("recommendationid", X.slug(F.col("review")).alias("slug"))


def bigram_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(TK.ngrams("tokens", 2)).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


def selected(f: Callable[[DataFrame], DataFrame], n: int = 1) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted = corpus(lambda t: t)(spark, sf_dir)
        whole = counted if n == 1 else corpus(lambda t: t, n)(spark, sf_dir)
        return f(text.of_selected_languages(whole, 130, 20.0, counted=counted))

    return run


TEXT_NUMBERS = ["token_count", "review_length_words", "review_length_chars"]


def selected_once(f: Callable[[DataFrame], DataFrame], *more: str) -> Query:
    """Like `selected`, for single words: texts are joined and tokenised once and stored with the columns in `more`, as
    the languages, the segments, the terms and the numbers are each counted in a pass of their own."""
    wanted = ["language", "is_positive", "is_negative", "tokens", *more]
    return corpus(lambda t: f(text.of_selected_languages(stored(t.select(*wanted)), 130, 20.0)))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.LEXICON_PAIRS, "word string, emotion string")


def emo(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(
        emotions.enrich_with_emotions(emotions.emotion_subset(B.txt(spark, sf_dir)), lexicon(spark))
    )


def emotions_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a lexicon that is too large for a constant."""
    return emotions.enrich_with_emotions(emotions.emotion_subset(B.txt(spark, sf_dir)), lexicon(spark), limit=0)


def emotion_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = without_context(B.txt(spark, sf_dir))
    return emotions.emotion_overview(df, emotions.enrich_with_emotions(emotions.emotion_subset(df), lexicon(spark)))


def emotion_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotions.emotion_top_terms(emotions.emotion_subset(B.txt(spark, sf_dir)), lexicon(spark), 100)


def theme(f: Callable[[DataFrame], DataFrame]) -> Query:
    return txt(lambda df: f(themes.enrich_with_themes(themes.theme_subset(df), L.THEMES)))


def theme_phrases_of_tokens(df: DataFrame) -> DataFrame:
    return themes.enrich_with_themes(themes.theme_subset(df), L.THEMES, phrase_mode="token").select("recommendationid", *[f"{t}_count" for t in L.THEMES])


def theme_overview(df: DataFrame) -> DataFrame:
    df = without_context(df)
    return themes.theme_overview(df, themes.enrich_with_themes(themes.theme_subset(df), L.THEMES), L.THEMES)


def theme_match(df: DataFrame) -> DataFrame:
    once = themes.enrich_with_themes(themes.theme_subset(df), L.THEMES, count_every_hit=False)
    return once.select("recommendationid", *[f"{t}_count" for t in L.THEMES])


EMOTION_COLUMNS = [emotions.MATCHES, *[f"{e}_{x}" for e in K.EMOTIONS for x in ("count", "per_100_tokens")]]
THEME_COLUMNS = [
    themes.MATCHES, "themes_present_count",
    *[f"{t}_{x}" for t in L.THEMES for x in ("count", "present", "matched_terms", "per_100_tokens")],
]
CLOUD_LIMITS = {"unigram": (1, 2, 200), "bigram": (2, 2, 150), "trigram": (3, 2, 100)}


def cloud(n: int, label: str, top: int) -> Query:
    return over(of_words(n), lambda df: text.cloud_table(text.cloud_subset(df, "english"), n, label, 2, top))


def cloud_summary(df: DataFrame) -> DataFrame:
    return text.cloud_summary(df, text.cloud_subset(df, "english"), CLOUD_LIMITS)


# ---------------------------------------------------------------- report tables and charts

def signals(matches: str, tokens: str, names: list[str]) -> Callable[[DataFrame], DataFrame]:
    """What the tables of emotions or themes read of an enriched review."""
    return pick("is_positive", "is_negative", "review_created_year_month", tokens, matches, *[f"{x}_{c}" for x in names for c in ("count", "per_100_tokens")])


# Rows that several report tables are made of.
SHARED: dict[str, Query] = {
    "terms": terms(1, lambda c: c),
    "emotions": emo(signals(emotions.MATCHES, emotions.TOKENS, list(K.EMOTIONS))),
    "themes": theme(signals(themes.MATCHES, themes.TOKENS, list(L.THEMES))),
}
OF_SHARED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "top_unigrams_positive": ("terms", lambda c: text.frequency_table(c, 100, segment="positive")),
    "top_unigrams_negative": ("terms", lambda c: text.frequency_table(c, 100, segment="negative")),
    "distinctive_terms_positive_vs_negative": ("terms", lambda c: text.distinctive_terms(c, "positive", "negative", 100)),
    "distinctive_terms_negative_vs_positive": ("terms", lambda c: text.distinctive_terms(c, "negative", "positive", 100)),
    "emotion_distribution_summary": ("emotions", emotions.emotion_distribution),
    "emotion_by_polarity": ("emotions", emotions.emotion_by_polarity),
    "emotion_by_month": ("emotions", emotions.emotion_by_month),
    "theme_distribution_summary": ("themes", lambda e: themes.theme_distribution(e, L.THEMES)),
    "theme_by_polarity": ("themes", lambda e: themes.theme_by_polarity(e, L.THEMES)),
    "theme_by_month": ("themes", lambda e: themes.theme_by_month(e, L.THEMES)),
}
REPORT: dict[str, Query] = {
    "polarity_summary": num(describe.polarity_summary),
    "language_distribution": num(describe.language_distribution),
    "cross_tab_polarity_by_playtime_band": num(lambda df: describe.polarity_by(df, "playtime_at_review_band")),
    "monthly_review_volume_extended": num(temporal.monthly_volume_extended),
    "monthly_polarity_trends": num(temporal.monthly_polarity_trends),
    "monthly_language_trends": num(temporal.monthly_language_trends),
    "developer_response_timeline": num(temporal.response_timeline),
    **{name: over(SHARED[source], f) for name, (source, f) in OF_SHARED.items()},
}

# Query name -> figure it shows.
FIGURE_QUERIES = {
    "fig_polarity": "figure_01", "fig_language_top10": "figure_02", "fig_polarity_band": "figure_03",
    "fig_monthly_volume": "figure_04", "fig_monthly_polarity": "figure_05", "fig_positive_pct": "figure_06",
    "fig_language_top5": "figure_07", "fig_response": "figure_08", "fig_unigrams_pos": "figure_09",
    "fig_unigrams_neg": "figure_10", "fig_distinctive_pos": "figure_11", "fig_distinctive_neg": "figure_12",
    "fig_emotion": "figure_13", "fig_emotion_polarity": "figure_14", "fig_emotion_month": "figure_15",
    "fig_theme": "figure_16", "fig_theme_polarity": "figure_17", "fig_theme_month": "figure_18",
}


def figure(figure_id: str) -> Query:
    spec = next(f for f in charts.FIGURES if f.figure_id == figure_id)
    return lambda spark, sf_dir: spec.transform(REPORT[spec.source_table](spark, sf_dir))


FIGURES_BY_PRODUCT: dict[str, Query] = {
    "fig_polarity_by_product": num(lambda df: charts.polarity_distribution(describe.polarity_summary(df, ["app_id"]), ["app_id"])),
    "fig_language_top10_by_product": num(lambda df: charts.language_top10(describe.language_distribution(df, ["app_id"]), ["app_id"])),
}


def figure_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared rows are stored, so that texts are tokenised and enriched once for all figures."""
    stored = {name: durable(q(spark, sf_dir)) for name, q in SHARED.items()}
    made = {name: f(stored[source]) for name, (source, f) in OF_SHARED.items()}
    return charts.figure_index(charts.figure_tables({**{name: q(spark, sf_dir) for name, q in REPORT.items() if name not in made}, **made}))


# ---------------------------------------------------------------- checks

def dq_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["recommendationid", "review", "language", "voted_up"]
    return quality.all_checks(
        quality.required_columns(B.raw_reviews(spark, sf_dir), wanted, "raw_required_columns"),
        quality.required_columns(B.order_reviews(spark, sf_dir), wanted, "orders_required_columns"),
    )


def dq_index_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks(spark, sf_dir)
    return quality.index_matches_chunks(landing.chunk_index(made), made)


def dq_final_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.final_total_matches_chunks(ingest_summary(spark, sf_dir), B.document_reviews(spark, sf_dir))


def dq_combined(df: DataFrame) -> DataFrame:
    return quality.combined_matches_chunks(landing.combine_chunks(df, ["seq"]), df)


DQ: dict[str, Query] = {
    "dq_required_columns": dq_required,
    "dq_non_empty": over(B.order_reviews, lambda df: quality.non_empty(df, "reviews_non_empty")),
    "dq_unique_id": raw(quality.unique_ids),
    "dq_cross_chunk": raw(quality.unique_across_chunks),
    "dq_polarity_total": num(lambda df: quality.polarity_total(describe.polarity_summary(df))),
}


DQ_BY_PRODUCT: dict[str, Query] = {
    "dq_unique_id_by_product": raw(lambda df: quality.unique_ids(df, keys=["app_id"])),
    "dq_polarity_total_by_product": num(lambda df: quality.polarity_total(describe.polarity_summary(df, ["app_id"]), ["app_id"])),
}


def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_summary(quality.all_checks(*[q(spark, sf_dir) for q in DQ.values()]))


# ---------------------------------------------------------------- streams

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").withColumns({
        "is_positive": F.col("event_type") == "purchase", "is_negative": F.col("event_type") == "error",
    })


def _landed(spark: SparkSession, sf_dir: str, files: int = 4) -> tuple[str, DataFrame]:
    """The events as several files in a fresh folder, the way they would arrive."""
    folder, events = _folder(spark), _events(spark, sf_dir)
    events.repartitionByRange(files, "event_id").write.parquet(f"{folder}/in")
    return folder, events


def _landed_in_turn(spark: SparkSession, sf_dir: str, files: int = 4) -> tuple[str, DataFrame]:
    """The events as files cut at fixed ids, which arrive one after the other."""
    folder, events = _folder(spark), _events(spark, sf_dir)
    _arrive_in_turn(events, folder, 4, range(files))
    return folder, events


def _arrive_in_turn(events: DataFrame, folder: str, parts: int, which: range) -> None:
    size = events.agg(F.max("event_id")).first()[0] // parts + 1
    for i in which:
        part = events.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")


KEPT = ["event_id", "user_id", "event_type", "value"]


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice; each is kept once."""
    folder, events = _landed(spark, sf_dir)
    events.write.mode("append").parquet(f"{folder}/in")
    source = streams.read_files(spark, f"{folder}/in", events.schema, 1)
    streams.run_to_files(streams.dedup(source, ["event_id"]).select(*KEPT), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs on one checkpoint; the repeats that arrive in between are not taken again."""
    folder, events = _landed(spark, sf_dir)
    for _ in range(2):
        source = streams.read_files(spark, f"{folder}/in", events.schema)
        streams.run_to_files(streams.dedup(source, ["event_id"]).select(*KEPT), f"{folder}/out", f"{folder}/state")
        events.write.mode("append").parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/out")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, events = _landed_in_turn(spark, sf_dir)
    source = streams.read_files(spark, f"{folder}/in", events.schema, 1)
    with streams.Batches(spark) as batches:
        streams.run_to_files(streams.dedup(source, ["event_id"]), f"{folder}/out", f"{folder}/state")
    return streams.progress(batches)


def stream_lost_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs without a common checkpoint; the second reads everything again and the repeats as well."""
    folder, events = _landed(spark, sf_dir)
    for state in ("first", "second"):
        source = streams.read_files(spark, f"{folder}/in", events.schema)
        kept = ingest.ingest(source, id_store.open_ids(spark, f"{folder}/ids", {"event_id": "bigint"}), f"{folder}/out", f"{folder}/{state}")
        events.write.mode("append").parquet(f"{folder}/in")
    return kept.select(*KEPT)


def stream_progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files, then all of them with a fresh checkpoint: the log goes on, and what is stored is not kept again."""
    folder, events = _landed_in_turn(spark, sf_dir, 2)
    for state, files in (("first", 0), ("second", 2)):
        if files:
            _arrive_in_turn(events, folder, 4, range(2, 4))
        source = streams.read_files(spark, f"{folder}/in", events.schema, 1)
        ingest.ingest(source, id_store.open_ids(spark, f"{folder}/ids", {"event_id": "bigint"}), f"{folder}/out", f"{folder}/{state}")
    return ingest.progress(spark, f"{folder}/out").drop("finished_at")


def stream_table(keys: list[str], f: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, events = _landed(spark, sf_dir)
        source = streams.read_files(spark, f"{folder}/in", events.schema, 1)
        return ingest.run_to_changes(f(source), keys, f"{folder}/out", f"{folder}/state")
    return run


def stream_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that come in two runs: the second brings every third event, for days that the first has counted already."""
    folder, events = _folder(spark), _events(spark, sf_dir)
    for late in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        events.filter(late).write.mode("append").parquet(f"{folder}/in")
        source = streams.read_files(spark, f"{folder}/in", events.schema)
        days = ingest.run_to_changes(streams.daily_volume(source, "ts"), ["day"], f"{folder}/out", f"{folder}/state", fold_every=1)
    return days


# ---------------------------------------------------------------- registry

def queries() -> dict[str, Query]:
    n: dict[str, Query] = {}

    n["flatten_reviews"] = lambda spark, sf_dir: flattened(spark, sf_dir).drop("position")
    n["lenient_casts"] = raw(lenient_casts)
    n["ingest_dedup"] = raw(lambda df: landing.ingest_dedup(df, ["seq"]).select("seq", "recommendationid"))
    n["combine_chunks"] = raw(lambda df: landing.combine_chunks(df, ["seq"]).select("seq", "recommendationid"))
    n["combine_counts"] = raw(landing.combine_counts)
    n["chunk_files"] = chunk_files
    n["chunk_index"] = over(chunks, lambda c: landing.chunk_index(c, "orders"))
    n["incremental_anti_join"] = incremental
    n["ingest_summary"] = ingest_summary
    n["csv_round_trip"] = csv_round_trip
    n["json_records"] = num(json_records)
    n["json_whole_rows"] = over(B.order_reviews, json_whole_rows)
    n["preparation_metadata"] = over(B.order_reviews, lambda df: tables.preparation_metadata(cleaned_columns(df)))
    n["rejected_pages"], n["good_page_reviews"] = rejected_pages, good_page_reviews
    n["combined_in_one_job"], n["metadata_in_one_job"] = combined_in_one_job, metadata_in_one_job
    n["settings_load"] = product_settings
    n["settings_top_unigrams"] = by_settings(settings_top_unigrams)
    n["settings_languages"] = by_settings(settings_languages)
    n["settings_target_language"] = by_settings(lambda c, s: c.select("recommendationid", "app_id", "token_count"), language=True)
    n["monthly_volume_from_days"] = from_days(rollups.monthly_volume_extended)
    n["monthly_playtime_from_days"] = from_days(lambda d: rollups.numeric_by_period(d, temporal.MONTH, PLAYTIMES))
    n["weekly_playtime_from_days"] = from_days(lambda d: rollups.numeric_by_period(d, temporal.WEEK, PLAYTIMES, ["app_id"]), ("app_id",))
    n["distinct_from_days"] = from_days(lambda d: rollups.distinct_ids(d.ids, ["app_id"]), ("app_id",))
    n["lexicon_load"] = lexicon_load
    n["theme_dictionary_load"] = theme_dictionary_load

    n["ensure_columns"] = over(B.order_reviews, lambda df: prepare.ensure_columns(df).select(
        "recommendationid", "review", "weighted_vote_score", "votes_up"))
    n["normalise_strings"] = raw(lambda df: prepare.normalise_strings(df).select("seq", *S.STRING_COLUMNS))
    n["normalise_numbers"] = raw(lambda df: prepare.normalise_numbers(df).select("seq", *S.LONG_COLUMNS))
    n["normalise_booleans"] = raw(lambda df: prepare.normalise_booleans(df).select("seq", *S.BOOLEAN_COLUMNS))
    n["normalise_language"] = raw(lambda df: prepare.normalise_language(prepare.normalise_strings(df)).select("seq", "language"))
    n["clean_text"] = raw(lambda df: prepare.normalise_text(prepare.normalise_strings(df)).select("seq", "review"))
    n["unix_to_ts"] = num(unix_to_ts)
    n["dedup_keep_first"] = raw(lambda df: prepare.keep_first(df, ["recommendationid"], ["seq"]).select("seq", "recommendationid"))
    n["prepare_reviews"] = raw(prepared)
    n["prepare_product"] = raw(of_product)
    n["lost_values"] = raw(prepare.lost_values)

    n["datetime_columns"] = num(pick(*DATE_COLUMNS))
    n["text_lengths"] = txt(pick(*describe.TEXT_VARIABLES))
    n["status_flags"] = txt(pick(*FLAG_COLUMNS))
    n["playtime_flags"] = num(pick(*PLAY_COLUMNS))
    n["day_intervals"] = num(pick(*describe.INTERVAL_VARIABLES))
    n["band_columns"] = txt(pick(*BAND_COLUMNS))
    n["period_keys"] = num(pick(*PERIOD_COLUMNS))

    n["dataset_overview"] = num(lambda df: describe.dataset_overview(df, ["app_id"]))
    n["polarity_summary"] = REPORT["polarity_summary"]
    n["language_distribution"] = REPORT["language_distribution"]
    every = [
        *describe.PROFILE_VARIABLES, *describe.PLAYTIME_VARIABLES, *describe.INTERACTION_VARIABLES,
        *describe.TEXT_VARIABLES, *describe.INTERVAL_VARIABLES,
    ]
    n["numeric_summary"] = txt(lambda df: describe.numeric_summary(df, every))
    n["reviewer_profile_summary"] = num(lambda df: describe.numeric_summary(df, describe.PROFILE_VARIABLES))
    n["playtime_summary"] = num(lambda df: describe.numeric_summary(df, describe.PLAYTIME_VARIABLES))
    n["interaction_summary"] = num(lambda df: describe.numeric_summary(df, describe.INTERACTION_VARIABLES))
    n["text_summary"] = txt(lambda df: describe.numeric_summary(df, describe.TEXT_VARIABLES))
    n["temporal_interval_summary"] = num(lambda df: describe.numeric_summary(df, describe.INTERVAL_VARIABLES))
    n["flag_summary"] = num(describe.flag_summary)
    n["missingness_summary"] = over(B.order_reviews, missingness)
    n["concentration_summary"] = txt(describe.concentration_summary)
    n["cross_tab"] = num(lambda df: describe.cross_tab(df, "language", "num_reviews_band", K.REVIEWER_LABELS, percentages=False))
    n["xtab_language"] = num(lambda df: describe.polarity_by(df, "language"))
    n["xtab_playtime"] = REPORT["cross_tab_polarity_by_playtime_band"]
    n["xtab_reviewer"] = num(lambda df: describe.polarity_by(df, "num_reviews_band"))
    n["xtab_library"] = num(lambda df: describe.polarity_by(df, "num_games_owned_band"))
    n["monthly_review_volume"] = num(describe.monthly_review_volume)

    n["numeric_by_period"] = num(lambda df: temporal.numeric_by_period(df, temporal.WEEK, ["playtime_forever", "votes_up"]))
    n["flag_rate_by_period"] = num(lambda df: temporal.flag_rate_by_period(df, temporal.WEEK, ["has_comments", "is_free_copy"]))
    n["period_crosstab"] = num(lambda df: temporal.period_crosstab(
        df, temporal.RESPONSE_MONTH, "playtime_at_review_band", K.PLAYTIME_LABELS))
    n["temporal_coverage"] = num(lambda df: temporal.temporal_coverage(df, ["app_id"]))
    n["daily_volume"] = num(temporal.daily_volume)
    n["weekly_volume"] = num(temporal.weekly_volume)
    n["monthly_volume_extended"] = REPORT["monthly_review_volume_extended"]
    n["monthly_polarity_trends"] = REPORT["monthly_polarity_trends"]
    n["monthly_language_trends"] = REPORT["monthly_language_trends"]
    n["monthly_text_length"] = txt(temporal.monthly_text_length)
    n["monthly_playtime"] = num(temporal.monthly_playtime)
    n["monthly_reviewer_profile"] = num(temporal.monthly_reviewer_profile)
    n["monthly_interaction"] = num(temporal.monthly_interaction)
    n["review_updates"] = num(temporal.review_updates)
    n["response_timeline"] = REPORT["developer_response_timeline"]
    n["monthly_polarity_by_language"] = num(temporal.monthly_polarity_by_language)
    n["monthly_polarity_by_band"] = num(temporal.monthly_polarity_by_band)
    n["peak_activity"] = num(temporal.peak_activity)

    n["tokenise"] = txt(lambda df: as_text(text.text_subset(df, 1, None), "token_count"))
    n["stopword_filter"] = txt(lambda df: as_text(text.text_subset(df, 2, STOPWORDS), "token_count"))
    n["ngrams"] = corpus(bigram_counts, 2)
    n["text_subset"] = corpus(lambda t: t.select("recommendationid", "language", "token_count"))
    n["term_counts"] = terms(1, lambda c: c)
    for s in K.SEGMENTS:
        n[f"top_unigrams_{s}"] = terms(1, lambda c, s=s: text.frequency_table(c, 100, "token", s))
        n[f"top_bigrams_{s}"] = terms(2, lambda c, s=s: text.frequency_table(c, 50, "bigram", s))
    n["top_trigrams"] = terms(3, lambda c: text.frequency_table(c, 30, "trigram"))
    n["text_corpus_overview"] = corpus(lambda t: text.text_corpus_overview(without_context(t), (), 100, 5.0))
    n["per_language_overview"] = corpus(lambda t: text.text_corpus_overview(without_context(t), ["language"], scope="by_language"))
    n["text_by_polarity"] = corpus(text.text_by_polarity)
    n["text_by_band"] = corpus(text.text_by_band)
    n["text_by_language"] = corpus(text.text_by_language)
    n["top_terms_by_language"] = corpus(lambda t: text.top_terms_by_language(t, 100))
    n["distinctive_pos_vs_neg"] = REPORT["distinctive_terms_positive_vs_negative"]
    n["distinctive_neg_vs_pos"] = REPORT["distinctive_terms_negative_vs_positive"]
    n["language_selection"] = corpus(lambda t: text.select_languages(t, 130, 20.0))
    n["per_language_top_terms"] = selected_once(lambda t: text.top_terms_by_language(t, 50))
    n["per_language_distinctive"] = selected_once(lambda t: text.distinctive_terms(
        text.term_counts(t, 1, ["language"]), "positive", "negative", 50, ["language"]))
    n["per_language_distinctive_negative"] = selected_once(lambda t: text.distinctive_terms(
        text.term_counts(t, 1, ["language"]), "negative", "positive", 50, ["language"]))
    for s in K.SEGMENTS:
        if s != "overall":
            n[f"per_language_unigrams_{s}"] = selected_once(lambda t, s=s: text.frequency_table(
                text.term_counts(t, 1, ["language"]), 50, "token", s, ["language"]))
        n[f"per_language_bigrams_{s}"] = selected(lambda t, s=s: text.frequency_table(
            text.term_counts(t, 2, ["language"]), 50, "bigram", s, ["language"]), 2)
    n["per_language_by_polarity"] = selected_once(lambda t: text.text_by_polarity(t, ["language"]), *TEXT_NUMBERS)
    n["per_language_by_band"] = selected_once(
        lambda t: text.text_by_band(t, ["language"]), *TEXT_NUMBERS, "playtime_at_review_band")
    n["slugify"] = over(B.document_reviews, slugs)

    n["emotion_subset"] = txt(lambda df: emotions.emotion_subset(df).select("recommendationid", emotions.TOKENS))
    n["emotion_enrich"] = emo(pick(*EMOTION_COLUMNS))
    n["emotion_enrich_by_join"] = lambda spark, sf_dir: pick(*EMOTION_COLUMNS)(emotions_by_join(spark, sf_dir))
    n["emotion_overview"] = emotion_overview
    n["emotion_distribution"] = REPORT["emotion_distribution_summary"]
    n["emotion_by_polarity"] = REPORT["emotion_by_polarity"]
    n["emotion_by_band"] = emo(emotions.emotion_by_band)
    n["emotion_by_month"] = REPORT["emotion_by_month"]
    n["emotion_top_terms"] = emotion_top_terms

    n["theme_subset"] = txt(lambda df: themes.theme_subset(df).select("recommendationid", themes.TOKENS))
    n["theme_match"] = txt(theme_match)
    n["theme_phrases_of_tokens"] = txt(theme_phrases_of_tokens)
    n["theme_enrich"] = theme(pick(*THEME_COLUMNS))
    n["theme_overview"] = txt(theme_overview)
    n["theme_distribution"] = REPORT["theme_distribution_summary"]
    n["theme_by_polarity"] = REPORT["theme_by_polarity"]
    n["theme_by_band"] = theme(lambda e: themes.theme_by_band(e, L.THEMES))
    n["theme_by_month"] = REPORT["theme_by_month"]
    n["theme_top_terms"] = theme(themes.theme_top_terms)

    for name, figure_id in FIGURE_QUERIES.items():
        n[name] = figure(figure_id)
    n["figure_index"] = figure_index
    n.update(FIGURES_BY_PRODUCT)

    n["cloud_unigrams"] = cloud(1, "unigram", 200)
    n["cloud_bigrams"] = cloud(2, "bigram", 150)
    n["cloud_trigrams"] = cloud(3, "trigram", 100)
    n["cloud_summary"] = txt(cloud_summary)

    n.update(DQ)
    n.update(DQ_BY_PRODUCT)
    n["dq_combined_vs_chunks"] = raw(dq_combined)
    n["dq_index_total"] = dq_index_total
    n["dq_final_total"] = dq_final_total
    n["dq_segments"] = emo(lambda e: quality.expected_segments(emotions.emotion_by_polarity(e), "emotion_by_polarity_expected_segments"))
    n["dq_summary"] = dq_summary

    n["stream_dedup"] = stream_dedup
    n["stream_resume"] = stream_resume
    n["stream_progress"] = stream_progress
    n["stream_daily_volume"] = stream_table(["day"], lambda e: streams.daily_volume(e, "ts"))
    n["stream_weekly_volume"] = stream_table(["week"], lambda e: streams.weekly_volume(e, "ts"))
    n["stream_monthly_polarity"] = stream_table(["month", "event_type"], lambda e: streams.monthly_polarity(e, "ts", "event_type"))
    n["stream_late_days"] = stream_late_days
    n["stream_lost_state"] = stream_lost_state
    n["stream_progress_log"] = stream_progress_log
    n["incremental_bucketed"] = incremental_bucketed
    return n

"""Lexical tables. Tokens are counted with map-side combine, so a frequent token costs one row per map task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X
from gleaner.functions.durable import durable, stored
from gleaner.functions import tokens as TK
from gleaner.functions.stopwords import STOPWORDS, WORD_CLOUD_STOPWORDS
from gleaner.operators import profile as P


#: Chosen languages (of all keys) up to which they are broadcast; the parts that the texts of each are dealt out in beyond it,
#: and the terms of each key where they meet its totals.
BROADCAST_LANGUAGES, PARTS = 100_000, 64
#: Bytes of text whose n-grams one task counts; they then stay in its memory.
TASK_BYTES = 16 << 20


# ---------------------------------------------------------------- subsets and counts

def text_subset(
    df: DataFrame,
    min_length: int = 2,
    stopwords: TK.Stopwords = STOPWORDS,
    language: str | None = None,
    tokens: str = "tokens",
    token_count: str = "token_count",
) -> DataFrame:
    """Rows with usable text, their tokens and token count; optionally of one language only.

    Cleaned tables hold languages in lower case, so the language filter is a plain comparison that reaches the scan.
    Tokens come out of a generator, which keeps the optimizer from evaluating the pattern a second time for the final
    filter.
    """
    lang = X.or_unknown(F.col("language"))
    if language is not None:
        known = F.col("language") == language
        df = df.filter(known | F.col("language").isNull() if language == "unknown" else known)
    df = df.filter(F.col("review").isNotNull()).withColumns({"language": lang, "review": X.strip(F.col("review"))})
    made = F.explode(F.array(TK.tokens("review", stopwords, min_length))).alias(tokens)
    return (
        df.filter(F.col("review") != "").select("*", made)
        .filter(F.size(tokens) > 0)
        .withColumn(token_count, F.size(tokens).cast("bigint"))
    )


def parts_of(texts: DataFrame, column: str) -> int:
    """Into how many parts the texts of a table are dealt, from one pass over their lengths."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return -(-size // TASK_BYTES)


def dealt(reviews: DataFrame, parts: int) -> DataFrame:
    """Reviews in so many parts of about equal numbers, for the counts of n-grams.

    Most n-grams are rare, so their counts before the shuffle take several times the bytes of a task's texts, and what
    does not fit its memory is written to disk, merged and read again. With as few parts as cores the rows stay as they are.
    """
    return reviews.repartition(parts) if parts > reviews.sparkSession.sparkContext.defaultParallelism else reviews


def term_counts(text: DataFrame, n: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, term, overall, positive, negative)`: one aggregation serves all segments and the contrasts."""
    terms = text.select(*keys, "is_positive", "is_negative", F.explode(TK.ngrams("tokens", n)).alias("term"))
    return terms.groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("overall"),
        F.count_if("is_positive").alias("positive"),
        F.count_if("is_negative").alias("negative"),
    )


def _totals(counts: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(source).alias(name) for name, source in columns.items()])


def _with_totals(counts: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Counts with the totals of their key.

    A join on the keys alone would put all terms of a key into one task, which would rank them there too. Terms are dealt
    out by their hash, and each part meets a copy of the totals.
    """
    totals = _totals(counts, keys, **columns)
    if not keys:
        return X.attach(counts, totals, keys, list(columns))
    dealt = counts.withColumn("__part", F.pmod(F.hash("term"), F.lit(PARTS)))
    copies = totals.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return X.attach(dealt, copies, [*keys, "__part"], list(columns)).drop("__part")


def frequency_table(
    counts: DataFrame, n: int, label: str = "token", segment: str = "overall", keys: Sequence[str] = ()
) -> DataFrame:
    """Top `n` terms with rank and frequency per 1000 of all terms, ties by term."""
    unit = f"{label}s"
    used = counts.filter(F.col(segment) > 0).select(*keys, F.col("term").alias(label), F.col(segment).alias("frequency"))
    top = X.top_ranked(used, keys, n, F.desc("frequency"), F.asc(label))
    total = _totals(counts, keys, __total=segment)
    relative = X.per_thousand(F.col("frequency"), F.col("__total")).alias(f"relative_frequency_per_1000_{unit}")
    return X.attach(top, total, keys, ["__total"]).select(*keys, "rank", label, "frequency", relative)


def top_terms_by_language(text: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    group = [*keys, "language"]
    return frequency_table(term_counts(text, 1, group), n, keys=group)


def distinctive_terms(counts: DataFrame, a: str, b: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Terms over-represented in segment `a` against `b`, over the union of both vocabularies."""
    both = _with_totals(counts, keys, __a=a, __b=b).filter((F.col(a) > 0) | (F.col(b) > 0))
    ra, rb = [F.coalesce(F.try_divide(F.col(s), F.col(t)), F.lit(0.0)) for s, t in ((a, "__a"), (b, "__b"))]
    table = both.select(
        *keys, F.col("term").alias("token"),
        F.col(a).alias(f"{a}_frequency"), F.col(b).alias(f"{b}_frequency"),
        F.round(ra * 1000, 6).alias(f"{a}_relative_per_1000"), F.round(rb * 1000, 6).alias(f"{b}_relative_per_1000"),
        F.round((ra - rb) * 1000, 6).alias("difference_per_1000"),
        F.round(F.log2((ra + 1e-12) / (rb + 1e-12)), 6).alias("log_ratio"),
    )
    order = [F.desc("difference_per_1000"), F.desc(f"{a}_frequency"), F.asc("token")]
    return X.top_ranked(table, keys, n, *order).drop("rank")


# ---------------------------------------------------------------- corpus metrics

# Reported length statistic -> (profiled column, statistic of the profile)
_LENGTHS = {
    f"{s}_review_length_{u}": (f"review_length_{u}", q)
    for u in ("words", "chars") for s, q in (("mean", "mean"), ("median", P.quantile_column(0.5)))
}


_NUMBERS = ["token_count", "review_length_words", "review_length_chars"]
_FLAGS = {f"__{c}": c for c in ("is_positive", "is_negative")}


def _numbers(text: DataFrame, more: Sequence[str]) -> DataFrame:
    """A few numbers per row, its distinct tokens and the columns in `more`, from one pass over the texts, in the checkpoint folder."""
    flags = {flag: F.col(c).cast("int") for flag, c in _FLAGS.items() if c in text.columns}
    terms = [F.array_distinct("tokens").alias("tokens")] if "tokens" in text.columns else []
    return stored(text.withColumns(flags).select(*more, *_NUMBERS, *flags, *terms))


def _sizes(numbers: DataFrame, group: Sequence[str]) -> DataFrame:
    """Reviews, tokens, polarity and lengths per group of stored `_numbers`."""
    flags = [flag for flag in _FLAGS if flag in numbers.columns]
    stats = P.numeric_profile(numbers, group, [*_NUMBERS, *flags], [0.5])

    def of(variable: str, stat: str) -> Column:
        return F.max(F.when(F.col("variable") == variable, F.col(stat)))

    def whole(variable: str, stat: str) -> Column:
        return F.coalesce(of(variable, stat), F.lit(0)).cast("bigint")

    return stats.groupBy(*group).agg(
        whole("token_count", "count_non_null").alias("review_count"),
        whole("token_count", "sum").alias("total_tokens"),
        *[whole(flag, "sum").alias(f"{flag.removeprefix('__is_')}_review_count") for flag in flags],
        *[F.round(of(variable, stat), 4).alias(name) for name, (variable, stat) in _LENGTHS.items()],
    )


def _ttr() -> Column:
    return X.ratio(F.col("unique_tokens"), F.col("total_tokens"), 6)


def _unique_tokens(text: DataFrame, keys: Sequence[str]) -> DataFrame:
    terms = text.select(*keys, F.explode("tokens").alias("term")).distinct()
    return terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_tokens"))


def _metrics(text: DataFrame, group: Sequence[str], numbers: DataFrame | None = None) -> DataFrame:
    numbers = _numbers(text, group) if numbers is None else numbers
    with_unique = X.attach(_sizes(numbers, group), _unique_tokens(numbers, group), group, ["unique_tokens"])
    return with_unique.withColumn("type_token_ratio", _ttr())


def language_shares(text: DataFrame, keys: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    counts = text.groupBy(*keys, X.or_unknown(F.col("language")).alias("language")).agg(
        F.count(F.lit(1)).alias("review_count"), *[F.any_value(c, ignoreNulls=True).alias(c) for c in context]
    )
    total = F.sum("review_count").over(X.over_keys(keys))
    return counts.withColumn("review_percentage", X.pct(F.col("review_count"), total))


def enough(min_reviews: int | Column, min_share: float | Column) -> Column:
    return (F.col("review_count") >= min_reviews) | (F.col("review_percentage") >= min_share)


def select_languages(
    text: DataFrame, min_reviews: int = 100, min_share: float = 1.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Languages with enough reviews or a large enough share for tables of their own."""
    return language_shares(text, keys).filter(enough(min_reviews, min_share))


def text_corpus_overview(
    text: DataFrame, keys: Sequence[str] = (), min_reviews: int = 100, min_share: float = 1.0, scope: str = "global"
) -> DataFrame:
    """Size, vocabulary and length of the corpus; with scope `by_language` once per language in `keys`."""
    context = [c for c in ("app_id", "game_slug", "game_title") if c in text.columns and c not in keys]
    groups = [k for k in keys if k != "language"]
    numbers = _numbers(text, [*groups, "language", *context])
    per_language = language_shares(numbers, groups, context)
    chosen = F.array_sort(F.collect_list(
        F.when(enough(min_reviews, min_share), F.struct((-F.col("review_count")).alias("n"), "language"))
    ))
    known = per_language.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("languages"),
        F.array_join(chosen.getField("language"), ", ").alias("selected"),
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in context],
    )
    one = X.attach(_metrics(text, keys, numbers), known, keys, ["languages", "selected", *context])
    metrics = {
        "scope": F.lit(scope),
        **{c: F.col(c) for c in context},
        **({"language": F.col("language")} if "language" in keys else {}),
        "reviews_with_text": F.col("review_count"),
        "positive_review_count": F.col("positive_review_count"),
        "negative_review_count": F.col("negative_review_count"),
        "total_tokens": F.col("total_tokens"),
        "total_unique_tokens": F.col("unique_tokens"),
        "type_token_ratio": F.col("type_token_ratio"),
        "average_review_length_words": F.col("mean_review_length_words"),
        "median_review_length_words": F.col("median_review_length_words"),
        "average_review_length_chars": F.col("mean_review_length_chars"),
        "median_review_length_chars": F.col("median_review_length_chars"),
    }
    if "language" not in keys:
        metrics["languages_with_text"] = F.col("languages")
        metrics["selected_languages_for_separate_output"] = F.col("selected")
    return X.metric_rows(one, keys, metrics)


def all_segments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with the three segments, so that an empty segment still has its row."""
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    return base.select(*keys, F.explode(F.array(*[F.lit(s) for s in K.SEGMENTS])).alias("segment"))


def text_by_polarity(text: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overall, positive and negative; only narrow columns are repeated per segment."""
    group = [*keys, "segment"]
    segment = F.explode(X.segments_of(F.col("is_positive"), F.col("is_negative"))).alias("segment")
    rows = text.select(*keys, segment, "token_count", "review_length_words", "review_length_chars")
    terms = term_counts(text, 1, keys).groupBy(*keys).agg(*[F.count_if(F.col(s) > 0).alias(s) for s in K.SEGMENTS])
    unique = terms.unpivot(list(keys), K.SEGMENTS, "segment", "unique_tokens")
    out = X.join_on(X.join_on(all_segments(text, keys), _sizes(_numbers(rows, group), group), group), unique, group)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("review_count", "total_tokens", "unique_tokens")})
    return out.select(*group, "review_count", "total_tokens", "unique_tokens", _ttr().alias("type_token_ratio"), *_LENGTHS)


def text_by_band(text: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows without a play-time band stay together as the null band."""
    group = [*keys, "playtime_at_review_band"]
    return _metrics(text, group).select(
        *group, "review_count", "total_tokens", "unique_tokens", "type_token_ratio", *list(_LENGTHS)[:2]
    )


def text_by_language(text: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    group = [*keys, "language"]
    share = X.pct(F.col("review_count"), F.sum("review_count").over(X.over_keys(keys)))
    return _metrics(text, group).select(
        *group, "review_count", share.alias("review_percentage"), "total_tokens", "unique_tokens",
        "type_token_ratio", *list(_LENGTHS)[:2],
    )


def of_selected_languages(
    text: DataFrame, min_reviews: int, min_share: float, keys: Sequence[str] = (), counted: DataFrame | None = None
) -> DataFrame:
    """The part of the corpus whose languages get tables of their own; the tables then take `language` as a key.

    Languages are counted in `counted`, where given: the same corpus before its texts were `dealt`.
    """
    counted = text if counted is None else counted
    return in_chosen(text, select_languages(counted, min_reviews, min_share, keys).select(*keys, "language"))


def in_chosen(text: DataFrame, chosen: DataFrame, nulls: bool = False) -> DataFrame:
    """The rows whose values of the columns of `chosen` are there; a null matches a null only if `nulls` says so.

    A join by shuffle on a few languages would put each of them into one task, and with it everything that is grouped by
    language afterwards. Chosen rows are broadcast; too many are joined by shuffle, with the texts of each dealt out.
    """
    def kept(rows: DataFrame, those: DataFrame) -> DataFrame:
        on = those.columns
        return X.join_on(rows, those, on, "left_semi") if nulls else rows.join(those, on, "left_semi")

    chosen = durable(chosen)
    if chosen.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        return kept(text, F.broadcast(chosen))
    dealt = text.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))
    return kept(dealt, chosen.withColumn("__part", every)).drop("__part")


# ---------------------------------------------------------------- word-frequency tables

def cloud_subset(df: DataFrame, target: str = "all", min_length: int = 2, remove_stopwords: bool = True) -> DataFrame:
    """Texts of the target language (or all), stop words by each row's language."""
    return text_subset(
        df, min_length, WORD_CLOUD_STOPWORDS if remove_stopwords else None, None if target == "all" else target
    )


def cloud_table(
    text: DataFrame, n: int, label: str, min_frequency: int = 2, max_words: int = 200, keys: Sequence[str] = ()
) -> DataFrame:
    """Ranked terms at or above a frequency, at most `max_words` of them."""
    terms = text.select(*keys, F.explode(TK.ngrams("tokens", n)).alias(label))
    counts = terms.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("frequency"))
    kept = counts.filter(F.col("frequency") >= min_frequency)
    return X.top_ranked(kept, keys, max_words, F.desc("frequency"), F.asc(label)).select(*keys, "rank", label, "frequency")


def cloud_summary(
    cleaned: DataFrame, text: DataFrame, limits: dict[str, tuple[int, int, int]], keys: Sequence[str] = ()
) -> DataFrame:
    """Rows, used rows, tokens and kept terms. `limits`: label -> (n, min_frequency, max_words)."""
    rows = cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in_cleaned_dataset"))
    used = text.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_used_for_word_clouds"), F.sum("token_count").alias("total_tokens_used")
    )
    out = X.attach(rows, used, keys, ["rows_used_for_word_clouds", "total_tokens_used"])
    for label, (n, low, top) in limits.items():
        kept = cloud_table(text, n, label, low, top, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{label}s"))
        out = X.attach(out, kept, keys, [f"{label}s"])
    return out

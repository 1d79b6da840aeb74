"""What the emotion and the theme reports share: counts and rates per review, summed up by key, segment or period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.operators.text import all_segments


def rate(category: str, tokens: str) -> Column:
    """Hits per 100 tokens of the review, six places."""
    return F.round(F.try_divide(X.quoted(f"{category}_count"), F.col(tokens)) * 100, 6)


def _sums(df: DataFrame, group: Sequence[str], categories: Sequence[str], tokens: str, matches: str) -> DataFrame:
    """Additive parts of every reported mean and share: may be summed again over coarser groups."""
    parts = [F.count(F.lit(1)).alias("review_count"), F.sum(tokens).alias("total_tokens"), F.sum(matches).alias(matches)]
    for c in categories:
        hits = X.quoted(f"{c}_count")
        parts += [
            F.sum(hits).alias(f"{c}__hits"),
            F.sum(F.round(X.quoted(f"{c}_per_100_tokens") * 1_000_000).cast("bigint")).alias(f"{c}__rates"),
            F.count_if(hits > 0).alias(f"{c}__reviews"),
        ]
    return df.groupBy(*group).agg(*parts)


def _mean_rate(c: str) -> Column:
    """Mean of the six-place rates. They are summed as whole millionths, so the order of the rows cannot matter."""
    n = F.col("review_count")
    millionths = F.expr(f"(2 * `{c}__rates` + review_count) div (2 * nullif(review_count, 0))")
    return F.when(n > 0, millionths / 1_000_000)


def _finish(sums: DataFrame, group: Sequence[str], categories: Sequence[str], matches: str) -> DataFrame:
    n = F.col("review_count")
    shown = []
    for c in categories:
        shown += [
            F.round(F.try_divide(X.quoted(f"{c}__hits"), n), 6).alias(f"{c}_mean_count"),
            _mean_rate(c).alias(f"{c}_mean_per_100_tokens"),
            X.pct(X.quoted(f"{c}__reviews"), n).alias(f"{c}_review_share"),
        ]
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("review_count", "total_tokens", matches)]
    return sums.select(*group, *zero, *shown)


def by_group(df: DataFrame, group: Sequence[str], categories: Sequence[str], tokens: str, matches: str) -> DataFrame:
    return _finish(_sums(df, group, categories, tokens, matches), group, categories, matches)


def by_polarity(df: DataFrame, keys: Sequence[str], categories: Sequence[str], tokens: str, matches: str) -> DataFrame:
    """Segments are formed after the rows have shrunk to at most nine polarity combinations per key."""
    polarity = ["is_positive", "is_negative"]
    sums = _sums(df, [*keys, *polarity], categories, tokens, matches)
    values = [c for c in sums.columns if c not in (*keys, *polarity)]
    segment = F.explode(X.segments_of(F.col("is_positive"), F.col("is_negative"))).alias("segment")
    group = [*keys, "segment"]
    folded = sums.select(*keys, segment, *map(X.quoted, values)).groupBy(*group).agg(
        *[F.sum(X.quoted(v)).alias(v) for v in values]
    )
    return _finish(X.join_on(all_segments(df, keys), folded, group), group, categories, matches)


def distribution(
    df: DataFrame, keys: Sequence[str], categories: Sequence[str], tokens: str, matches: str, name: str
) -> DataFrame:
    """One row per category over the whole corpus."""
    sums = _sums(df, keys, categories, tokens, matches)
    n, total = F.col("review_count"), F.col("total_tokens")
    rows = [
        F.struct(
            F.lit(c).alias(name),
            X.quoted(f"{c}__hits").alias("total_hits"),
            X.per_thousand(X.quoted(f"{c}__hits"), total).alias("hits_per_1000_tokens"),
            X.quoted(f"{c}__reviews").alias(f"reviews_with_{name}"),
            X.pct(X.quoted(f"{c}__reviews"), n).alias(f"review_share_with_{name}"),
            F.round(F.try_divide(X.quoted(f"{c}__hits"), n), 6).alias("mean_count_per_review"),
            _mean_rate(c).alias("mean_per_100_tokens"),
        )
        for c in categories
    ]
    return sums.select(*keys, F.inline(F.array(*rows)))


def overview(
    cleaned: DataFrame, enriched: DataFrame, keys: Sequence[str], categories: Sequence[str],
    target: str, tokens: str, matches: str, name: str, matches_metric: str,
) -> DataFrame:
    """Rows of the table, of the target language, with usable text and with matches, in long form."""
    context = [c for c in ("app_id", "game_slug", "game_title") if c in cleaned.columns and c not in keys]
    one = cleaned.groupBy(*keys).agg(
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in context],
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.lower(X.or_unknown(F.col("language"))) == target).alias("target_rows"),
    )
    signals = {f"reviews_with_{c}_signal": F.count_if(X.quoted(f"{c}_count") > 0) for c in categories}
    found = enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("usable"),
        F.count_if(F.col(matches) > 0).alias("matched"),
        F.sum(tokens).alias("tokens"), F.sum(matches).alias("matches"),
        *[c.alias(s) for s, c in signals.items()],
    )
    parts = ["usable", "matched", "tokens", "matches", *signals]
    full = X.attach(one, found, keys, parts).withColumns({p: F.coalesce(X.quoted(p), F.lit(0)) for p in parts})
    return X.metric_rows(full, keys, {
        **{c: F.col(c) for c in context},
        "target_language": F.lit(target),
        "rows_in_cleaned_dataset": F.col("rows"),
        "rows_in_target_language": F.col("target_rows"),
        "reviews_with_usable_text": F.col("usable"),
        f"reviews_with_any_{name}_match": F.col("matched"),
        "total_tokens_analysed": F.col("tokens"),
        matches_metric: F.col("matches"),
        **{s: X.quoted(s) for s in signals},
    })

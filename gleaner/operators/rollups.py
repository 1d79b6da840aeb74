"""Daily states that are stored once and merge into weeks, months and totals, so that later reports need not read reviews again.

Every state can be added up, so a day may be stored in any number of parts: late reviews are one more part, not a rewrite.
Counts are sums. Quantiles come from histograms and are exact. Distinct whole numbers are bitmaps and are exact; other values
have sketches with a stated error. A value's group never meets in one task: histograms and bitmaps merge value by value and
bucket by bucket, sketches have a fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.operators import profile as P
from gleaner.operators import temporal as T

LABELS = {T.DAY: X.day_label, T.WEEK: X.week_label, T.MONTH: X.month_label}
#: The relative standard error of a sketch of 2**k slots is about 1.04 / sqrt(2**k): 0.8 per cent.
SKETCH_LG = 14
_COUNTS = ("review_count", "positive_reviews", "negative_reviews")


# ---------------------------------------------------------------- states of a day

def daily_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, T.DAY).agg(
        F.count("recommendationid").alias("review_count"), F.count_if("is_positive").alias("positive_reviews"),
        F.count_if("is_negative").alias("negative_reviews"),
    )


def daily_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, day, variable, value, n)`: how often each value occurs."""
    return P.flat_histogram(P.histogram(df, [*keys, T.DAY], columns))


def daily_ids(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, day, variable, bucket, bits)`: the distinct values as bitmaps of 32,768 numbers each.

    Values are whole numbers of 64 bits, as numbers or spelled out; anything else is an error, null is no value. A bitmap takes
    4 KB in memory however few of its numbers occur (little of it when stored), so this is for ids that lie close together.
    Numbers are shuffled, not bitmaps: first their repeats go, then each bitmap's at most 32,768 numbers meet and are set in one
    task, which holds sorted numbers and the one bitmap that it fills.
    """
    ids = df.select(*keys, T.DAY, *[F.col(c).cast("bigint").alias(c) for c in columns])
    long = ids.unpivot([*keys, T.DAY], list(columns), "variable", "value").filter(F.col("value").isNotNull())
    group = [*keys, T.DAY, "variable", "bucket"]
    once = long.distinct().select(*keys, T.DAY, "variable", F.bitmap_bucket_number("value").alias("bucket"), F.bitmap_bit_position("value").alias("place"))
    return once.repartition(*group).groupBy(*group).agg(F.bitmap_construct_agg("place").alias("bits"))


def daily_sketches(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), lg: int = SKETCH_LG) -> DataFrame:
    """`(keys, day, variable, sketch)`: distinct values of any kind, sketched as text."""
    values = df.select(*keys, T.DAY, *[F.col(c).cast("string").alias(c) for c in columns])
    long = values.unpivot([*keys, T.DAY], list(columns), "variable", "value")
    return long.groupBy(*keys, T.DAY, "variable").agg(F.hll_sketch_agg("value", lg).alias("sketch"))


@dataclass(frozen=True)
class Days:
    """The stored states of all days."""

    counts: DataFrame
    values: DataFrame
    ids: DataFrame


def write_days(
    df: DataFrame, path: str, batch: int, columns: Sequence[str], ids: Sequence[str], keys: Sequence[str] = ()
) -> None:
    """Stores the states of one batch of reviews under its number; the same number replaces what a failed attempt left."""
    states = {"counts": daily_counts(df, keys), "values": daily_values(df, columns, keys), "ids": daily_ids(df, ids, keys)}
    for name, state in states.items():
        state.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def read_days(spark: SparkSession, path: str) -> Days:
    return Days(*[spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("counts", "values", "ids")])


# ---------------------------------------------------------------- merging

def by_period(days: DataFrame, period: str) -> DataFrame:
    """The states with their week or month in place of the day; reviews without a day have no period."""
    return days.withColumn(period, LABELS[period](F.col(T.DAY).cast("timestamp")))


def numeric_by_period(days: Days, period: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`temporal.numeric_by_period` out of stored days: the same rows, the same quantiles."""
    known = by_period(days.values, period).filter(F.col(period).isNotNull() & F.col("variable").isin(list(columns)))
    return T.period_statistics(P.merged_histogram(known, [*keys, period]), period, columns, keys)


def distinct_ids(ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, variable, distinct)` of merged bitmaps: exact."""
    merged = ids.groupBy(*keys, "variable", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys, "variable").agg(F.sum(F.bitmap_count("bits")).alias("distinct"))


def distinct_sketched(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, variable, distinct)` of merged sketches; see `SKETCH_LG` for the error."""
    return sketches.groupBy(*keys, "variable").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def monthly_volume_extended(days: Days, keys: Sequence[str] = (), reviewer: str = "steamid") -> DataFrame:
    """`temporal.monthly_volume_extended` out of stored days."""
    group = [*keys, T.MONTH]
    volume = by_period(days.counts, T.MONTH).groupBy(*group).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    people = distinct_ids(by_period(days.ids.filter(F.col("variable") == reviewer), T.MONTH), group)
    joined = X.join_on(T.with_percentages(volume), people.select(*group, F.col("distinct").alias("unique_reviewers")), group)
    return T.extended(joined.withColumn("unique_reviewers", F.coalesce("unique_reviewers", F.lit(0))), keys)

"""Exact distribution statistics that do not gather a group in one task.

Values are first counted into a histogram, combined on the map side, so a key that holds a third of all rows sends
each of its values once per map task. The histogram is cut into logarithmic buckets (about three per cent wide). Each
bucket is ranked on its own; only one row per bucket (at most a few thousand per key) meets in a key's task. Exact
quantiles, moments and top shares all follow from these two tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_OCTAVE = 24


# Bucket of the nulls. A real null here, or a filter on the bucket, would let the planner push a filter below the
# histogram on one side of the rank join only, and the histogram would then be computed twice.
_NULLS = -(2**31)


def _bucket(v: Column) -> Column:
    """Monotone bucket number on a signed logarithmic scale."""
    number = (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * _PER_OCTAVE)).cast("int")
    return F.coalesce(number, F.lit(_NULLS))


def _centre(b: Column) -> Column:
    """A point inside bucket `b`; moments are summed around it to keep full precision."""
    b = b.cast("double")
    return F.signum(b) * (F.pow(F.lit(2.0), F.abs(b) / _PER_OCTAVE) - 1)


# Group columns travel packed in one struct: a struct of nulls still equals itself in a plain equi-join, so all steps
# share one partitioning.
_GROUP = "__group"


def histogram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`(group, value, n)` for several columns in one pass; NaN counts as null."""
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    long = df.select(*keys, *values).unpivot(list(keys), list(columns), "variable", "value")
    group = F.struct(*keys, "variable").alias(_GROUP)
    return long.groupBy(group, "value").agg(F.count(F.lit(1)).alias("n"))


def flat_histogram(hist: DataFrame) -> DataFrame:
    """`(keys, variable, value, n)`: a histogram as a table to store."""
    return hist.select(f"{_GROUP}.*", "value", "n")


def merged_histogram(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The histogram over `keys` out of flat ones over finer keys, which may come in any number of parts."""
    return stored.groupBy(F.struct(*keys, "variable").alias(_GROUP), "value").agg(F.sum("n").alias("n"))


class _Ranked:
    """The histogram cut into buckets (`inner`) and its bucket table (`outer`). Nulls have a bucket of their own."""

    def __init__(self, hist: DataFrame, descending: bool = False):
        v, n = F.col("value"), F.col("n")
        order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
        upto = Window.partitionBy(_GROUP, "bucket").orderBy(order("value")).rowsBetween(Window.unboundedPreceding, 0)
        cut = hist.withColumn("bucket", _bucket(v))
        self.inner = cut.withColumns({"upto_n": F.sum("n").over(upto), "upto_sum": F.sum(n * v).over(upto)})
        d = v - _centre(F.col("bucket"))
        buckets = cut.groupBy(_GROUP, "bucket").agg(
            F.sum("n").alias("rows"),
            F.sum(n * v).alias("bucket_sum"),
            F.sum(n * d).alias("s1"),
            F.sum(n * d * d).alias("s2"),
            F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
        )
        buckets = buckets.withColumn("bucket_n", F.when(F.col("bucket") != _NULLS, F.col("rows")))
        w = Window.partitionBy(_GROUP)
        before = w.orderBy(order("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        self.outer = buckets.withColumns({
            "before_n": F.coalesce(F.sum("bucket_n").over(before), F.lit(0)),
            "before_sum": F.coalesce(F.sum("bucket_sum").over(before), F.lit(0.0)),
            "total_n": F.sum("bucket_n").over(w),
            "total_sum": F.sum("bucket_sum").over(w),
        })

    def at(self, wanted: DataFrame) -> DataFrame:
        """For each wanted `(group, bucket, rank)` the histogram row that covers it; rank counts from 1 in the bucket.

        Both sides are partitioned alike. The wanted side holds a few rows per group; adaptive execution broadcasts it
        when its measured size allows.
        """
        joined = self.inner.join(wanted, [_GROUP, "bucket"])
        rank = F.col("rank_in_bucket")
        return joined.filter((F.col("upto_n") >= rank) & (F.col("upto_n") - F.col("n") < rank))


def _in_bucket(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """Turn a rank within the group into one within the bucket, and keep the bucket that covers it."""
    return (
        rows.withColumn("rank_in_bucket", F.col("rank") - F.col("before_n"))
        .filter((F.col("rank_in_bucket") >= 1) & (F.col("rank_in_bucket") <= F.col("bucket_n")))
        .select(_GROUP, "bucket", "rank_in_bucket", *keep)
    )


def quantile_column(p: float) -> str:
    """Name under which `numeric_profile` returns quantile `p`."""
    return "q" + format(p, "g").replace(".", "_")


def numeric_profile(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float] = (),
) -> DataFrame:
    """`profile_of_histogram` of the columns' values."""
    return profile_of_histogram(histogram(df, keys, columns), probs)


def profile_of_histogram(hist: DataFrame, probs: Sequence[float] = ()) -> DataFrame:
    """One row per key and variable: count_non_null, count_null, count_zero, mean, std, min, max, sum, and the
    linearly interpolated quantiles `q0_5`, ... Unrounded; a variable without values has only its null count.
    """
    ranked = _Ranked(hist)
    known = F.col("bucket") != _NULLS
    mean, total = F.col("total_sum") / F.col("total_n"), F.max("total_n")
    shift = _centre(F.col("bucket")) - mean
    squares = F.sum(F.col("s2") + 2 * shift * F.col("s1") + F.col("bucket_n") * shift * shift)
    out = ranked.outer.groupBy(_GROUP).agg(
        F.coalesce(total, F.lit(0)).alias("count_non_null"),
        F.sum(F.when(known, 0).otherwise(F.col("rows"))).alias("count_null"),
        F.sum(F.when(known, F.col("zeros"))).alias("count_zero"),
        F.max(mean).alias("mean"),
        F.when(total > 1, F.sqrt(F.greatest(F.try_divide(squares, total - 1), F.lit(0.0)))).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.max("total_sum").alias("sum"),
    )
    if probs:
        out = out.join(_quantiles(ranked, probs), _GROUP, "left")
    return out.select(f"{_GROUP}.*", *[c for c in out.columns if c != _GROUP])


def _quantiles(ranked: _Ranked, probs: Sequence[float]) -> DataFrame:
    position = (F.col("total_n") - 1) * F.col("p") + 1
    asked = (
        ranked.outer
        .select(_GROUP, "bucket", "bucket_n", "before_n", "total_n",
                F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
    )
    found = ranked.at(_in_bucket(asked, "p", (position - F.floor(position)).alias("part")))
    picks = []
    for p in probs:
        here = F.col("p") == float(p)
        low, high = F.min(F.when(here, F.col("value"))), F.max(F.when(here, F.col("value")))
        picks.append((low + (high - low) * F.max(F.when(here, F.col("part")))).alias(quantile_column(p)))
    return found.groupBy(_GROUP).agg(*picks)


def top_shares(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], fractions: Mapping[str, float]
) -> DataFrame:
    """Sum per variable and the percentage of it held by the top fraction of rows (at least one row)."""
    ranked = _Ranked(histogram(df, keys, columns), descending=True)
    shares = F.array(*[F.struct(F.lit(name).alias("share"), F.lit(float(f)).alias("fraction"))
                       for name, f in fractions.items()])
    asked = ranked.outer.select("*", F.inline(shares)).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("total_n") * F.col("fraction")))
    )
    found = ranked.at(_in_bucket(asked, "share", "before_sum", "total_sum"))
    held = F.col("before_sum") + F.col("upto_sum") - (F.col("upto_n") - F.col("rank_in_bucket")) * F.col("value")
    percentage = F.round(F.try_divide(held, F.col("total_sum")) * 100, 4)
    return found.groupBy(_GROUP).agg(
        F.round(F.max("total_sum"), 4).alias("sum_total"),
        *[F.max(F.when(F.col("share") == name, percentage)).alias(name) for name in fractions],
    ).select(f"{_GROUP}.*", "sum_total", *fractions)

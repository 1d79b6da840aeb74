"""Column expressions shared by all operators. Everything here stays inside native Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import constants as K


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---------------------------------------------------------------- numbers

def pct(part: Column, whole: Column) -> Column:
    """Percentage to four places; null on a zero or null denominator."""
    return F.round(F.try_divide(part, whole) * 100, 4)


def per_thousand(part: Column, whole: Column) -> Column:
    """Frequency per 1000 to six places; null on a zero or null denominator."""
    return F.round(F.try_divide(part, whole) * 1000, 6)


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    return F.round(F.try_divide(a, b), places)


def lenient_long(c: Column) -> Column:
    """Whole number or null: "12", " 12 " and "12.0" pass, "x" and "12.5" become null."""
    text = F.btrim(c.cast("string"), F.lit(K.WHITESPACE))
    # the decimal has all digits of large numbers, the double sees fractions of any length
    number, exact = text.try_cast("double"), text.try_cast("decimal(38,10)")
    whole = F.when((number == F.floor(number)) & (exact == F.floor(exact)), exact).try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), whole)


# ---------------------------------------------------------------- strings

def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both sides (`trim` alone removes only blanks)."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def word_count(c: Column) -> Column:
    """Runs of anything but Unicode whitespace."""
    return F.size(F.array_remove(F.split(c, K.GAP_PATTERN), "")).cast("bigint")


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def _unless(text: Column, blanks: Sequence[str]) -> Column:
    """Null for the given spellings. The value is stated once, so it is computed once."""
    return reduce(lambda value, blank: F.nullif(value, F.lit(blank)), blanks, text)


def normal_string(c: Column) -> Column:
    return _unless(strip(unify_newlines(c.cast("string"))), K.BLANK_STRINGS)


def normal_language(c: Column) -> Column:
    return _unless(F.lower(strip(c.cast("string"))), K.BLANK_LANGUAGES)


def normal_boolean(c: Column) -> Column:
    """Three-valued: unknown spellings become null instead of failing or counting as true."""
    text = F.lower(strip(c.cast("string")))
    return F.when(text.isin(K.TRUE_WORDS), F.lit(True)).when(text.isin(K.FALSE_WORDS), F.lit(False))


def clean_text(c: Column) -> Column:
    """Newlines unified, runs of blanks and tabs to one blank, three or more newlines to two, empty to null."""
    text = F.regexp_replace(unify_newlines(c), r"[ \t]+", " ")
    return F.nullif(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.lit(""))


def slug(c: Column) -> Column:
    """Folder-safe label: lower case, other characters to single underscores, "unknown" when nothing is left."""
    text = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(text, F.lit("_")), F.lit("")), F.lit("unknown"))


def or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def sql_string(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Sequence[str]) -> str:
    return ", ".join(sql_string(v) for v in values)


# ---------------------------------------------------------------- bands, periods, segments

def band(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; null stays null."""
    out = F.when(c <= edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        out = out.when(c <= edge, F.lit(label))
    return out.when(c.isNotNull(), F.lit(labels[-1]))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_label(ts: Column) -> Column:
    """Weeks run from Tuesday to Monday and are labelled first-day/last-day."""
    day = F.to_date(ts)
    start = F.date_sub(day, (F.weekday(day) + 6) % 7)
    return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def segments_of(positive: Column, negative: Column) -> Column:
    """The segments a row belongs to: always overall, and positive or negative when known."""
    return F.array_compact(
        F.array(F.lit("overall"), F.when(positive, F.lit("positive")), F.when(negative, F.lit("negative")))
    )


# ---------------------------------------------------------------- shapes

def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"__{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def attach(left: DataFrame, totals: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add per-key totals. Without keys `totals` is one row and comes in as one scalar subquery."""
    if keys:
        return join_on(left, totals.select(*keys, *columns), keys)
    packed = left.withColumn("__totals", totals.select(F.struct(*columns)).scalar())
    return packed.select(*left.columns, *[F.col(f"__totals.{c}").alias(c) for c in columns])


def metric_rows(one: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """A one-row-per-key aggregate as `(metric, value)` rows with text values, in the given order."""
    pairs = [F.struct(F.lit(name).alias("metric"), col.cast("string").alias("value")) for name, col in metrics.items()]
    return one.select(*keys, F.inline(F.array(*pairs)))


def ordered_within(keys: Sequence[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def over_keys(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def top_ranked(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first `n` rows per key with their `rank`.

    With keys, the filter on `row_number` lets Spark cut each map task's share before the shuffle; without keys a
    sort-limit does the same and only `n` rows meet in one task.
    """
    if keys:
        ranked = df.withColumn("rank", F.row_number().over(ordered_within(keys, *order)))
        return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))
    few = df.orderBy(*order).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))

"""Data-quality checks as rows `(check_id, passed, severity, message, details)`; details are JSON text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X


def _check(
    one: DataFrame, check_id: str, severity: str, passed: Column, good: str, bad: Column | str, *details: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """An aggregate of one row, or one row per product, as a check."""
    bad = F.lit(bad) if isinstance(bad, str) else bad
    return one.select(
        *keys, F.lit(check_id).alias("check_id"), passed.alias("passed"), F.lit(severity).alias("severity"),
        F.when(passed, F.lit(good)).otherwise(bad).alias("message"),
        F.to_json(F.struct(*details)).alias("details"),
    )


def required_columns(
    df: DataFrame, columns: Sequence[str], check_id: str, severity: str = "error", keys: Sequence[str] = ()
) -> DataFrame:
    """Whether all columns are there; the details have the filled rows of those that are."""
    missing = [c for c in columns if c not in df.columns]
    filled = F.array(*[F.count(X.quoted(c)).cast("string") for c in columns if c not in missing])
    one = df.groupBy(*keys).agg(F.array_join(filled, ", ").alias("filled_rows")).withColumns(
        {"required_columns": F.lit(", ".join(columns)), "missing_columns": F.lit(", ".join(missing))}
    )
    return _check(one, check_id, severity, F.lit(not missing), "Required columns present",
                  "Missing required columns: " + ", ".join(missing), "required_columns", "missing_columns", "filled_rows", keys=keys)


def non_empty(df: DataFrame, check_id: str, severity: str = "error", keys: Sequence[str] = ()) -> DataFrame:
    """Whether there are rows. With keys, for each product that has any."""
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return _check(one, check_id, severity, F.col("row_count") > 0, "Table contains rows", "Table is empty", "row_count", keys=keys)


def _usable(ids: DataFrame, column: str) -> DataFrame:
    """Trimmed, non-blank ids."""
    value = X.strip(F.col(column).cast("string"))
    return ids.select(value.alias("id")).filter(F.col("id") != "")


def _sizes(df: DataFrame, column: str, rows: str, distinct: str) -> DataFrame:
    """Row and distinct counts; ids are folded map-side, so repeated ids cost nothing in the shuffle."""
    per_id = _usable(df, column).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias(rows), F.count(F.lit(1)).alias(distinct))


def unique_ids(
    df: DataFrame, column: str = "recommendationid", check_id: str = "recommendationid_uniqueness",
    severity: str = "warning", keys: Sequence[str] = (),
) -> DataFrame:
    """Rows beyond the first of their id, within each product; a missing id counts as one id."""
    per_id = df.groupBy(*keys, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    one = per_id.groupBy(*keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicated_count"))
    dup = F.col("duplicated_count")
    return _check(one, check_id, severity, dup == 0, "No duplicated ids",
                  F.concat(F.lit("Found duplicated ids: "), dup.cast("string")), "duplicated_count", keys=keys)


def unique_across_chunks(chunks: DataFrame, column: str = "recommendationid") -> DataFrame:
    one = _sizes(chunks, column, "chunk_row_total", "chunk_unique_ids").withColumn(
        "duplicate_ids_across_chunks", F.col("chunk_row_total") - F.col("chunk_unique_ids")
    )
    dup = F.col("duplicate_ids_across_chunks")
    return _check(one, "chunks_cross_file_uniqueness", "warning", dup == 0, "No duplicated ids across chunks",
                  F.concat(F.lit("Found duplicated ids across chunks: "), dup.cast("string")),
                  "chunk_row_total", "chunk_unique_ids", "duplicate_ids_across_chunks")


def _against_chunks(one: DataFrame, value: str, chunks: DataFrame, check_id: str, what: str, column: str) -> DataFrame:
    unique = _sizes(chunks, column, "rows", "chunk_unique_ids")
    both = X.attach(one, unique, (), ["chunk_unique_ids"])
    return _check(both, check_id, "warning", F.col(value).eqNullSafe(F.col("chunk_unique_ids")),
                  f"{what} matches chunks", f"{what} does not match chunks", value, "chunk_unique_ids")


def combined_matches_chunks(combined: DataFrame, chunks: DataFrame, column: str = "recommendationid") -> DataFrame:
    one = _sizes(combined, column, "rows", "combined_unique_ids").select("combined_unique_ids")
    return _against_chunks(one, "combined_unique_ids", chunks, "combined_vs_chunks_unique_count",
                           "Combined id count", column)


def index_matches_chunks(index: DataFrame, chunks: DataFrame, column: str = "recommendationid") -> DataFrame:
    """The last cumulative record count of the chunk index against the ids in the chunks."""
    one = index.groupBy().agg(F.max_by("cumulative_records", "chunk_number").alias("index_cumulative_records"))
    return _against_chunks(one, "index_cumulative_records", chunks, "index_cumulative_matches_chunks",
                           "Index cumulative total", column)


def final_total_matches_chunks(summary: DataFrame, chunks: DataFrame, column: str = "recommendationid") -> DataFrame:
    """The recorded final total against the ids in the chunks, and the reported distance to the expected total."""
    one = summary.select("final_total_unique_reviews", "expected_total_reviews")
    final = _against_chunks(one.select("final_total_unique_reviews"), "final_total_unique_reviews", chunks,
                            "progress_final_total_matches_chunks", "Recorded final total", column)
    delta = X.attach(
        one.filter(F.col("expected_total_reviews").isNotNull()), _sizes(chunks, column, "rows", "chunk_unique_ids"),
        (), ["chunk_unique_ids"],
    ).withColumn("difference", F.col("chunk_unique_ids") - F.col("expected_total_reviews"))
    reported = "Expected total is recorded for comparison"
    return final.unionByName(_check(delta, "progress_expected_total_delta_reported", "warning", F.lit(True), reported,
                                    reported, "expected_total_reviews", "chunk_unique_ids", "difference"))


def polarity_total(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """total = positive + negative in the long polarity summary, for each product."""
    names = ["total_reviews", "positive_reviews", "negative_reviews"]
    one = summary.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == n, F.col("value").try_cast("bigint"))).alias(n) for n in names]
    ).filter(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull() & F.col(names[2]).isNotNull())
    passed = F.col("total_reviews") == F.col("positive_reviews") + F.col("negative_reviews")
    return _check(one, "polarity_total_consistency", "warning", passed, "Polarity totals are consistent",
                  "Polarity totals are inconsistent", *names, keys=keys)


def expected_segments(
    table: DataFrame, check_id: str, expected: Sequence[str] = tuple(K.SEGMENTS), keys: Sequence[str] = ()
) -> DataFrame:
    """Segments that a by-polarity table lacks, for each product in it."""
    wanted = F.array(*[F.lit(s) for s in expected])
    missing = F.array_sort(F.array_except(wanted, F.collect_set("segment")))
    one = table.groupBy(*keys).agg(F.array_join(missing, ", ").alias("missing_segments"))
    names = F.col("missing_segments")
    return _check(one, check_id, "warning", names == "", "Expected segments present",
                  F.concat(F.lit("Missing segments: "), names), "missing_segments", keys=keys)


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_summary(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals by outcome, for each product; the status is failed only when an error-level check failed."""
    failed = ~F.col("passed")
    errors = F.count_if(failed & (F.col("severity") == "error"))
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("check_count_total"),
        F.count_if("passed").alias("check_count_passed"),
        F.count_if(failed).alias("check_count_failed"),
        errors.alias("error_failures"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warning_failures"),
        F.when(errors > 0, F.lit("failed")).otherwise(F.lit("passed")).alias("final_status"),
    )

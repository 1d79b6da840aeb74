"""Landed review pages to a deduplicated raw table, in chunks with an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.functions.durable import durable
from gleaner.operators.prepare import keep_first
from gleaner.sources import schema as S


#: Chunks whose totals are added up together.
CHUNKS_PER_RUN = 4096

# ---------------------------------------------------------------- pages

def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON document per file."""
    return spark.read.schema(S.page_schema()).option("multiLine", True).json(path)


def parse_pages(df: DataFrame, column: str = "value") -> DataFrame:
    """Pages that arrive as JSON text in a column; the other columns stay."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.from_json(column, S.page_schema()).alias("__page")).select(*others, "__page.*")


NO_TEXT, NO_JSON, NO_SUCCESS, NO_REVIEWS = "empty", "not a JSON page", "not successful", "no list of reviews"


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one per line: `value` and `file`. Files of any size are split among tasks."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def checked_pages(df: DataFrame, column: str = "value") -> DataFrame:
    """`parse_pages` with a `reason`: null for a good page, else why the page is rejected. No row is lost.

    The text stays beside a rejected page only; pages that are empty, cut off, of another form, not successful, or without a
    list of reviews are rejected. An empty list of reviews is a good page.
    """
    others = [c for c in df.columns if c != column]
    schema = S.page_schema().add("__corrupt", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    page = F.explode(F.array(F.from_json(column, schema, options)))
    parsed = df.select(*others, F.col(column).alias("__text"), page.alias("__page"))
    reason = (
        F.when(F.coalesce(X.strip(F.col("__text")), F.lit("")) == "", NO_TEXT)
        .when(F.col("__page").isNull() | F.col("__page.__corrupt").isNotNull(), NO_JSON)
        .when(F.coalesce(F.col("__page.success"), F.lit(1)) != 1, NO_SUCCESS)
        .when(F.col("__page.reviews").isNull(), NO_REVIEWS)
    )
    told = parsed.withColumn("reason", reason)
    kept = [F.when(F.col("reason").isNull(), F.col(f"__page.{f.name}")).alias(f.name) for f in S.page_schema()]
    return told.select(*others, *kept, "reason", F.when(F.col("reason").isNotNull(), F.col("__text")).alias("rejected_text"))


def land_pages(df: DataFrame, path: str, column: str = "value") -> dict:
    """Writes good pages to `path/rejected=false` and the others to `path/rejected=true`; returns how many of each, from one job."""
    seen = Observation()
    checked = checked_pages(df, column).withColumn("rejected", F.col("reason").isNotNull())
    counts = [F.count_if(~F.col("rejected")).alias("pages"), F.count_if("rejected").alias("rejected_pages")]
    checked.observe(seen, *counts).write.mode("overwrite").partitionBy("rejected").parquet(path)
    return seen.get


def landed_pages(spark: SparkSession, path: str, rejected: bool = False) -> DataFrame:
    """What `land_pages` has stored: the good pages, or the rejected ones with text and reason."""
    stored = spark.read.parquet(path).filter(F.col("rejected") == rejected).drop("rejected")
    return stored.drop(*([f.name for f in S.page_schema()] if rejected else ["reason", "rejected_text"]))


def cast_raw(column: str, value: Column) -> Column:
    """Lenient cast of one landed leaf: bad numbers and unknown booleans become null."""
    if column in S.LONG_COLUMNS:
        return X.lenient_long(value)
    if column in S.BOOLEAN_COLUMNS:
        return X.normal_boolean(value)
    return value.cast("string")


def flatten_pages(pages: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per review: the nested author lifted, leaves cast, the position within the page as `position`.

    `order` names page columns that fix the order of pages; they are kept.
    """
    reviews = pages.select(*order, F.posexplode("reviews").alias("position", "r"))
    leaves = {c: F.col(f"r.author.{c}" if c in S.AUTHOR_COLUMNS else f"r.{c}") for c in S.RAW_COLUMNS}
    return reviews.select(*order, "position", *[cast_raw(c, v).alias(c) for c, v in leaves.items()])


# ---------------------------------------------------------------- dedup, chunks, combination

def usable_ids(df: DataFrame, column: str = "recommendationid") -> DataFrame:
    """Ids trimmed; rows without one are dropped."""
    return df.withColumn(column, X.strip(F.col(column).cast("string"))).filter(F.col(column) != "")


def ingest_dedup(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First-seen review per id; rows without an id are skipped."""
    return keep_first(usable_ids(df), [*keys, "recommendationid"], order)


def with_row_number(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers 1..n in `order`, without sorting the table in one task.

    A range shuffle (its bounds are sampled, so the ranges are of even size) is written to the checkpoint folder, which
    fixes the partition of every row; partitions are numbered from their sizes and rows within their partition.
    """
    ranged = durable(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # Window over one row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    numbered = ranged.withColumn("__inside", inside).join(starts, "__part")
    return numbered.withColumn(name, (F.col("__start") + F.col("__inside")).cast("bigint")).drop(
        "__part", "__inside", "__start"
    )


def with_chunks(df: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """`chunk_number` from 1, `size` rows each in `order` (a numeric column)."""
    numbered = with_row_number(df, order, "__row")
    return numbered.withColumn("chunk_number", (F.floor((F.col("__row") - 1) / size) + 1).cast("bigint")).drop("__row")


def chunk_index(chunks: DataFrame, slug: str = "") -> DataFrame:
    """Records and cumulative records per chunk, with the chunk's file names."""
    counts = chunks.groupBy("chunk_number").agg(F.count(F.lit(1)).alias("record_count"))
    stem = F.format_string(f"{slug}_reviews_part_%04d" if slug else "reviews_part_%04d", F.col("chunk_number"))
    # Totals in two steps: within runs of chunks, and over the runs, of which there are a few thousand times fewer.
    runs = counts.withColumn("__run", F.floor(F.col("chunk_number") / CHUNKS_PER_RUN))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("__run").agg(F.sum("record_count").alias("__n")).select(
        "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("__run").orderBy("chunk_number").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("record_count").over(inside)
    return runs.withColumn("__total", total).join(starts, "__run").select(
        "chunk_number", F.concat(stem, F.lit(".json")).alias("json_file"), F.concat(stem, F.lit(".csv")).alias("csv_file"),
        "record_count", (F.col("__total") + F.col("__start")).alias("cumulative_records"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunk files of a folder, as text, with the chunk number taken from the name of the file or of its folder."""
    raw = spark.read.schema(S.raw_schema(as_text=True)).options(header=True, multiLine=True, escape='"').csv(path)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"_part_(\d+)", 1).try_cast("bigint")
    return raw.withColumn("chunk_number", number)


def combine_chunks(chunks: DataFrame, order: Sequence[str]) -> DataFrame:
    """The combined table: first row per id in chunk order."""
    return ingest_dedup(chunks, order)


def write_combined(chunks: DataFrame, path: str, order: Sequence[str]) -> dict:
    """Writes the combined table and returns `rows_written` and `duplicate_rows_skipped`, all in one job.

    The first row of each id comes with the number of its rows, combined in the map tasks; rows without an id are one group,
    which is counted and then dropped. Rows that `order` does not tell apart leave any of them.
    """
    known = F.nullif(X.strip(F.col("recommendationid").cast("string")), F.lit(""))
    rows = chunks.withColumn("recommendationid", known)
    first = F.min_by(F.struct(*[X.quoted(c) for c in rows.columns]), F.struct(*order))
    per_id = rows.groupBy(F.col("recommendationid").alias("__id")).agg(first.alias("__row"), F.count(F.lit(1)).alias("__n"))
    seen = Observation()
    observed = per_id.observe(seen, F.count("__id").alias("rows_written"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"))
    observed.filter("__id is not null").select("__row.*").write.mode("overwrite").parquet(path)
    return {"rows_written": seen.get["rows_written"], "duplicate_rows_skipped": seen.get["rows"] - seen.get["rows_written"]}


def combine_counts(chunks: DataFrame) -> DataFrame:
    """`(rows_written, duplicate_rows_skipped)` of the combination; rows without id count as skipped."""
    known = X.strip(F.col("recommendationid").cast("string"))
    per_id = chunks.groupBy(F.nullif(known, F.lit("")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    one = per_id.groupBy().agg(F.count("id").alias("rows_written"), F.sum("n").alias("rows"))
    return one.select("rows_written", (F.coalesce("rows", F.lit(0)) - F.col("rows_written")).alias("duplicate_rows_skipped"))


def only_new(batch: DataFrame, stored: DataFrame, keys: Sequence[str] = ("recommendationid",)) -> DataFrame:
    """Rows of a later batch whose id is not stored yet."""
    return usable_ids(batch).join(usable_ids(stored).select(*keys), list(keys), "left_anti")


def ingest_summary(pages: DataFrame, rows: DataFrame, chunk_size: int, expected: Column | None = None) -> DataFrame:
    """Pages, chunks, records, distinct reviews, and the distance to the total that the pages announce."""
    announced = expected if expected is not None else F.max("query_summary.total_reviews")
    one = pages.groupBy().agg(
        F.count(F.lit(1)).alias("pages_downloaded"), announced.alias("expected_total_reviews")
    )
    per_id = usable_ids(rows).groupBy("recommendationid").agg(F.count(F.lit(1)).alias("n"))
    found = per_id.groupBy().agg(
        F.count(F.lit(1)).alias("final_total_unique_reviews"), F.coalesce(F.sum("n"), F.lit(0)).alias("records_received")
    )
    final = F.col("final_total_unique_reviews")
    return X.attach(one, found, (), ["final_total_unique_reviews", "records_received"]).withColumns({
        "chunks_exported": F.ceil(final / chunk_size).cast("bigint"),
        "difference_vs_expected": final - F.col("expected_total_reviews"),
    })

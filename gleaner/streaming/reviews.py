"""Incremental ingest and running volumes as Structured Streaming jobs.

Every function takes and returns a streaming DataFrame; the same expressions as in the batch tables are used. State lives in
RocksDB, on disk, so that the ids a dedup remembers need not fit into memory.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from gleaner.functions import exprs as X


# ---------------------------------------------------------------- sources and runs

def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(writer, spark: SparkSession, checkpoint: str, path: str | None = None) -> StreamingQuery:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(*([path] if path else []))
    query.awaitTermination()
    return query


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, append it to Parquet files, stop. A later call with the same checkpoint goes
    on where this one ended: files already read are not read again and ids already seen are still known."""
    return _run(stream.writeStream.format("parquet"), stream.sparkSession, checkpoint, path)


def run_batches(stream: DataFrame, mode: str, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, with `work(batch, number)`; a batch that failed comes again with
    the same number."""
    return _run(stream.writeStream.outputMode(mode).foreachBatch(work), stream.sparkSession, checkpoint)


# ---------------------------------------------------------------- operators

def dedup(stream: DataFrame, ids: list[str], event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """First arrival per id. With `horizon`, an id is remembered only that long, which bounds the state of endless runs."""
    if horizon is not None:
        return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(ids)
    return stream.dropDuplicates(ids)


class Batches(StreamingQueryListener):
    """Rows read and kept per batch of all queries while it listens: one short row per batch, however many there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.ended = spark, [], threading.Event()

    def __enter__(self) -> Batches:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.ended.wait(60)  # events arrive a little later than the query ends
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        kept = [s.numRowsUpdated for s in p.stateOperators if s.operatorName.startswith("dedupe")]
        if p.numInputRows > 0:
            self.rows.append((int(p.batchId), int(p.numInputRows), int(kept[0] if kept else p.numInputRows)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def progress(batches: Batches) -> DataFrame:
    """Per batch: rows read, rows kept by the dedup (all rows without one), cumulative rows kept."""
    rows = batches.spark.createDataFrame(batches.rows, "batch_id bigint, rows_in bigint, rows_kept bigint")
    upto = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rows_kept_cumulative", F.sum("rows_kept").over(upto))


def _counts(positive: str, negative: str) -> list:
    return [
        F.count(F.lit(1)).alias("review_count"), F.count_if(positive).alias("positive_reviews"),
        F.count_if(negative).alias("negative_reviews"),
    ]


def _shares(df: DataFrame) -> DataFrame:
    n = F.col("review_count")
    return df.withColumns({
        "positive_percentage": X.pct(F.col("positive_reviews"), n),
        "negative_percentage": X.pct(F.col("negative_reviews"), n),
    })


def daily_volume(stream: DataFrame, ts: str, positive: str = "is_positive", negative: str = "is_negative") -> DataFrame:
    """Tumbling days."""
    out = stream.groupBy(F.window(ts, "1 day")).agg(*_counts(positive, negative))
    return _shares(out.select(X.day_label(F.col("window.start")).alias("day"), "review_count", "positive_reviews", "negative_reviews"))


def weekly_volume(stream: DataFrame, ts: str, positive: str = "is_positive", negative: str = "is_negative") -> DataFrame:
    """Tumbling weeks from Tuesday to Monday."""
    out = stream.groupBy(F.window(ts, "7 days", "7 days", "5 days")).agg(*_counts(positive, negative))
    week = X.week_label(F.col("window.start")).alias("week")
    return _shares(out.select(week, "review_count", "positive_reviews", "negative_reviews"))


def monthly_polarity(
    stream: DataFrame, ts: str, by: str, positive: str = "is_positive", negative: str = "is_negative"
) -> DataFrame:
    """Calendar months and a label; months are no fixed windows, so the key is the month itself."""
    out = stream.groupBy(X.month_label(F.col(ts)).alias("month"), X.or_unknown(F.col(by)).alias(by))
    return _shares(out.agg(*_counts(positive, negative)))

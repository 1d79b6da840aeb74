"""Incremental ingest whose memory is its own output: ids, rows and progress lie in storage and outlive any checkpoint.

A streaming dedup knows the ids it has seen only as long as its checkpoint lives. Here every batch is compared with the ids of
all rows stored so far, whoever stored them, and leaves its own ids there. A lost checkpoint means that files are read again,
not that rows are stored again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from gleaner.operators.prepare import keep_first
from gleaner.sources.id_store import IdStore, read_if_there
from gleaner.streaming.reviews import run_batches

RUNS = "run int, query string"
PROGRESS = "rows_in bigint, rows_kept bigint, finished_at timestamp, run int, batch_id bigint"
PLACE = "run int, batch_id bigint"


def run_number(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number of the run that a checkpoint belongs to: 0 for the first checkpoint that wrote to `path`, and so on."""
    query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    known = {r["query"]: r.run for r in read_if_there(spark, f"{path}/runs", RUNS).collect()}  # one row per checkpoint ever used
    if query not in known:
        known[query] = len(known)
        spark.createDataFrame([(known[query], query)], RUNS).coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return known[query]


def _numbered(spark: SparkSession, path: str, checkpoint: str, work: Callable[[DataFrame, int, int], None]) -> Callable[[DataFrame, int], None]:
    run: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        if not run:
            run.append(run_number(spark, path, checkpoint))
        work(batch, run[0], number)

    return each


def _at(run: int, batch: int) -> str:
    return f"run={run}/batch_id={batch}"


# ---------------------------------------------------------------- rows with new ids

def ingest(stream: DataFrame, store: IdStore, path: str, checkpoint: str, order: Sequence[str] = ()) -> DataFrame:
    """Processes everything that has arrived, appends rows with new ids to `path`, and returns the rows of this and all earlier runs.

    Of rows that share an id within a batch the first in `order` stays, or any without an order. A batch writes its rows, then
    their ids, then its line of progress; each step can be repeated, so a batch that failed anywhere is simply done again.
    Null ids are dropped.
    """
    spark = stream.sparkSession
    recover(spark, store, path, stream.schema)

    def keep(batch: DataFrame, run: int, number: int) -> None:
        at = _at(run, number)
        fresh = store.unseen(batch, but_by=at)
        fresh = keep_first(fresh, list(store.keys), order) if order else fresh.dropDuplicates(list(store.keys))
        fresh.write.mode("overwrite").parquet(f"{path}/rows/{at}")
        _finish(spark, store, path, stream.schema, at, batch.count())

    run_batches(stream, "append", _numbered(spark, path, checkpoint, keep), checkpoint)
    return rows(spark, path, stream.schema)


def _finish(spark: SparkSession, store: IdStore, path: str, schema: StructType, at: str, rows_in: int | None) -> None:
    """Stores the ids of a batch whose rows are written, then its line of progress."""
    kept = spark.read.schema(schema).parquet(f"{path}/rows/{at}")
    store.add(kept, at)
    line = kept.groupBy().agg(F.lit(rows_in).cast("bigint").alias("rows_in"), F.count(F.lit(1)).alias("rows_kept"), F.current_timestamp().alias("finished_at"))
    line.write.mode("overwrite").parquet(f"{path}/progress/{at}")


def recover(spark: SparkSession, store: IdStore, path: str, schema: StructType) -> None:
    """Stores the ids of batches whose rows were written, but that ended before their line of progress.

    With the old checkpoint such a batch would be repeated; without it nobody would, and its rows would come again.
    """
    written = read_if_there(spark, f"{path}/rows", PLACE).select("run", "batch_id").distinct()
    ended = read_if_there(spark, f"{path}/progress", PROGRESS)
    for r in written.join(ended, ["run", "batch_id"], "left_anti").collect():  # at most the last batch of each failed run
        _finish(spark, store, path, schema, _at(r.run, r.batch_id), None)


def rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows stored so far, with `run` and `batch_id`."""
    whole = StructType(schema.fields).add("run", IntegerType()).add("batch_id", LongType())
    return spark.read.schema(whole).parquet(f"{path}/rows")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Per run and batch: rows read (null if the batch was finished by a later run), rows kept, and all rows kept up to it.

    It is read from storage, so totals go on through restarts, other drivers and fresh checkpoints.
    """
    # Window over one row per batch.
    upto = Window.orderBy("run", "batch_id").rowsBetween(Window.unboundedPreceding, 0)
    lines = read_if_there(spark, f"{path}/progress", PROGRESS)
    return lines.select("run", "batch_id", "rows_in", "rows_kept", F.sum("rows_kept").over(upto).alias("rows_kept_cumulative"), "finished_at")


# ---------------------------------------------------------------- running results

def run_to_changes(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str, fold_every: int = 256) -> DataFrame:
    """Processes everything that has arrived and returns the running result of an aggregation, from storage.

    Each batch writes only the rows that it has changed, whole rows under their `keys`; the latest of each key counts. So a
    late batch writes a row for each of its own days, however long the result is. After `fold_every` batches the latest rows
    are written together, and earlier changes are not read any more. A run with a fresh checkpoint counts everything anew, so
    its result takes the place of the earlier runs'. With a watermark on the stream the state forgets finished windows; their
    rows stay in the result.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def store(batch: DataFrame, run: int, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/{_at(run, number)}")
        if number % fold_every == fold_every - 1:
            latest(spark, path, schema, keys).write.mode("overwrite").parquet(f"{path}/folded/{_at(run, number)}")

    run_batches(stream, "update", _numbered(spark, path, checkpoint, store), checkpoint)
    return latest(spark, path, schema, keys)


def latest(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key in the last run: those folded together last, and the changes since."""
    placed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {PLACE}"
    run = read_if_there(spark, f"{path}/runs", RUNS).agg(F.max("run")).first()[0]
    folded = read_if_there(spark, f"{path}/folded", placed).filter(F.col("run") == run)
    upto = folded.agg(F.max("batch_id")).first()[0]
    changes = read_if_there(spark, f"{path}/changes", placed).filter(F.col("run") == run)
    if upto is not None:  # both are folders, so the others are not opened
        changes = changes.filter(F.col("batch_id") > upto).unionByName(folded.filter(F.col("batch_id") == upto))
    others = [f.name for f in schema if f.name not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("__row"))
    return last.select(*[F.col(f.name) if f.name in keys else F.col(f"__row.{f.name}") for f in schema])

"""Folders in the storage that driver and executors share, and tables written there."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleaner.functions.durable import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The full address of a folder that nobody has used, below the session's checkpoint folder."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd", row_group: int | None = None) -> DataFrame:
    """The rows written as Parquet to the shared storage and read back: no lineage, and no loss with an executor.

    A writer holds a row group in memory; with large binary columns `row_group` (bytes) keeps that small.
    """
    folder = new_folder(df.sparkSession, name)
    writer = df.write.option("compression", compression)
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded_batches(spark: SparkSession, most: int = 4 << 20, rows: int = 2048) -> None:
    """Bounds the batches that go to Python workers from now on, in bytes and rows; it changes no result.

    By default a batch of texts has up to 64 MB, which the sender, the worker and its arrays each hold once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def set_apart(docs: DataFrame, needed: Sequence[str]) -> DataFrame:
    """`docs` with names of their own for all columns that are not `needed`, so that no added column can clash with them."""
    return docs.toDF(*[c if c in needed else f"other {i}" for i, c in enumerate(docs.columns)])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives free memory back to the system when the task is over; workers outlive their tasks.

    Arrow's pool and the C library would keep it for this worker, next to what the other workers of the executor need.
    """
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
        if trim:
            trim(0)

    return run

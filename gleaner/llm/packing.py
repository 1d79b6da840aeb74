"""Concatenate and cut: all documents' tokens in one stream, cut into fixed windows.

Two passes. The first tokenises every partition on its own and stores the ids with each document's offset within the
partition. The partitions' token totals, one small row each, are prefix-summed into global offsets. The second adds them and
cuts each document where a window ends; a document that crosses a border gives one record on either side. No window of
documents is ever gathered, and only the very last sequence can need padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import ranks
from gleaner.llm import words as W
from gleaner.llm.storage import bounded_batches, lean, written
from gleaner.llm.tokens import memo, with_end

BATCH_BYTES = 2 << 20
#: Rows of partition totals (two numbers each) up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_PARTS = 500_000
PIECE = "struct(w as sequence_id, greatest(first, w * {n}) - first as start, greatest(first, w * {n}) - w * {n} as offset, least(first + doc_tokens, (w + 1) * {n}) - greatest(first, w * {n}) as length)"


def tokenised(docs: DataFrame, path: str, spaces: str, end_id: int) -> DataFrame:
    """`(part int, before long, doc_id, doc_tokens long, ids binary)`: each document's ids and `end_id` as little-endian unsigned 32-bit numbers."""
    fast = spaces == "dropped" and ranks.by_bytes(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            ids, counts = with_end(*memo(path, spaces, fast).encode([t or "" for t in table["text"].to_pylist()]), end_id)
            ends = np.cumsum(counts)
            offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes())
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends - counts), table["doc_id"].combine_chunks(), pa.array(counts), blobs],
                names=["part", "before", "doc_id", "doc_tokens", "ids"],
            )
            before += int(ends[-1])

    return docs.select("doc_id", "text").mapInArrow(lean(encode), "part int, before long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, spaces: str = "dropped", end_id: int = 2, window: int = 4096) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens.

    One row per piece: `doc_id, start` (the document's tokens before it), `length, ids` (little-endian unsigned 32-bit),
    `doc_tokens, sequence_id, offset` (place in the sequence), and `sequence_length`: the tokens of the sequence with its
    padding. A last sequence that is not full is padded to `window`, unless its length is a power of two, which stays as it
    is. Null and empty texts consist of `end_id` alone; repeated rows and null ids are documents of their own; a text of any
    length is encoded whole, alone if it is longer than a batch; an empty table has no pieces. `docs` needs `doc_id` and `text`; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stored = written(tokenised(docs, path, spaces, end_id), "tokens")
    totals = written(stored.groupBy("part").agg(F.sum("doc_tokens").alias("n")), "totals")
    # One row per partition of the input: the window is over as many rows as there were tasks.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    small = totals.count() <= BROADCAST_PARTS
    placed = stored.join(F.broadcast(offsets) if small else offsets, "part").withColumn("first", F.col("base") + F.col("before"))
    n = window
    cuts = F.expr(f"transform(sequence(first div {n}, (first + doc_tokens - 1) div {n}), w -> {PIECE.format(n=n)})")
    cut = placed.select("doc_id", "doc_tokens", "all", F.transform(cuts, lambda p: p.withField("ids", F.substr(F.col("ids"), (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int")))).alias("pieces"))
    pieces = cut.select("doc_id", "doc_tokens", "all", F.explode("pieces").alias("p")).select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "all")
    left = F.col("all") - F.col("sequence_id") * n  # tokens from the sequence's start to the end of all
    power = F.expr(f"(all - sequence_id * {n}) & (all - sequence_id * {n} - 1)") == 0
    padded = F.when((left >= n) | ~power, F.lit(n)).otherwise(left)
    return pieces.withColumn("sequence_length", padded.cast("int")).drop("all")


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """`(sequence_id, ids)`: the pieces of each sequence joined and padded. A sequence has at most `window` pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.max("sequence_length").alias("n"), F.array_join(F.transform(ordered, lambda p: F.hex(p["ids"])), "").alias("digits"))
    pad = "".join(f"{b:02X}" for b in pad_id.to_bytes(4, "little"))
    return joined.select("sequence_id", F.unhex(F.rpad("digits", 8 * F.col("n"), F.lit(pad))).alias("ids"))

"""Mixing sources to target weights, block by block.

The words of each source, document after document, are packed into blocks of one length for all sources. The mix is a row of output shards;
each shard draws how many of its slots every source gets (a multinomial with the targets as weights). A source's slots are
numbered through all shards, and slot number k takes the block that a pseudorandom permutation of the source's block numbers
has at place k; after a whole round another permutation follows. So every block of a source comes equally often, but for one,
and slots find their blocks by a join on (source, block number). Draws and permutations depend on the seed and on numbers
only, so reruns agree.

A source takes whole rounds, then part of one, whose last block is cut off where the source's target is met. What the shards have drawn
too much is left empty, and what they have drawn too little fills further slots behind the last shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.storage import lean, set_apart, shuffle_width, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; only the last one of a source is shorter.
BLOCK = 256
#: In place of its number, what names the block that is cut off to meet a target.
CUT_OFF = -1
SHARD_SLOTS = 4096
#: Shards that one task draws at most, and slots that are filled at once.
SHARDS_PER_TASK, RUN_SLOTS = 1024, 1 << 16
BATCH_BYTES = 2 << 20


# ---------------------------------------------------------------- targets

def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """The share of each source: the sum of all sizes by weight, none above `most` times its size, the excess shared anew."""
    sizes, weights = np.array(sizes, np.float64), np.array(weights, np.float64)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        left = sizes.sum() - out[~open_].sum()
        share = left * weights / weights[open_].sum()
        above = open_ & (share > most * sizes)
        if not above.any():
            out[open_] = share[open_]
            break
        out[above] = most * sizes[above]
        open_ &= ~above
    return out.tolist()


@dataclass
class Plan:
    """What one row per source says; sources are in order of their names, null last."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last: np.ndarray
    """The block of the last slot, of which only `words` words are taken; -1 where no block is cut off."""
    words: np.ndarray
    seed: int


def plan(totals: Sequence[tuple[str | None, int]], weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 5) -> Plan:
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = np.array([n for _, n in totals], np.int64)
    aims = np.array(targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], most))
    blocks = -(-sizes // BLOCK)
    rounds = np.minimum(aims // np.maximum(sizes, 1), most).astype(np.int64)
    rest = np.where(rounds >= most, 0, np.clip(np.round(aims - rounds * sizes).astype(np.int64), 0, sizes))
    # of the last round, as many blocks as hold the rest; the short block may be among them
    short = blocks * BLOCK - sizes
    number = np.arange(len(sizes))
    place = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(blocks > 0)
    keys = _key(number, rounds, seed)
    place[some] = permuted(blocks[some] - 1, blocks[some], keys[some], back=True)
    held = lambda n: n * BLOCK - np.where(place < n, short, 0)
    part = -(-rest // BLOCK)
    part += held(part) < rest
    words = rest - held(part - 1)
    cut = (part > 0) & (words < held(part) - held(part - 1))
    last = np.full(len(sizes), -1, np.int64)
    last[cut] = permuted(part[cut] - 1, blocks[cut], keys[cut])
    return Plan([n for n, _ in totals], sizes, aims, blocks, rounds * blocks + part, last, np.where(cut, words, 0), seed)


# ---------------------------------------------------------------- permutations

def _key(s: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """Names the permutation of a source's round."""
    return W.mix(np.full(len(s), seed, np.uint64) + (s.astype(np.uint64) << np.uint64(32))) + turn.astype(np.uint64)


def permuted(place: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """The number at `place` of the pseudorandom permutation of 0..size-1 that `key` names: a Feistel network, walked until it falls inside.

    `back` walks the other way and gives the place of a number.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = place.astype(np.uint64), np.ones(len(place), bool)
    key = key.astype(np.uint64)
    while open_.any():
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = out[open_] >> h, out[open_] & m
        for turn in reversed(range(4)) if back else range(4):
            if back:
                left, right = right ^ (W.mix(left + W.mix(k + np.uint64(turn))) & m), left
            else:
                left, right = right, left ^ (W.mix(right + W.mix(k + np.uint64(turn))) & m)
        out[open_] = (left << h) | right
        open_[open_] = out[open_] >= size[open_].astype(np.uint64)
    return out.astype(np.int64)


# ---------------------------------------------------------------- documents and slots

def sized(docs: DataFrame) -> DataFrame:
    """`docs` with `__row`, a number per row, and `__size`, its words."""
    return docs.withColumn("__row", F.monotonically_increasing_id()).withColumn(
        "__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    )


def _placed(rows: DataFrame, p: Plan) -> DataFrame:
    """`__row, __size, s` (the source's number) and `before`, the words of its source that lie before it.

    Offsets come in two steps: within each input partition, then over the partitions' totals, so a source of any size is spread.
    """
    numbers = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(p.names)], "source string, s int")
    part = F.shiftright("__row", 33).alias("part")  # monotonically_increasing_id numbers partitions in its upper bits
    known = rows.join(F.broadcast(numbers) if len(p.names) <= 100_000 else numbers, rows["source"].eqNullSafe(numbers["source"]))
    known = known.select("__row", "__size", "s", part)
    inside = Window.partitionBy("s", "part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = known.groupBy("s", "part").agg(F.sum("__size").alias("n")).select("s", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    local = known.withColumn("local", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return local.join(base, ["s", "part"]).select("__row", "__size", "s", (F.col("base") + F.col("local")).alias("before"))


def slots(spark, p: Plan) -> DataFrame:
    """`(shard long, slot long, s int, block long)`: the block of every slot that is filled, `CUT_OFF` for the one that is cut off."""
    total = int(p.slots.sum())
    shards = -(-total // SHARD_SLOTS)
    chance = p.slots / max(1, total)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                n = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                counts = np.random.default_rng([p.seed, shard]).multinomial(n, chance)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "s": some.astype(np.int32), "n": counts[some]})

    tasks = max(1, min(shards, max(64, shards // SHARDS_PER_TASK)))
    drawn = written(spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, s int, n long"), "draws")
    # a source's slots are numbered in two steps, within runs of shards and over these
    drawn = drawn.withColumn("part", F.expr(f"shard div {SHARDS_PER_TASK}"))
    inside = Window.partitionBy("s", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = drawn.groupBy("s", "part").agg(F.sum("n").alias("all")).select("s", "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    local = drawn.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    runs = local.join(base, ["s", "part"]).withColumn("first", F.col("base") + F.col("local"))
    got = {r.s: r.n for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row per source
    short = [(shards, i, int(want - got.get(i, 0)), int(got.get(i, 0))) for i, want in enumerate(p.slots) if want > got.get(i, 0)]
    runs = runs.select("shard", "s", "n", "first").unionByName(spark.createDataFrame(short, "shard long, s int, n long, first long"))
    # slots are filled where their shard falls, whatever the source; a long run is cut
    cut = runs.filter("n > 0").withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {RUN_SLOTS}L)")))
    cut = cut.select("shard", "s", F.least(F.col("n") - F.col("at"), F.lit(RUN_SLOTS)).alias("n"), (F.col("first") + F.col("at")).alias("first"))
    runs = cut.repartition(shuffle_width(spark), "shard", "first")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, s, n, first in zip(f["shard"], f["s"], f["n"], f["first"]):
                k = np.arange(first, min(first + n, int(p.slots[s])))
                if not len(k):
                    continue
                turn, size = k // p.blocks[s], np.full(len(k), p.blocks[s])
                block = permuted(k % p.blocks[s], size, _key(np.full(len(k), s), turn, p.seed))
                block[(k == p.slots[s] - 1) & (p.last[s] >= 0)] = CUT_OFF
                yield pd.DataFrame({"shard": shard, "slot": k, "s": np.int32(s), "block": block})

    return runs.mapInPandas(fill, "shard long, slot long, s int, block long")


def _totals(rows: DataFrame) -> list[tuple[str | None, int]]:
    """One row per source on the driver: the sources of a corpus are taken to be at most some hundred thousand."""
    return [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("__size").alias("n")).collect()]


def taken(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 5) -> DataFrame:
    """What the mix takes of each row of `docs` (`doc_id`, `text`, `source`; others are ignored): `doc_id, size, source_size, target, taken`.

    Null and empty texts have size 0 and are not taken. A null source is a source of its own, the last one. Repeated rows and
    null ids are documents of their own; an empty table gives no rows. No document is taken more than `most` times. What is
    taken of a source is its target, rounded to a whole word.
    """
    spark = docs.sparkSession
    rows = written(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "__row", "__size"), "sized")
    p = plan(_totals(rows), weights, most, seed)
    placed = written(_placed(rows, p), "placed")
    cut = placed.filter("__size > 0").withColumn("block", F.explode(F.expr(f"sequence(before div {BLOCK}, (before + __size - 1) div {BLOCK})")))
    begin, end = F.greatest("before", F.col("block") * BLOCK), F.least(F.col("before") + F.col("__size"), (F.col("block") + 1) * BLOCK)
    pieces = cut.select("s", "block", "__row", begin.alias("begin"), end.alias("end"))
    # what lies before the cut is a block of its own
    last = spark.createDataFrame([(i, int(b), int(b * BLOCK + n)) for i, (b, n) in enumerate(zip(p.last, p.words)) if b >= 0], "s int, block long, stop long")
    part = pieces.join(last, ["s", "block"]).withColumn("end", F.least("end", "stop")).withColumn("block", F.lit(CUT_OFF).cast("long")).filter("begin < end").drop("stop")
    pieces = pieces.unionByName(part).select("s", "block", "__row", (F.col("end") - F.col("begin")).alias("words"))
    found = pieces.join(slots(spark, p).select("s", "block"), ["s", "block"]).groupBy("__row").agg(F.sum("words").alias("taken"))
    about = spark.createDataFrame([(i, int(n), float(t)) for i, (n, t) in enumerate(zip(p.sizes, p.targets))], "s int, source_size long, target double")
    every = placed.join(about, "s").join(found, "__row", "left").join(rows.select("__row", "doc_id"), "__row")
    return every.select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 5) -> DataFrame:
    """The mix itself: the columns of `docs`, one row for each piece of a document that a block in a slot holds, with its text.

    `text` is the piece, from its first word to the next piece's (white space included); `n_chars`, where there is such a
    column, becomes its length. A piece is a document's share of one block, so pieces end only where blocks of `BLOCK` words
    do, or where the last block of a source is cut off; neighbouring pieces are not joined. Texts without words are not in the mix,
    and an empty table has none. A text of any length is cut whole, alone if it is longer than a batch. Other columns are kept,
    whatever their names.
    """
    spark, given = docs.sparkSession, docs.columns
    docs = set_apart(docs, ("doc_id", "text", "source", "n_chars"))
    rows = written(sized(docs), "sized")
    p = plan(_totals(rows), weights, most, seed)
    placed = _placed(rows.select("source", "__row", "__size"), p).filter("__size > 0").select("__row", F.col("s").alias("__s"), F.col("before").alias("__before"))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            for i in range(0, table.num_rows, 512):
                part = table.slice(i, 512)
                at, blocks, texts = [], [], []
                for j, (text, s, before) in enumerate(zip(part["text"].to_pylist(), part["__s"].to_pylist(), part["__before"].to_pylist())):
                    data, _ = W.utf8(pa.array([text]))
                    starts = W.word_starts(data)
                    numbers = np.arange(before // BLOCK, (before + len(starts) - 1) // BLOCK + 1)
                    ends = starts[np.maximum(numbers[1:] * BLOCK - before, 0)].tolist()
                    raw = data.tobytes()
                    for number, x, y in zip(numbers.tolist(), [0, *ends], [*ends, len(raw)]):
                        at.append(j)
                        blocks.append(number)
                        texts.append(raw[x:y].decode())
                        stop = number * BLOCK + int(p.words[s]) - before  # the document's words before the cut
                        if number == p.last[s] and stop > 0:
                            at.append(j)
                            blocks.append(CUT_OFF)
                            texts.append(raw[x: min(y, int(starts[stop])) if stop < len(starts) else y].decode())
                out = part.take(pa.array(at, pa.int64())).set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                out = out.append_column("__block", pa.array(blocks, pa.int64()))
                yield from out.select([*names, "__s", "__block"]).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __s int, __block long"
    pieces = rows.drop("__size").join(placed, "__row").mapInArrow(lean(cut), schema)
    mixed = pieces.join(slots(spark, p).select(F.col("s").alias("__s"), F.col("block").alias("__block")), ["__s", "__block"]).select(*names)
    mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else mixed
    return mixed.toDF(*given)

"""Hard negatives by segment summaries: exact scores only where bounds from means and deviations leave a doubt.

Every vector is cut into segments, and for each segment its mean and its deviation are stored. Over a segment of n components
an inner product is n times the product of the two means, plus or minus at most the product of the two deviations (as lengths
of the vectors of differences). The sum over segments bounds the score from both sides. Segments are halved level by level, so
bounds tighten; each level looks only at the rows that the one before has left. What is left at last is scored exactly.

Anchors and all rows meet in blocks: rows are dealt over shards by a hash, anchors over blocks, and a task works on one shard
and one block. A first round finds each anchor's positives; the second takes their scores along and finds each one's negatives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import shuffle_width, written
from gleaner.llm.vectors import groups, length_counts, matrices, unpack

SHARD_ROWS, ANCHOR_ROWS = 8_192, 2_048
#: Anchors whose bounds are computed in one matrix.
AT_ONCE = 128
#: Segments of the coarsest and of the finest summary; each level has twice as many as the one before.
COARSE, FINE = 4, 16
#: Relative to the product of the lengths of two vectors: far above what rounding can do to a bound.
MARGIN = 1e-9
LONG = 1 << 63


# ---------------------------------------------------------------- vectors and their summaries

def levels(dim: int) -> list[np.ndarray]:
    """Starts of the segments of each level; those of a level lie within those of the one before."""
    most = min(FINE, dim)
    counts = [c for c in (COARSE << i for i in range(32)) if c <= most] or [1]
    return [np.arange(c) * dim // c for c in counts]


def summary(vectors: np.ndarray) -> np.ndarray:
    """For every level the segments' means and then their deviations, each times the root of the segment's length."""
    dim, out = vectors.shape[1], []
    for starts in levels(dim):
        n = np.diff(np.append(starts, dim))
        sums = np.add.reduceat(vectors, starts, axis=1)
        off = vectors - np.repeat(sums / n, n, axis=1)
        out += [sums / np.sqrt(n), np.sqrt(np.add.reduceat(off * off, starts, axis=1))]
    return np.concatenate(out, axis=1)


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """`floor(scale * x)` as 64-bit numbers."""
    out = np.floor(scale * values)
    if len(out) and not (np.abs(out) < LONG).all():
        raise OverflowError("A scaled component does not fit into 64 bits")
    return out.astype(np.int64)


def summarised(table: DataFrame, scale: int, label: Column) -> DataFrame:
    """`(q, vec_id, label, vector binary, summary binary)` of usable rows; `q` is a number per row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column("embedding")):
                whole = _whole(values, scale)
                about = summary(whole.astype(np.float64))
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("label"), pa.array([v.tobytes() for v in whole], pa.binary()), pa.array([v.tobytes() for v in about], pa.binary())],
                    names=["vec_id", "label", "vector", "summary"],
                )

    usable = table.filter("vec_id is not null and label is not null and embedding is not null")
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    found = usable.mapInArrow(convert, "vec_id long, label long, vector binary, summary binary")
    return found.withColumn("q", F.monotonically_increasing_id())


# ---------------------------------------------------------------- one shard and one block of anchors

def _exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers without rounding."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
    if largest < 2**52:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return rows @ anchor
    exact = [sum(a * b for a, b in zip(r, anchor.tolist())) for r in rows.tolist()]
    if any(not -LONG <= x < LONG for x in exact):
        raise OverflowError("A score does not fit into 64 bits")
    return np.array(exact, np.int64)


class Shard:
    """The rows of a shard, in order of ids, with their summaries by level."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("id", kind="stable")
        self.ids, self.labels, self.q = (frame[c].to_numpy(np.int64) for c in ("id", "label", "q"))
        self.vectors = unpack(frame["vector"])
        self.parts = split_summary(unpack(frame["summary"], np.float64), self.vectors.shape[1])
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))

    def bounds(self, level: int, parts: list, norms: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of anchors (their summaries and lengths) with rows."""
        (mean, dev), (own_mean, own_dev) = parts[level], self.parts[level]
        middle = mean @ own_mean[rows].T
        reach = dev @ own_dev[rows].T + MARGIN * norms[:, None] * self.norms[rows] + MARGIN
        return middle - reach, middle + reach


def split_summary(about: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cuts = np.cumsum([len(s) for s in levels(dim) for _ in range(2)])
    parts = np.split(about, cuts[:-1], axis=1)
    return list(zip(parts[::2], parts[1::2]))


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or less than any if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best_between(shard: Shard, level: int, low: np.ndarray, high: np.ndarray, rows: np.ndarray, anchor: tuple, windows: Sequence[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least score, largest score) the `k` best of `rows`: scores and places, higher scores first, then smaller ids.

    `low` and `high` bound the scores of `rows` at `level`. A row stays in doubt for a window if it may lie in it and may
    reach the k-th largest lower bound of the rows that certainly lie in it.
    """
    vector, parts, norm = anchor
    for next_level in range(level + 1, len(shard.parts) + 1):
        doubt = np.zeros(len(rows), bool)
        for least, most in windows:
            floor = _kth(low[(low >= least) & (high <= most)], k)
            doubt |= (high >= max(least, floor)) & (low <= most)
        rows, low, high = rows[doubt], low[doubt], high[doubt]
        if next_level == len(shard.parts) or not len(rows):
            break
        new_low, new_high = shard.bounds(next_level, parts, norm, rows)
        low, high = np.maximum(low, new_low[0]), np.minimum(high, new_high[0])
    scores = _exact(shard.vectors[rows], vector)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        inside = inside[np.argsort(-scores[inside], kind="stable")[:k]]  # rows lie in order of ids
        out.append((scores[inside], rows[inside]))
    return out


def searched(frames: Iterator[pd.DataFrame], k: int, same: bool, share: tuple[int, int, int]) -> Iterator[pd.DataFrame]:
    """Groups of one shard and one block of anchors to the shard's best rows.

    With `same`, the `k` best rows of the anchor's label, for the anchor; else, for each distinct score of a positive in
    `wanted`, the `k` best rows of other labels in the window that belongs to it.
    """
    for _, group in groups(frames, ["dim", "shard", "block"]):
        rows, ask = group[group["side"] == 0], group[group["side"] == 1]
        if not len(rows) or not len(ask):
            continue
        shard = Shard(rows)
        vectors = unpack(ask["vector"])
        parts = split_summary(unpack(ask["summary"], np.float64), vectors.shape[1])
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        number, own, label, wanted = ask["q"].to_numpy(np.int64), ask["id"].to_numpy(np.int64), ask["label"].to_numpy(np.int64), list(ask["wanted"])
        found = {c: [] for c in ("q", "positive_score", "vec_id", "score")}
        for start in range(0, len(ask), AT_ONCE):
            stop = min(start + AT_ONCE, len(ask))
            some = [(m[start:stop], d[start:stop]) for m, d in parts]
            low, high = shard.bounds(0, some, norms[start:stop])
            for j, i in zip(count(), range(start, stop)):
                able = np.flatnonzero(((shard.labels == label[i]) == same) & (shard.ids != own[i]))
                asked = [0] if same else list(map(int, wanted[i]))
                windows = [(-np.inf, np.inf)] if same else [_window(p, share) for p in asked]
                mine = [(m[j: j + 1], d[j: j + 1]) for m, d in some]
                best = best_between(shard, 0, low[j, able], high[j, able], able, (vectors[i], mine, norms[i: i + 1]), windows, k)
                for p, (scores, places) in zip(asked, best):
                    found["q"].append(np.full(len(scores), number[i]))
                    found["positive_score"].append(np.full(len(scores), p))
                    found["vec_id"].append(shard.ids[places])
                    found["score"].append(scores)
        yield pd.DataFrame({c: np.concatenate(x) for c, x in found.items()})


def _window(positive: int, share: tuple[int, int, int]) -> tuple[int, int]:
    """Least and largest score s with `low * positive <= whole * s <= high * positive`, in whole numbers."""
    low, high, whole = share
    return -(-low * positive // whole), high * positive // whole


# ---------------------------------------------------------------- shards, blocks and rounds

def _round(rows: DataFrame, anchors: DataFrame, k: int, same: bool, share: tuple[int, int, int]) -> DataFrame:
    """`(q, positive_score, vec_id, score)`: the best of every shard for `anchors (q, dim, vec_id, label, vector, summary, wanted)`."""
    spark = rows.sparkSession
    n, asked = length_counts(rows), length_counts(anchors)
    sizes = spark.createDataFrame([(d, -(-c // SHARD_ROWS), -(-asked.get(d, 0) // ANCHOR_ROWS)) for d, c in n.items()], "dim int, shards long, blocks long")
    sides = []
    for side, df, own, other in ((0, rows, "shard", "block"), (1, anchors, "block", "shard")):
        placed = df.join(F.broadcast(sizes), "dim")  # one row per length of vectors, some thousands at most
        placed = placed.withColumn(own, F.pmod(F.xxhash64("q", F.lit(side)), F.col(f"{own}s"))).filter("blocks > 0")
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
        sides.append(placed.select("dim", "shard", "block", F.lit(side).alias("side"), F.col("vec_id").alias("id"), "q", "label", "vector", "summary", "wanted"))
    both = sides[0].unionByName(sides[1]).repartition(shuffle_width(spark), "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block")
    return both.mapInPandas(lambda x: searched(x, k, same, share), "q long, positive_score long, vec_id long, score long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    table: DataFrame, label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 10,
    share: tuple[int, int, int] = (30, 90, 100), scale: int = 256,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`: hard negatives of each anchor and positive.

    `table` has `vec_id`, `embedding` and what `label` needs; other columns are ignored. Anchors are the rows whose vec_id is
    divisible by `every`. Scores are inner products of `floor(scale * x)`. An anchor's positives are its `positives` best
    other rows of its label; the negatives of a positive are the best `negatives` rows of other labels whose score is between
    `share[0]` and `share[1]` in `share[2]` of the positive's. Equal scores go to the smaller vec_id. With fewer positives or
    negatives there are fewer rows, and an anchor or positive without any has none; a positive with a score below 0 has none.

    Rows with a null id, label or vector, without components, or with null or non-finite components take no part. Vectors
    meet those of their own length. Rows with an anchor's id are not its partners; a repeated anchor is answered as often as
    it occurs, and a repeated partner is listed as often. A scaled component or a score beyond 64 bits is an error, never a
    wrong number. An empty table gives no rows.
    """
    spark = table.sparkSession
    vectors = written(summarised(table, scale, F.col(label) if isinstance(label, str) else label), "vectors")
    vectors = vectors.withColumn("dim", (F.length("vector") / 8).cast("int")).withColumn("wanted", F.lit(None).cast("array<long>"))
    anchors = vectors.filter(F.col("vec_id") % every == 0)
    found = _first(_round(vectors, anchors, positives, True, share), ["q"], positives)
    found = written(found.select("q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "positives")
    # at most `positives` scores per anchor
    wanted = found.groupBy("q").agg(F.array_sort(F.collect_set("positive_score")).alias("wanted"))
    asked = written(anchors.drop("wanted").join(wanted, "q"), "anchors")
    best = _first(_round(vectors, asked, negatives, False, share), ["q", "positive_score"], negatives)
    best = best.select("q", "positive_score", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    each = asked.select("q", F.col("vec_id").alias("anchor_id")).join(found, "q").join(best, ["q", "positive_score"])
    return each.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

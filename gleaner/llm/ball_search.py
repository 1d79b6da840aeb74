"""Exact top-k inner products: ball-tree branch and bound per shard, with the k-th score shared between shards.

Vectors near each other share a shard (centres from a bounded sample; a centre's shard is split by size, so a very common
vector fills several). Of each shard a centre and a radius are known, so `query . centre + |query| * radius` bounds every
inner product in it. A query first searches the shard with the largest bound. The k-th score that it finds there goes with it
to all other shards whose bound reaches it, and in each of them to the nodes of the shard's ball tree, largest bound first,
until no node can hold a better vector. Bounds have a margin for rounding; scores are whole numbers, computed exactly, and one
that 64 bits cannot hold is an error.

A shard holds vectors of one length. Each length has centres of its own, and queries reach the shards of their own length only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import shuffle_width, written
from gleaner.llm.vectors import by_length, groups, kmeans, length_counts, matrices, nearest, samples, unpack

#: Rows of the sample that the centres are fitted on, and the most centres.
SAMPLE_ROWS, MOST_CENTRES = 20_000, 2_048
SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 8_192, 256, 1_024
MARGIN = 1e-6


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """`(vec_id, vector binary)`: `floor(scale * x)` of usable vectors as 64-bit numbers, whatever their lengths.

    Left out are null ids, null vectors, vectors without components, and those that hold null or non-finite components.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column("embedding")):
                whole = whole_numbers(values, scale)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array([v.tobytes() for v in whole], pa.binary())], names=["vec_id", "vector"])

    usable = table.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return usable.mapInArrow(convert, "vec_id long, vector binary")


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """`floor(scale * x)` as 64-bit numbers; one that does not fit is an error."""
    out = np.floor(scale * values)
    if not (np.abs(out) < 2.0**63).all():
        raise OverflowError("A scaled component does not fit into 64 bits")
    return out.astype(np.int64)


def long_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of large numbers; one that does not fit into 64 bits is an error."""
    own = query.tolist()
    out = [sum(a * b for a, b in zip(row, own)) for row in vectors.tolist()]
    if any(not -(1 << 62) <= x < 1 << 63 for x in out):
        raise OverflowError("A score does not fit into 64 bits")
    return np.array(out, np.int64)


class BallTree:
    """Nodes with centre and radius over at most a shard's vectors; halves along the direction of largest spread."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")  # equal scores are then found in order of ids
        self.vectors, self.ids = vectors[order], ids[order]
        # no inner product, nor any part of its sum, is beyond `largest` times the query's largest component
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, vectors.shape[1])
        self.points = self.vectors.astype(np.float64)
        self.centres, self.radii, self.children, self.rows = [], [], [], []
        self._build(np.arange(len(ids)))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _build(self, rows: np.ndarray) -> int:
        node, points = len(self.radii), self.points[rows]
        centre = points.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())))
        self.children.append(())
        self.rows.append(rows)
        if len(rows) > LEAF_ROWS and self.radii[node] > 0:
            along = (points - centre) @ (points[((points - centre) ** 2).sum(axis=1).argmax()] - centre)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            self.rows[node] = rows[:0]
            self.children[node] = (self._build(np.sort(rows[order[:half]])), self._build(np.sort(rows[order[half:]])))
        return node

    def scores(self, rows: np.ndarray, query: np.ndarray, as_float: np.ndarray) -> np.ndarray:
        """Exact inner products: in floating point below 2**53, which is faster, in 64 bits, or in whole numbers of any size."""
        most = self.largest * float(np.abs(as_float).max(initial=0))
        if most < 2**52:
            return (self.points[rows] @ as_float).astype(np.int64)
        if most < 2**62:
            return self.vectors[rows] @ query
        return long_products(self.vectors[rows], query)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its best `k` here (scores, ids) that reach the `known` k-th score; rows with the query's own id are none."""
        as_float = queries.astype(np.float64)
        norms = np.sqrt((as_float**2).sum(axis=1))
        bounds = as_float @ self.centres.T + norms[:, None] * self.radii
        bounds += MARGIN * (1 + np.abs(bounds))
        for i in range(len(queries)):
            floor, scores, ids = known[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= floor:
                node = heapq.heappop(heap)[1]
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                rows = self.rows[node]
                rows = rows[self.ids[rows] != own[i]]
                found = self.scores(rows, queries[i], as_float[i])
                keep = found >= floor
                if keep.any():
                    scores, ids = np.concatenate([scores, found[keep]]), np.concatenate([ids, self.ids[rows[keep]]])
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    if len(scores) == k:
                        floor = max(floor, scores[-1])
            if len(scores):
                yield i, scores, ids


RESULT = "query_id long, q long, vec_id long, score long"


def _search(pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """`pairs (q, query_id, vector, shard, floor)` against `members (shard, vec_id, vector)`; queries come in blocks."""
    blocks = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
    asked = asked.select("shard", "block", F.lit(1).alias("side"), F.col("query_id").alias("id"), "q", "vector", "floor")
    held = members.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("shard", "block", F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("q"), "vector", F.lit(0).cast("long").alias("floor"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in groups(frames, ["shard", "block"]):
            here, ask = group[group["side"] == 0], group[group["side"] == 1]
            if not len(here) or not len(ask):
                continue
            tree = BallTree(unpack(here["vector"]), here["id"].to_numpy(np.int64))
            own, number = ask["id"].to_numpy(np.int64), ask["q"].to_numpy(np.int64)
            rows = list(tree.search(unpack(ask["vector"]), own, k, ask["floor"].to_numpy(np.int64)))
            if rows:
                sizes = [len(s) for _, s, _ in rows]
                at = np.repeat([i for i, _, _ in rows], sizes)
                yield pd.DataFrame({"query_id": own[at], "q": number[at], "vec_id": np.concatenate([i for _, _, i in rows]), "score": np.concatenate([s for _, s, _ in rows])})

    both = asked.unionByName(held).repartition(shuffle_width(pairs.sparkSession), "shard", "block").sortWithinPartitions("shard", "block")
    return both.mapInPandas(find, RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the `k` largest inner products of each query with all other rows of its length.

    `table` has `vec_id` and `embedding`; other columns are ignored. Queries are the rows whose vec_id is divisible by `every`.
    Vectors are made whole by `floor(scale * x)`; see `whole_vectors` for those that take no part. Equal scores go to the
    smaller vec_id. Rows that repeat a query's id are not its candidates; a repeated query is answered as often as it occurs,
    a repeated candidate is listed as often. A scaled component or a score beyond 64 bits (below -2**62) is an error. With fewer than `k` candidates there are fewer ranks; an empty table gives none.
    """
    spark = table.sparkSession
    vectors = written(whole_vectors(table, scale), "vectors")
    counts = length_counts(vectors)
    n = sum(counts.values())
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # centres of each length: a bounded sample, chosen by a hash of the id; numbered through all lengths
    drawn = samples(vectors, counts, F.col("vec_id"), SAMPLE_ROWS)
    each = max(SHARD_ROWS, n // MOST_CENTRES)
    centres = {d: kmeans(drawn[d], int(np.clip(counts[d] // each, 1, MOST_CENTRES))) for d in sorted(counts)}
    start = dict(zip(centres, np.cumsum([0, *map(len, centres.values())]).tolist()))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, own in by_length(f):
                yield own.assign(centre=nearest(unpack(own["vector"]).astype(np.float64), centres[dim]).astype(np.int32) + start[dim])

    near = vectors.mapInPandas(assign, "vec_id long, vector binary, centre int")
    near = written(near.withColumn("q", F.monotonically_increasing_id()), "near")
    # large centres are split; together there are at most 2 * MOST_CENTRES shards and one per length, so what is known of them stays bounded
    limit = max(SHARD_ROWS, -(-n // MOST_CENTRES))
    parts = near.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("parts"))
    members = near.join(F.broadcast(parts), "centre").withColumn("shard", F.col("centre").cast("long") * 65536 + F.pmod(F.xxhash64("q"), F.col("parts")))
    members = written(members.select("shard", "q", "vec_id", "vector"), "members")

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, own in f.groupby("shard"):
                points = unpack(own["vector"]).astype(np.float64)
                dim = points.shape[1]
                hub = centres[dim][(shard >> 16) - start[dim]]
                yield pd.DataFrame({"shard": [shard], "dim": [dim], "radius": [float(np.sqrt(((points - hub) ** 2).sum(axis=1).max()))]})

    known = members.select("shard", "vector").mapInPandas(spans, "shard long, dim int, radius double").groupBy("shard", "dim").agg(F.max("radius").alias("radius")).toPandas()
    shards = {d: own["shard"].to_numpy(np.int64) for d, own in known.groupby("dim")}
    hubs = {d: centres[d][(shards[d] >> 16) - start[d]] for d in shards}
    radii = {d: own["radius"].to_numpy(np.float64) for d, own in known.groupby("dim")}

    def bounded(queries: np.ndarray) -> np.ndarray:
        dim = queries.shape[1]
        b = queries @ hubs[dim].T + np.sqrt((queries**2).sum(axis=1))[:, None] * radii[dim]
        return b + MARGIN * (1 + np.abs(b))

    lowest = -(1 << 62)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, own in by_length(f):
                at = bounded(unpack(own["vector"]).astype(np.float64)).argmax(axis=1)
                yield own.assign(shard=shards[dim][at], floor=lowest)

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, own in by_length(f):
                for i in range(0, len(own), 256):
                    some = own.iloc[i: i + 256]
                    reach = bounded(unpack(some["vector"]).astype(np.float64)) >= some["floor"].to_numpy(np.float64)[:, None]
                    reach &= shards[dim][None, :] != some["shard"].to_numpy()[:, None]
                    row, col = np.nonzero(reach)
                    yield some.iloc[row].assign(shard=shards[dim][col])

    ask = "q long, query_id long, vector binary, shard long, floor long"
    queries = members.filter(F.col("vec_id") % every == 0).select("q", F.col("vec_id").alias("query_id"), "vector")
    home = written(queries.mapInPandas(first, ask), "home")
    held = members.select("shard", "vec_id", "vector")
    early = written(_best(_search(home, held, k), k), "early")
    floors = early.filter(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    rest = home.join(floors, "q", "left").select("q", "query_id", "vector", "shard", F.coalesce("kth", "floor").alias("floor")).mapInPandas(others, ask)
    late = _search(written(rest, "rest"), held, k)
    both = early.select("query_id", "q", "vec_id", "score").unionByName(late)
    return _best(both, k).select("query_id", "rank", "vec_id", "score")

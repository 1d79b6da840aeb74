"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own, fitted on a bounded sample. The pairs of codes form a
grid of cells, and every vector lies in one of them. A vector looks for its neighbours in the cells nearest to it, in the order
of the sum of both halves' distances (multi-sequence traversal). How many cells it visits is found on the sample: so many that
neighbours exactly at the threshold, drawn in random directions, would be met with the target recall; copies and closer
neighbours are met sooner. Every vector is indexed, and every pair that meets in a cell is compared in double precision. Each
length of vectors has codebooks and cells of its own.

Equal vectors of one label are one vector with a weight. What remains of a crowded cell is searched in square blocks: a
task gets two bounded sets of vectors, counts links per vector, and joins linked vectors to the smallest one of the block
before it writes anything, so that output stays linear where links are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.storage import shuffle_width, written
from gleaner.llm.vectors import by_length, distances, groups, kmeans, length_counts, matrices, samples, unpack

SAMPLE_ROWS, RECALL_ROWS, MOST_CODES = 20_000, 2_000, 512
#: Vectors per cell that the number of codes aims at; vectors of either side of a block; cells visited at most per half code.
CELL_ROWS, BLOCK_ROWS, FRONT = 128, 1_024, 32


class Grid:
    """Two codebooks, and the number of cells that a vector visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    def nearest_cells(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The `n` nearest cells of each vector, nearest first: cell = code of the first half * codes of the second + its code.

        The n smallest sums of two sorted lists lie within their n smallest entries each.
        """
        half = unit.shape[1] // 2
        a, b = distances(unit[:, :half], self.first), distances(unit[:, half:], self.second)
        na, nb = min(n, a.shape[1]), min(n, b.shape[1])
        ia, ib = np.argsort(a, axis=1, kind="stable")[:, :na], np.argsort(b, axis=1, kind="stable")[:, :nb]
        sums = (np.take_along_axis(a, ia, 1)[:, :, None] + np.take_along_axis(b, ib, 1)[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(sums, axis=1, kind="stable")[:, : min(n, na * nb)]
        return np.take_along_axis(ia, order // nb, 1) * len(self.second) + np.take_along_axis(ib, order % nb, 1)


def fit(sample: np.ndarray, rows: int, similarity: float, recall: float, seed: int = 3) -> Grid:
    """Codebooks for about `rows` vectors, and the visits that reach `recall` at the threshold."""
    half = sample.shape[1] // 2
    codes = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, MOST_CODES))
    grid = Grid(kmeans(sample[:, :half], codes, seed=seed), kmeans(sample[:, half:], codes, seed=seed + 1))
    rng = np.random.default_rng(seed)
    some = sample[rng.permutation(len(sample))[:RECALL_ROWS]]
    noise = rng.standard_normal(some.shape)
    noise -= (noise * some).sum(axis=1, keepdims=True) * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    other = similarity * some + np.sqrt(1 - similarity**2) * noise
    limit = min(len(grid.first) * len(grid.second), FRONT * FRONT)
    target = grid.nearest_cells(other, 1)
    met = np.concatenate([grid.nearest_cells(some[i: i + 128], limit) == target[i: i + 128] for i in range(0, len(some), 128)])
    reached = np.cumsum(met.mean(axis=0))  # of the neighbours, by the number of cells visited
    grid.visits = min(int(np.searchsorted(reached, recall)) + 1, limit)
    return grid


def block_links(a: pd.DataFrame, b: pd.DataFrame, similarity: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of the visitors `a` and the members `b` of one block: links per vector, and each linked vector's smallest one.

    A pair can meet in both vectors' cells, each visiting the other's. It counts for the visitor where it visits; the member's
    side is counted here as well if the member does not visit the visitor's cell.
    """
    x, y = (unpack(f["vector"], np.float64) for f in (a, b))
    ra, rb = a["row"].to_numpy(np.int64), b["row"].to_numpy(np.int64)
    linked = (x @ y.T >= similarity) & (ra[:, None] != rb[None, :])
    i, j = np.nonzero(linked)
    if not len(i):
        return pd.DataFrame(), pd.DataFrame()
    homes, visits = a["home"].to_numpy(), np.stack(b["cells"].to_numpy())
    back = np.zeros(len(i), bool)
    for c in range(visits.shape[1]):
        back |= visits[j, c] == homes[i]
    wa, wb = a["weight"].to_numpy(np.int64), b["weight"].to_numpy(np.int64)
    row = np.concatenate([ra[i], rb[j[~back]]])
    weight = np.concatenate([wb[j], wa[i[~back]]])
    nodes, at = np.unique(row, return_inverse=True)
    counts = pd.DataFrame({"u": nodes, "v": nodes, "n": np.bincount(at, weights=weight).astype(np.int64)})
    # smallest reachable vector within the block
    low_a, low_b = ra.copy(), rb.copy()
    while True:
        new_b = low_b.copy()
        np.minimum.at(new_b, j, low_a[i])
        new_a = low_a.copy()
        np.minimum.at(new_a, i, new_b[j])
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    edges = pd.DataFrame({"u": np.concatenate([ra, rb]), "v": np.concatenate([low_a, low_b]), "n": 0})
    return counts, edges[edges["u"] != edges["v"]].drop_duplicates()


def near_duplicates(table: DataFrame, similarity: float = 0.93, recall: float = 0.99) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for every row of `table` (`vec_id`, `embedding`, `label`; others are ignored).

    Two vectors link when their lengths are equal, their labels are equal and not null, and their cosine is at least
    `similarity`. Null vectors, zero vectors, vectors with null or non-finite components, and rows without label link with
    nothing. `n_links` counts the other rows linked directly, equal vectors included; `component_id` is the smallest
    vec_id reachable by links; `kept` tells whether it is the row's own (null ids: not kept). Repeated rows are rows of their own.
    """
    spark = table.sparkSession
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None] * batch.num_rows
            for at, values in matrices(batch.column("embedding")):
                largest = np.abs(values).max(axis=1, keepdims=True)
                length = np.linalg.norm(values / np.maximum(largest, 1e-300), axis=1, keepdims=True) * largest
                use = length[:, 0] > 0
                for i, v in zip(at[use].tolist(), values[use] / length[use]):
                    vectors[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label")), pa.array(vectors, pa.binary())], names=["row", "vec_id", "label", "vector"])

    kind = table.schema["label"].dataType.simpleString()
    every = written(rows.mapInArrow(units, f"row long, vec_id long, label {kind}, vector binary"), "units")
    usable = every.filter("label is not null and vector is not null")
    distinct = usable.groupBy("label", "vector").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("weight"))
    distinct = written(distinct, "distinct")
    counts = length_counts(distinct)
    drawn = samples(distinct, counts, F.col("row"), SAMPLE_ROWS, np.float64) if counts else {}
    grids = {dim: fit(drawn[dim], n, similarity, recall) for dim, n in counts.items()}

    def place_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, own in by_length(f):
                grid = grids[dim]
                for i in range(0, len(own), 512):
                    part = own.iloc[i: i + 512]
                    # the cells of a length are numbered behind those of the shorter ones
                    cells = dim * MOST_CODES**2 + grid.nearest_cells(unpack(part["vector"], np.float64), grid.visits)
                    yield part.assign(home=cells[:, 0], cells=list(cells))

    placed = distinct.mapInPandas(place_cells, f"label {kind}, vector binary, row long, weight long, home long, cells array<long>")
    placed = written(placed, "cells")
    visits = placed.select("label", "row", F.explode("cells").alias("cell"))
    crowd = visits.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["label", "cell", "i", "j", "side", "row", "weight", "home", "vector", "cells"]
    asked = placed.withColumn("cell", F.explode("cells")).join(crowd, ["label", "cell"]).withColumn("i", own).withColumn("j", each).withColumn("side", F.lit(0)).withColumn("cells", F.array().cast("array<long>"))
    held = placed.withColumn("cell", F.col("home")).join(crowd, ["label", "cell"]).withColumn("j", own).withColumn("i", each).withColumn("side", F.lit(1))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in groups(frames, ["label", "cell", "i", "j"]):
            a, b = group[group["side"] == 0], group[group["side"] == 1]
            if len(a) and len(b):
                yield from (f for f in block_links(a, b, similarity) if len(f))

    both = asked.select(*columns).unionByName(held.select(*columns)).repartition(shuffle_width(spark), "label", "cell", "i", "j")
    found = written(both.sortWithinPartitions("label", "cell", "i", "j").mapInPandas(compare, "u long, v long, n long"), "links")

    # rows with equal vectors: one representative has their links; a representative links to its copies
    copies = usable.join(distinct.select("label", "vector", F.col("row").alias("first"), "weight"), ["label", "vector"]).select("row", "first", "weight")
    copies = written(copies, "copies")
    counts = found.filter("u = v").groupBy(F.col("u").alias("first")).agg(F.sum("n").alias("n"))
    edges = found.filter("u <> v").select("u", "v").unionByName(copies.select(F.col("row").alias("u"), F.col("first").alias("v")).filter("u <> v"))
    placed_rows = components(edges).select(F.col("node").alias("row"), "component")
    linked = copies.join(counts, "first", "left").select("row", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    result = every.select("row", "vec_id").join(linked, "row", "left").join(placed_rows, "row", "left")
    result = written(result.withColumn("component", F.coalesce("component", "row")), "result")
    names = result.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return result.join(names, "component").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )

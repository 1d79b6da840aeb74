"""Helpers for vector operators: reading vectors, k-means on a sample, groups of sorted streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a component in packed vectors.
COMPONENT = 8


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of `dim` finite numbers without nulls, and these rows as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not dim:
        return np.zeros(len(column), bool), np.zeros((0, 1))
    good = np.array(pc.equal(pc.list_value_length(column), dim).fill_null(False))
    rows = column.filter(pa.array(good))
    flat = rows.flatten()
    if flat.null_count:
        holes = np.asarray(flat.is_null()).reshape(-1, dim).any(axis=1)
        good[np.flatnonzero(good)[holes]] = False
        rows = column.filter(pa.array(good))
        flat = rows.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(values).all(axis=1)
    good[np.flatnonzero(good)[~finite]] = False
    return good, values[finite]


def matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the column: the row numbers of its usable vectors (see `matrix`), and these as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(pc.list_value_length(column).fill_null(0))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows) and lengths[rows[0]]:
            good, values = matrix(column.take(pa.array(rows)), int(lengths[rows[0]]))
            if len(values):
                yield rows[good], values


def unpack(column, kind: type = np.int64) -> np.ndarray:
    """Packed vectors of one length, at least one, as a matrix."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def by_length(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each length of the column `vector` of packed vectors."""
    yield from frame.groupby(frame["vector"].map(len) // COMPONENT, sort=False)


def length_counts(vectors: DataFrame) -> dict[int, int]:
    """How many packed vectors there are of each length; the lengths of a table are taken to be at most some thousands."""
    counts = vectors.groupBy((F.length("vector") / COMPONENT).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return {r.dim: r.n for r in counts.collect()}


def samples(vectors: DataFrame, counts: dict[int, int], key: Column, rows: int, kind: type = np.int64) -> dict[int, np.ndarray]:
    """A sample of about `rows` packed vectors by a hash of `key`, by length.

    Each length gets its share, and at least an equal part of `rows`, so that rare lengths have a sample, too. Where a length
    has none all the same, its sample is one vector of zeros.
    """
    total = sum(counts.values())
    rate = {d: min(1.0, max(rows / total, rows / (len(counts) * n))) for d, n in counts.items()}
    rates = vectors.sparkSession.createDataFrame([(d, int((1 << 30) * r)) for d, r in rate.items()], "dim int, below long")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    known = vectors.select("vector", place.alias("place"), (F.length("vector") / COMPONENT).cast("int").alias("dim"))
    some = known.join(F.broadcast(rates), "dim").filter("place < below").limit(rows * (2 if len(counts) == 1 else 4)).select("vector").collect()
    out: dict[int, np.ndarray] = {d: np.zeros((1, d)) for d in counts}
    return out | {d: unpack(f["vector"], kind) for d, f in by_length(pd.DataFrame({"vector": [r.vector for r in some]}))}


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """At most `k` centres of a sample that fits into memory."""
    rng = np.random.default_rng(seed)
    points = np.asarray(points, np.float64)
    if len(points) <= k:
        return np.unique(points, axis=0) if len(points) else np.zeros((1, points.shape[1]))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        at = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        counts = np.bincount(at, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.choice(len(points), len(centres))])
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to what a point has with all centres."""
    return (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i: i + 4096], centres).argmin(axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The groups of a stream that is sorted by `keys`, one at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        codes = frame[keys].to_numpy()
        cuts = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frame)]):
            part = frame.iloc[a:b]
            if held and tuple(held[0][keys].iloc[0]) != tuple(part[keys].iloc[0]):
                yield tuple(held[0][keys].iloc[0]), pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield tuple(held[0][keys].iloc[0]), pd.concat(held, ignore_index=True)

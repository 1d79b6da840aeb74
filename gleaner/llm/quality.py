"""Quality classifier: statistics of whole texts, random Fourier features, ridge regression, isotonic calibration.

Every text becomes a short vector of statistics (no words, no ids, so nothing of the label table can leak in). Random Fourier
features approximate a Gaussian kernel over it: a linear model on them is a smooth non-linear one on the statistics. Its
normal equations are sums over rows: every partition adds up its own, and the driver adds the partitions' and solves. The raw
scores of labelled rows that the equations did not see are then mapped to probabilities by an isotonic (monotone) step curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.storage import lean, written

BATCH_BYTES = 2 << 20
#: Classes of bytes that statistics count; the last number is for bytes beyond ASCII.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c",
    "line": b"\n", "stop": b".?", "pause": b",;:'\"()-", "shout": b"!", "frame": b"|<>{}[]\\/=_~^`", "symbol": b"#$%&*+@",
}
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _chars in enumerate(CLASSES.values()):
    CLASS_OF[list(_chars)] = _i
CLASS_OF[128:] = len(CLASSES) + 1
WIDTH = len(CLASSES) + 2
N_STATS = WIDTH + 8


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `N_STATS` numbers per text; an empty text has zeros."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * WIDTH, sizes) + CLASS_OF[data], minlength=n * WIDTH).reshape(n, WIDTH)
    words, counts = W.word_hashes(data, offsets)
    size, count = np.maximum(sizes, 1), np.maximum(counts, 1)
    doc = np.repeat(np.arange(n), counts)

    def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and the largest repetition per text."""
        keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        owners = (keys[starts] >> np.uint64(40)).astype(np.int64)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, owners, np.diff(np.append(starts, len(keys))))
        return np.bincount(owners, minlength=n), most

    kinds_of_words, most = distinct(words, doc)
    triples = W.mix(words[:-2] + words[1:-1] * W.PLACES[2] + words[2:] * W.PLACES[3]) if len(words) > 2 else words[:0]
    inside = doc[: len(triples)] == doc[len(doc) - len(triples):]
    kinds_of_triples, most_triple = distinct(triples[inside], doc[: len(triples)][inside])
    n_triples = np.maximum(counts - 2, 1)
    lines = kinds[:, 4] + 1
    return np.column_stack([
        kinds / size[:, None], np.log1p(sizes), np.log1p(counts), sizes / count, np.log1p(sizes / lines),
        kinds_of_words / count, most / count, kinds_of_triples / n_triples, most_triple / n_triples,
    ]) * (sizes > 0)[:, None]


def statistics(docs: DataFrame) -> DataFrame:
    """`(doc_id, stats array<double>)` per row of `docs`."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            stats = text_statistics(*W.utf8(table["text"]))
            lists = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), lists], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(lean(compute), "doc_id long, stats array<double>")


@dataclass
class Model:
    """A fitted classifier; a few hundred numbers per feature, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        waves = np.cos(((stats - self.mean) / self.scale) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(stats))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators: block centres and block means."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def fit(labelled: DataFrame, features: int = 256, bandwidth: float = 4.0, ridge: float = 1e-4, train_rows: int = 200_000, seed: int = 7) -> Model:
    """A model from `labelled (doc_id, stats, y double)`.

    At most about `train_rows` rows are used, chosen by a hash of the id; four fifths of them for the equations, the rest for the
    calibration. Without rows of both labels the score is the mean label, or one half without any row.
    """
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((N_STATS, features)) / bandwidth
    phases = rng.uniform(0, 2 * np.pi, features)
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), directions, phases, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    rows = written(labelled.select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("place")), "labelled")
    n, mean_y, low, high = rows.agg(F.count("y"), F.avg("y"), F.min("y"), F.max("y")).first()
    if not n or low == high:
        model.values = np.full(1, 0.5 if not n else float(mean_y))
        return model
    rows = rows.filter(F.col("place") < (1 << 20) * min(1.0, train_rows / n))
    moments = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x"), F.stddev_pop("x")).collect()
    for i, mean, deviation in moments:
        model.mean[i], model.scale[i] = mean, deviation if deviation > 1e-9 else 1.0
    calibrates = F.col("place") % 5 == 0

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for f in frames:
            for i in range(0, len(f), 2048):
                z = model.features(np.stack(f["stats"].to_numpy()[i: i + 2048]))
                a += z.T @ z
                b += z.T @ f["y"].to_numpy()[i: i + 2048]
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    # at most 16 partial sums of fixed size come to the driver
    parts = rows.filter(~calibrates).coalesce(16).mapInPandas(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(p.a).reshape(features + 1, -1) for p in parts)
    b = sum(np.frombuffer(p.b) for p in parts)
    model.weights = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(features + 1), b)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"x": model.raw(np.stack(f["stats"].to_numpy())), "y": f["y"]})

    seen = rows.filter(calibrates).mapInPandas(raw, "x double, y double").toPandas()  # at most a fifth of train_rows
    if len(seen):
        model.steps, model.values = isotonic(seen["x"].to_numpy(), seen["y"].to_numpy())
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, usable: object = None) -> tuple[DataFrame, Model]:
    """The documents' statistics, stored, and a model of `labels (doc_id, quality)` for those ids that `usable` allows.

    Several labels of one id count with their mean; null labels are left out.
    """
    stats = written(statistics(docs), "statistics")
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = known if usable is None else known.filter(usable)
    return stats, fit(stats.join(known, "doc_id"))


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """`(doc_id, score, predicted)` per row of `stats`. Null and empty texts are scored like any other."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s = model.score(np.stack(f["stats"].to_numpy()))
                yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return stats.mapInPandas(score, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` (all their columns) whose score reaches `threshold`; the model learns from all `labels` of them."""
    _, model = fit_documents(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            good = model.score(text_statistics(*W.utf8(table["text"]))) >= threshold
            yield from table.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(lean(keep), docs.schema)

"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A letter's place within an n-gram is told by rotating
its vector; the rotated vectors are bound by multiplication into the vector of the n-gram; all n-grams of a text are bundled by
addition. A language's prototype is the bundle of all its training texts. A text gets the language whose prototype has the
largest cosine with it, after what all prototypes share has been taken out of them.

All sums are of whole numbers, so they do not depend on how the rows are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W

DIMENSIONS, GRAM, SEED = 1024, 3, 11
BATCH_BYTES, ROWS_AT_ONCE, CELLS = 2 << 20, 256, 1 << 24
#: N-grams whose counts and vectors are held at once.
SLICE = 8192
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 per code point, the same everywhere."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :] + (codes.astype(np.uint64)[:, None] << np.uint64(20)) + np.uint64(SEED << 52)
    bits = np.unpackbits(W.mix(W.mix(words)).view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) << 1) - 1


def bundles_of(texts: list[str], slice_size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of each text's n-grams (texts x dimensions), and whether it has any.

    Letters are lower-cased; anything between letters is one blank; a text begins and ends with a blank. A text without letters
    has no n-grams. Distinct n-grams are taken `slice_size` at a time, so scripts of many letters need no more memory; sums are
    of whole numbers, so slices change nothing.
    """
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    letter = _letter_table()[codes]
    first = np.append(True, owner[1:] != owner[:-1])
    keep = letter | first
    keep[1:] |= letter[:-1]  # one blank after letters
    codes, owner = np.where(letter, codes, 32)[keep], owner[keep]
    alphabet, symbols = np.unique(codes, return_inverse=True)
    k = len(alphabet)
    whole = (owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, bool)
    # an n-gram is a number in base k; with a large alphabet these are renumbered
    grams = ((symbols[:-2].astype(np.int64) * k + symbols[1:-1]) * k + symbols[2:])[whole]
    if k**3 <= CELLS:
        seen = np.zeros(k**3, bool)
        seen[grams] = True
        kinds = np.flatnonzero(seen)
        number = np.zeros(k**3, np.int64)
        number[kinds] = np.arange(len(kinds))
        at = number[grams]
    else:
        kinds, at = np.unique(grams, return_inverse=True)
    holder = owner[:-2][whole] if len(owner) > 2 else np.zeros(0, np.int64)
    letters, sums = letter_vectors(alphabet), np.zeros((len(texts), DIMENSIONS))
    if len(kinds) > slice_size:
        order = np.argsort(at, kind="stable")
        at, holder = at[order], holder[order]
    for start in range(0, len(kinds), slice_size):
        part = kinds[start: start + slice_size]
        here = slice(*np.searchsorted(at, [start, start + slice_size])) if len(kinds) > slice_size else slice(None)
        counts = np.bincount(holder[here] * len(part) + at[here] - start, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        vectors = np.roll(letters, 2, axis=1)[part // (k * k)] * np.roll(letters, 1, axis=1)[part // k % k] * letters[part % k]
        sums += _product(counts, vectors)
    return sums, np.bincount(holder, minlength=len(texts)) > 0


def _chunks(table: pa.Table) -> Iterator[pa.Table]:
    for i in range(0, table.num_rows, ROWS_AT_ONCE):
        yield table.slice(i, ROWS_AT_ONCE)


def _product(counts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact: 32-bit floating point where its whole numbers suffice."""
    kind = np.float32 if counts.size == 0 or counts.sum(axis=1).max() < 1 << 24 else np.float64
    return counts.astype(kind) @ vectors.astype(kind)


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their bundles, from `docs (text, lang)`. What reaches the driver is one vector per language and partial sum."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            for part in _chunks(table):
                sums, _ = bundles_of([t or "" for t in part["text"].to_pylist()])
                langs, at = np.unique(np.array(part["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
                member = (np.arange(len(langs))[:, None] == at[None, :]).astype(np.float64)
                for lang, row in zip(langs, member @ sums):
                    held[lang] = held.get(lang, 0) + row.astype(np.int64)
        yield from _rows(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, vector in zip(batch.column("lang").to_pylist(), batch.column("vector").to_pylist()):
                held[lang] = held.get(lang, 0) + np.frombuffer(vector, np.int64)
        yield from _rows(held)

    def _rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["lang", "vector"])

    schema = "lang string, vector binary"
    parts = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(bundle, schema)
    total: dict[str, np.ndarray] = {}
    for row in parts.repartition(16).mapInArrow(add, schema).collect():  # 16 vectors per language
        total[row.lang] = total.get(row.lang, 0) + np.frombuffer(row.vector, np.int64)
    names = sorted(name for name, v in total.items() if v.any())
    return names, np.array([total[name] for name in names], dtype=np.float64).reshape(len(names), DIMENSIONS)


def profiles(bundles: np.ndarray) -> np.ndarray:
    """Unit prototypes without their common part (kept whole when there is only one)."""
    unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
    return unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, names: list[str], bundles: np.ndarray) -> DataFrame:
    """`(doc_id, lang_pred, score)` per row: the best language and its cosine (0 if negative), over the whole text.

    A null text and one without letters, and every text if there are no languages, get `und` with score 0. Equal cosines give
    the first language by name. Repeated rows are answered each; a text of any length is taken whole, and a task's memory grows
    with its longest text; an empty table gives no rows. `docs` needs `doc_id` and `text`; other columns are ignored.
    """
    unit = profiles(bundles)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            for part in _chunks(table):
                sums, lettered = bundles_of([t or "" for t in part["text"].to_pylist()])
                best, score = np.zeros(len(sums), np.int64), np.zeros(len(sums))
                known = lettered if len(names) else np.zeros(len(sums), bool)
                if known.any():
                    cosine = np.round(sums[known] @ unit.T / np.maximum(np.linalg.norm(sums[known], axis=1, keepdims=True), 1e-12), 9)
                    best[known], score[known] = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0.0, 1.0)
                langs = [names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(langs), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(classify, "doc_id long, lang_pred string, score double")


def held_out(column: str, parts: int, part: int):
    """Whether the CRC-32 of the id as text leaves the remainder `part`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))

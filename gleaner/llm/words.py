"""Vectorised hashes of words and word shingles over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the hashes; any others would do, but results of one run must share them.
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * PLACES[0]
    x = (x ^ (x >> np.uint64(27))) * PLACES[1]
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = WORD_BASE
    return np.multiply.accumulate(out)


def _hash_piece(data: np.ndarray, at_doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = IS_SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    first = ~space & (before | at_doc_start)
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    values = (LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    values[space] = 0
    return starts, mix(np.add.reduceat(values, starts))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where the words of one text begin."""
    space = IS_SPACE[data]
    before = np.append(True, space[:-1]) if len(space) else space
    return np.flatnonzero(~space & before)


def word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and the number of words per text.

    Some `piece` bytes are hashed at once, for which arrays of some forty times as many bytes are made.
    """
    starts_at = np.zeros(len(data) + 1, dtype=bool)
    starts_at[offsets[:-1]] = True
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data):  # cut where a word ends; a word longer than a piece makes the piece longer
            spaces = np.flatnonzero(IS_SPACE[data[max(at, end - 65536): end]])
            if len(spaces):
                end = max(at, end - 65536) + int(spaces[-1]) + 1
                break
            end = min(len(data), end + 65536)
        s, h = _hash_piece(data[at:end], starts_at[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending within the text, and their number per text.

    A text of fewer words than `width` has its whole word sequence as the only shingle; one without words has none.
    """
    words, counts = word_hashes(data, offsets, piece)
    ends = np.cumsum(counts)
    if not len(words):
        return words, counts
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for i in range(width):
        total += padded[i: i + len(words)] * PLACES[i % 6] * np.uint64(2 * (i // 6) + 1)
    left = np.repeat(ends, counts) - np.arange(len(words))  # words from here to the end of the text
    use = left >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    heads = (ends - counts)[short]
    use[heads] = True
    for head, n in zip(heads, counts[short]):
        total[head] = (words[head: head + n] * PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)
    hashes = mix(total)[use]
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(cuts[:-1], cuts[1:]):
        hashes[a:b].sort()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[keep], np.bincount(doc[keep], minlength=len(sizes))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Tables of about `most` bytes of text each (a longer text alone), whatever the size of the incoming batches."""
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = np.diff(utf8(batch.column(column))[1])
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            take = max(1, int(np.searchsorted(total, done + most - size, side="right")) - at)
            held.append(batch.slice(at, take))
            size += int(total[at + take - 1] - done)
            at += take
            if size >= most * 0.9:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)

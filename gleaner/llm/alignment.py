"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection of their end offsets.

Both tokenizers split the bytes of a blank and the text. Each gives an ascending list of byte offsets where its tokens end. The
shorter list drives: each of its ends is searched in the longer one by doubling steps from where it should lie in proportion,
then by halving. All ends of a batch of texts are searched at once. An end that is found is a common one; common ends cut both
lists into groups. The difference of the ranks of two neighbouring driving ends is the range of tokens of the other side that
a driving token overlaps: the links.

How often two ids are linked is counted over the whole corpus. A chunk of texts gives each distinct pair of ids once, with its
number; pairs are summed by shuffle, and what a chunk needs of the sums goes back to it by another. No table of pairs is
broadcast or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.storage import shuffle_width, written
from gleaner.llm.tokens import BYTES, ENCODE_AT_ONCE, WordMemo

#: Bytes of text that are aligned at once, and those whose pairs are counted together; a longer text is worked on alone.
BATCH_BYTES, CHUNK_BYTES = 1 << 20, 16 << 20
#: Added to the second tokenizer's ids where both tokenizers' ids lie in one list.
SECOND = 1 << 20
ROWS_AT_ONCE = 1024


class PairMemo(WordMemo):
    """Ids of both tokenizers for texts that begin with a blank; a word is looked up once for both.

    A piece of the second vocabulary has its blanks, as U+2581, at its beginning or consists of them, and no piece but the
    one of the single byte holds a line break; so merges stay within the same words as the first tokenizer's.
    """

    def __init__(self, first: str, second: str):
        import sentencepiece

        super().__init__(first, "leading")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = {v: k for k, v in BYTES.items()}
        names = self.tokenizer.get_vocab()
        blank = "▁"
        a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        b = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(blank, " ").encode() for i, p in enumerate(b)]
        self.sides = _Bytes(a), _Bytes(b)
        self.alone = self.pieces.piece_to_id(blank)
        # decimal ids with the mark behind them: a comma, or what ends the side's part of the group
        self.marked = [f"{i}{m}" for i in range(len(a)) for m in ",|"] + [f"{i}{m}" for i in range(len(b)) for m in ",;"]

    def _words(self, text: str) -> list[str] | None:
        words = super()._words(text[1:])
        if words:
            words[0] = words[0][:-1]  # with the blank before the text, its first word is like any other
        return words

    def _seconds(self, texts: list[str]) -> list[list[int]]:
        """The second tokenizer's ids of texts that begin with a blank, which it adds itself, or with a line break."""
        out = self.pieces.encode([t if t[0] == "\n" else t[1:] for t in texts], num_threads=1)
        return [ids[1:] if t[0] == "\n" and ids[:1] == [self.alone] else ids for t, ids in zip(texts, out)]

    def _store(self, texts: list[str]) -> range:
        first = self.entries
        for i in range(0, len(texts), ENCODE_AT_ONCE):
            some = texts[i: i + ENCODE_AT_ONCE]
            a = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
            self._keep([x + [SECOND + j for j in y] for x, y in zip(a, self._seconds(some))])
        return range(first, self.entries)

    def _learn(self, words: list[str]) -> None:
        plain = {w: ids for w in words if (ids := self._plain(w)) is not None}
        texts = [w if w[0] == "\n" else " " + w for w in plain]
        self.place.update(zip(plain, self._keep([a + [SECOND + j for j in b] for a, b in zip(plain.values(), self._seconds(texts))])))
        rest = [w for w in words if w not in plain]
        self.place.update(zip(rest, self._store([w if w[0] == "\n" else " " + w for w in rest])))


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        return self.data[np.arange(int(lengths.sum())) + np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)]


@lru_cache(maxsize=1)
def memo(first: str, second: str) -> PairMemo:
    """One memo per worker, kept from task to task."""
    return PairMemo(first, second)


def gallop(wanted: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each wanted offset the place in `ends` of the first one that is not smaller, between `low` and `high` (exclusive).

    `ends[high - 1]` must not be smaller than the offset. Steps from `guess` double until they have passed the place, then halve.
    """
    at = np.clip(guess, low, high - 1)
    right = ends[at] < wanted  # the way to go
    left_end, right_end = np.where(right, at + 1, low), np.where(right, high - 1, at)
    open_ = np.flatnonzero(left_end < right_end)
    step = 1
    while len(open_):
        to_right = right[open_]
        probe = np.where(to_right, np.minimum(at[open_] + step, right_end[open_]), np.maximum(at[open_] - step, left_end[open_]))
        below = ends[probe] < wanted[open_]
        left_end[open_] = np.where(below, probe + 1, left_end[open_])
        right_end[open_] = np.where(below, right_end[open_], probe)
        open_ = open_[(to_right == below) & (left_end[open_] < right_end[open_])]
        step *= 2
    open_ = np.flatnonzero(left_end < right_end)
    while len(open_):
        middle = (left_end[open_] + right_end[open_]) >> 1
        below = ends[middle] < wanted[open_]
        left_end[open_] = np.where(below, middle + 1, left_end[open_])
        right_end[open_] = np.where(below, right_end[open_], middle)
        open_ = open_[left_end[open_] < right_end[open_]]
    return left_end


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers `starts[i] .. starts[i] + counts[i] - 1`, one range after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Aligned:
    """Texts of a batch in which the same side drives: tokens of both sides in a row, `n[side]` of them per text."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], n: tuple[np.ndarray, np.ndarray], drives: int):
        self.ids, self.n = ids, n
        d, o = drives, 1 - drives
        first = [np.cumsum(x) - x for x in n]
        text = np.repeat(np.arange(len(n[d])), n[d])
        inside = np.arange(len(ids[d])) - first[d][text]
        guess = first[o][text] + (inside + 1) * n[o][text] // np.maximum(n[d][text], 1) - 1
        rank = gallop(ends[d], ends[o], first[o][text], first[o][text] + n[o][text], guess)
        common = ends[o][rank] == ends[d]
        # a driving token overlaps from the token at the end before it, or the next one if that end is common, to its own rank
        begin = np.zeros(len(rank), np.int64)
        begin[1:] = rank[:-1] + common[:-1]
        span = rank - begin + 1
        links = [None, None]
        links[d], links[o] = np.repeat(np.arange(len(rank)), span), _spread(begin, span)
        self.links = tuple(links)
        self.link_text = np.repeat(text, span)
        at = np.flatnonzero(common)
        self.group_text = text[at]
        last = [None, None]
        last[d], last[o] = at, rank[at]
        self.group_sizes = tuple(np.diff(x, prepend=-1) for x in last)

    def group_texts(self, memo: PairMemo) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text."""
        sizes = np.stack(self.group_sizes, axis=1).ravel()  # of A, of B, of A, ...
        places = np.cumsum(sizes) - sizes
        codes = np.empty(int(sizes.sum()), np.int64)
        for side, offset in ((0, 0), (1, 2 * len(memo.sides[0].lengths))):
            own = self.group_sizes[side]
            ends = np.zeros(len(self.ids[side]), np.int64)
            ends[np.cumsum(own) - 1] = 1
            codes[_spread(places[side::2], own)] = offset + 2 * self.ids[side] + ends
        words = list(map(memo.marked.__getitem__, codes.tolist()))
        cuts = np.append(0, np.cumsum(self.n[0] + self.n[1])).tolist()
        return ["".join(words[a:b])[:-1] for a, b in zip(cuts[:-1], cuts[1:])]


def _split(memo: PairMemo, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Ids and their numbers per text of both sides, only of texts whose tokens give back their bytes; and which texts these are."""
    both, counts = memo.encode(texts)
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.repeat(np.arange(len(texts)), counts)
    second = both >= SECOND
    ids = [both[~second].astype(np.int64), both[second].astype(np.int64) - SECOND]
    owner = [text[~second], text[second]]
    good = np.ones(len(texts), bool)
    for side, x, t in zip(memo.sides, ids, owner):
        good &= np.bincount(t, weights=side.lengths[x], minlength=len(texts)).astype(np.int64) == size
    for side, x, t in zip(memo.sides, ids, owner):
        now = np.flatnonzero(good)
        data = np.frombuffer(b"".join(map(raw.__getitem__, now.tolist())), np.uint8)
        wrong = np.flatnonzero(data != side.joined(x[good[t]]))
        good[now[np.searchsorted(np.cumsum(size[now]), wrong, side="right")]] = False
    n = [np.bincount(t, minlength=len(texts))[good] for t in owner]
    return [x[good[t]] for x, t in zip(ids, owner)], n, good


def _pick(memo: PairMemo, ids: list[np.ndarray], n: list[np.ndarray], chosen: np.ndarray, drives: int) -> Aligned:
    own = tuple(x[np.repeat(chosen, m)] for x, m in zip(ids, n))
    ends = tuple(np.cumsum(side.lengths[x]) for side, x in zip(memo.sides, own))
    return Aligned(own, ends, (n[0][chosen], n[1][chosen]), drives)


FOUND = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, pair long, n long"
TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
SCHEMA = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in FOUND.split(", ")])
PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")


def _rows(height: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(height, f.type) for f in SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


class _Chunk:
    """What a task keeps of the texts whose pairs are counted together."""

    def __init__(self):
        self.bytes, self.rows, self.codes, self.times, self.cuts = 0, [], [], [], [0]

    def add(self, doc_ids: list, texts: list[str | None], memo: PairMemo, digest: bool) -> None:
        some = [i for i, t in enumerate(texts) if t]
        ids, n, good = _split(memo, [" " + texts[i] for i in some])
        places = np.array(some, np.int64)[good]
        numbers = {c: np.zeros(len(texts), np.int64) for c in PER_TEXT}
        groups, codes, times = [""] * len(texts), [np.zeros(0, np.uint32)] * len(texts), [np.zeros(0, np.int32)] * len(texts)
        fewer = n[0] <= n[1]
        for drives, chosen in ((0, fewer), (1, ~fewer)):
            if not chosen.any():
                continue
            a, at = _pick(memo, ids, n, chosen, drives), places[chosen]
            numbers["n_a"][at], numbers["n_b"][at] = a.n
            numbers["n_groups"][at] = np.bincount(a.group_text, minlength=len(at))
            numbers["n_links"][at] = np.bincount(a.link_text, minlength=len(at))
            for i, g in zip(at.tolist(), a.group_texts(memo)):
                groups[i] = hashlib.sha256(g.encode()).hexdigest() if digest else g
            pair = a.ids[0][a.links[0]] * len(memo.sides[1].lengths) + a.ids[1][a.links[1]]
            key = np.sort(a.link_text << 40 | pair)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            cuts = np.searchsorted(key[new] >> 40, np.arange(len(at) + 1))
            pair, many = (key[new] & ((1 << 40) - 1)).astype(np.uint32), np.diff(np.append(new, len(key))).astype(np.int32)
            for i, x, y in zip(at.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                codes[i], times[i] = pair[x:y], many[x:y]
        self.rows.append((doc_ids, numbers, groups))
        self.codes += codes
        self.times += times
        self.bytes += sum(map(len, filter(None, texts)))

    def out(self, batch: int) -> Iterator[pa.RecordBatch]:
        """The distinct pairs of the chunk, and its texts with the steps from one of their pairs to the next."""
        flat = np.concatenate(self.codes)
        pairs, place = np.unique(flat, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(self.times), minlength=len(pairs)).astype(np.int64)
        for i in range(0, len(pairs), 1 << 16):
            some = pairs[i: i + (1 << 16)].astype(np.int64)
            yield _rows(len(some), batch=np.full(len(some), batch), pair=some, n=total[i: i + (1 << 16)])
        cuts = np.cumsum([0, *map(len, self.codes)])
        first = 0
        for doc_ids, numbers, groups in self.rows:
            for i in range(0, len(doc_ids), ROWS_AT_ONCE):
                own = slice(i, i + ROWS_AT_ONCE)
                which = range(first + i, first + min(i + ROWS_AT_ONCE, len(doc_ids)))
                steps = [np.diff(place[cuts[j]: cuts[j + 1]], prepend=0).astype("<i4").tobytes() for j in which]
                yield _rows(
                    len(which), batch=np.full(len(which), batch), doc_id=doc_ids[own], groups=groups[own], places=steps,
                    times=[self.times[j].astype("<i4").tobytes() for j in which], **{c: numbers[c][own] for c in PER_TEXT},
                )
            first += len(doc_ids)


def chunk_rows(batches: Iterator[pa.RecordBatch], first: str, second: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Texts to their groups and links, and chunks to their distinct pairs."""
    own, number, chunk = memo(first, second), TaskContext.get().partitionId() << 32, _Chunk()
    for table in W.by_bytes(batches, "text", BATCH_BYTES):
        chunk.add(table["doc_id"].to_pylist(), table["text"].to_pylist(), own, digest)
        if chunk.bytes >= CHUNK_BYTES:
            yield from chunk.out(number)
            number, chunk = number + 1, _Chunk()
    if chunk.rows:
        yield from chunk.out(number)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, its pairs first: the corpus-wide counts go to the links of the chunk's texts."""
    batch, held, total, best = None, [], None, None
    for rows in batches:
        key = rows.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            part = rows.slice(a, b - a)
            if key[a] != batch:
                batch, held, total = key[a], [], None
            known = part.num_rows - part.column("pair").null_count
            if known:
                held.append((part.column("total").slice(0, known).to_numpy(), part.column("best").slice(0, known).to_numpy()))
            texts = part.slice(known)
            if not texts.num_rows:
                continue
            if total is None:
                total, best = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            steps = [np.frombuffer(x, "<i4") for x in texts.column("places").to_pylist()]
            times = [np.frombuffer(x, "<i4").astype(np.int64) for x in texts.column("times").to_pylist()]
            place = [np.cumsum(s, dtype=np.int64) for s in steps]
            sums = pa.array([int((total[p] * t).sum()) for p, t in zip(place, times)], pa.int64())
            good = pa.array([int(t[total[p] == best[p]].sum()) for p, t in zip(place, times)], pa.int64())
            found = {c: texts.column(c) for c in ("doc_id", *PER_TEXT, "groups")} | {"n_best": good, "count_sum": sums}
            names = [x.split()[0] for x in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([found[c] for c in names], names=names)


def align(docs: DataFrame, first: str, second: str, digest: bool = False) -> DataFrame:
    """One row per row of `docs` (`doc_id`, `text`; others are ignored): `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`.

    `first` is the file of a byte-level tokenizer, `second` that of a sentence-piece model with byte fallback. `groups` is the
    alignment itself, `a1,a2|b1;a3|b2,b3`: ids of the first and of the second tokenizer between two common ends, or with
    `digest` its SHA-256 (the alignment of a corpus is several times as long as its texts). `n_links` counts the pairs of
    token occurrences that overlap, `count_sum` adds up how often each link's pair of ids is linked in the corpus, and
    `n_best` counts the links whose pair is as frequent as any with the same second id.

    Null and empty texts, and texts that the tokens of either side do not give back byte for byte, have no tokens: zeros and
    an empty `groups`. Repeated rows and null ids are texts of their own and count as often as they occur. A text of any
    length is aligned whole; a task's memory grows with its longest text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(source.mapInArrow(lambda x: chunk_rows(x, first, second, digest), FOUND), "aligned")
    pairs = found.filter("pair is not null").select("batch", "pair", "n")
    size = _second_size(second)
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("second", F.col("pair") % size)
    totals = written(totals, "totals")
    highest = totals.groupBy("second").agg(F.max("total").alias("best"))
    known = totals.join(highest, "second").select("pair", "total", "best")
    own = pairs.select("batch", "pair").join(known, "pair")
    texts = found.filter("pair is null").drop("pair", "n")
    both = own.unionByName(texts, allowMissingColumns=True).repartition(shuffle_width(spark), "batch")
    return both.sortWithinPartitions("batch", F.col("pair").asc_nulls_last()).mapInArrow(summed, ALIGNED)


@lru_cache(maxsize=4)
def _second_size(second: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()

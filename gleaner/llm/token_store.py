"""Token ids in binary shards with a minimal perfect hash index per shard.

An archive is a folder in the shared storage:

- `shard-*.bin`: the raw ids of the shard's documents, end ids included, one after the other (little-endian unsigned, 16 or 32 bit).
- `shard-*.idx`: header; a minimal perfect hash function of the shard's document ids (levels of bits with the number of set
  bits before each word); per slot a 32-bit fingerprint, the first row and the number of rows; and where each row begins.
- `manifest`: a Parquet table with one row per shard: file, smallest and largest id, rows, tokens.

Documents lie in ascending doc_id order over all shards, so a document's start is its shard's base (a prefix sum over the
shards) and its place in the shard. Looking a key up takes a fixed number of steps: its shard, its slot, the fingerprint that
tells a stranger, its rows' bounds, one read of exactly its ids.

Tasks write files under names of their own and list them in the manifest; files of a lost attempt are listed nowhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import ranks
from gleaner.llm import words as W
from gleaner.llm.storage import lean, new_folder, shuffle_width
from gleaner.llm.tokens import memo, with_end

MAGIC, LEVELS, ROOM = 0x314B4F5453, 32, 2
BATCH_BYTES = 2 << 20
READ_BYTES = 8 << 20
MANIFEST = "shard string, low long, high long, empty_ids long, rows long, tokens long, width int"


# ---------------------------------------------------------------- files

def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a full address, so that any shared store works."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


# ---------------------------------------------------------------- minimal perfect hash

def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(W.PLACES[2]) % (1 << 64))
    return (W.mix(keys + salt) % np.uint64(size)).astype(np.int64)


def key_hash(ids: np.ndarray) -> np.ndarray:
    """A one-to-one mapping, so different ids never fall together."""
    return W.mix(ids.astype(np.int64).view(np.uint64) ^ W.PLACES[3])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (W.mix(keys ^ W.PLACES[4]) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Level by level, the keys that are alone in their cell get a bit; the others go on to the next level.

    A key's slot is the number of set bits before its own. Keys that are left after the last level (hardly ever any) are kept
    in order and follow.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.ranks, self.rest = sizes, bits, ranks, rest
        self.placed = int(ranks[-1] + np.bitwise_count(bits[-1])) if len(bits) else 0

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(keys) and len(sizes) < LEVELS:
            size = -(-ROOM * len(keys) // 64) * 64
            at = _level(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ones = np.bitwise_count(bits).astype(np.int64)
        return PerfectHash(np.array(sizes, np.int64), bits, (np.cumsum(ones) - ones).astype(np.int64), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot per key, -1 for keys that surely are none of those it was built from."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _level(keys[open_], level, size) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.ranks[word] + below)[hit]
            open_, base = open_[~hit], base + size
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            known = self.rest[at] == keys[open_]
            out[open_[known]] = self.placed + at[known]
        return out


def index_bytes(ids: np.ndarray, empty_ids: int, counts: np.ndarray) -> bytes:
    """The index of a shard. `ids`: ascending, one per row after the first `empty_ids` rows, which have none."""
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    keys = key_hash(ids[first])
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    marks, rows, many = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    marks[slot], rows[slot], many[slot] = fingerprint(keys), first + empty_ids, np.diff(np.append(first, len(ids)))
    head = np.array([MAGIC, len(keys), len(counts), len(table.sizes), len(table.bits), len(table.rest), empty_ids], np.int64)
    sections = [head, table.sizes, table.bits, table.ranks, table.rest, rows, many, np.append(0, np.cumsum(counts)), marks]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in sections)


class Index:
    def __init__(self, data: bytes):
        head = np.frombuffer(data, np.int64, 7)
        if head[0] != MAGIC:
            raise ValueError("not an index of a token shard")
        _, keys, rows, levels, cells, rest, self.empty_ids = head.tolist()
        at = 56
        found = []
        for n, kind in ((levels, np.int64), (cells, np.uint64), (cells, np.int64), (rest, np.uint64), (keys, np.int64), (keys, np.int64), (rows + 1, np.int64), (keys, np.uint32)):
            found.append(np.frombuffer(data, kind, n, at))
            at += found[-1].nbytes
        self.hash = PerfectHash(*found[:4])
        self.first, self.many, self.bounds, self.marks = found[4:]

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows per id; no rows for an id that the shard lacks."""
        if not len(self.marks):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        keys = key_hash(ids)
        slot = self.hash.slots(keys)
        known = (slot >= 0) & (self.marks[slot] == fingerprint(keys))
        return np.where(known, self.first[slot], 0), np.where(known, self.many[slot], 0)


# ---------------------------------------------------------------- writing

def write(docs: DataFrame, path: str, spaces: str = "leading", end_id: int = 0, folder: str | None = None, shards: int | None = None) -> str:
    """Writes an archive of `docs` (`doc_id`, `text`; other columns are ignored) and returns its folder.

    Null and empty texts consist of `end_id` alone. Rows with a null doc_id come first; repeated ids lie together, in any
    order. An empty table gives an archive without shards.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-store")
    fast = spaces == "leading" and ranks.spaced_by_bytes(path)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, ids, counts, empty_ids, out = f"shard-{uuid.uuid4().hex}", [], [], 0, None
        tokens = memo(path, spaces, fast)
        kind = np.dtype("<u2" if max(tokens.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            out = out or fs.open_output_stream(f"{root}/{name}.bin")
            coded, n = with_end(*tokens.encode([t or "" for t in table["text"].to_pylist()]), end_id)
            out.write(coded.astype(kind).tobytes())
            known = table["doc_id"].drop_null().to_numpy()
            empty_ids += table.num_rows - len(known)
            ids.append(known)
            counts.append(n)
        if out is None:
            return
        out.close()
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        with fs.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(index_bytes(ids, empty_ids, counts))
        low, high = (int(ids[0]), int(ids[-1])) if len(ids) else (None, None)
        yield pa.RecordBatch.from_pylist(
            [{"shard": name, "low": low, "high": high, "empty_ids": empty_ids, "rows": len(counts), "tokens": int(counts.sum()), "width": kind.itemsize}],
            schema=pa.schema([("shard", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("empty_ids", pa.int64()), ("rows", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]),
        )

    # the second key spreads an id that very many rows have
    spread = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = spread.repartitionByRange(shards or shuffle_width(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered.select("doc_id", "text").mapInArrow(lean(store), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


# ---------------------------------------------------------------- reading

@lru_cache(maxsize=4)
def _shard(folder: str, name: str) -> tuple[Index, pa.NativeFile]:
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/{name}.idx") as f:
        index = Index(f.read())
    return index, fs.open_input_file(f"{root}/{name}.bin")


def _payloads(file: pa.NativeFile, begins: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The byte ranges, in order; neighbouring ones come in one read."""
    i = 0
    while i < len(begins):
        j = i + 1
        while j < len(begins) and begins[j] == ends[j - 1] and ends[j] - begins[i] <= READ_BYTES:
            j += 1
        data = file.read_at(int(ends[j - 1] - begins[i]), int(begins[i]))
        for k in range(i, j):
            yield data[begins[k] - begins[i]: ends[k] - begins[i]]
        i = j


def read(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """`(doc_id, start, n_tokens, ids)` of every archived row whose doc_id occurs in `keys(doc_id)`; ids as 32-bit numbers.

    `start` counts the ids of all documents before it. Keys that the archive lacks give no row; repeated keys count once.
    """
    # one short row per shard; of an id whose rows lie in several shards, those where it is the highest come first
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: (r.low is not None, r.low or 0, r.high or 0))
    names, tokens = [r.shard for r in shards], np.array([r.tokens for r in shards], np.int64)
    bases = np.cumsum(tokens) - tokens
    width = shards[0].width if shards else 4
    with_ids = np.array([i for i, r in enumerate(shards) if r.low is not None], np.int64)
    low, high = np.array([shards[i].low for i in with_ids], np.int64), np.array([shards[i].high for i in with_ids], np.int64)
    without = np.array([i for i, r in enumerate(shards) if r.empty_ids], np.int64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["doc_id"].dropna().astype("int64").to_numpy()
            if len(with_ids):
                first, last = np.searchsorted(high, ids, "left"), np.searchsorted(low, ids, "right")
                n = np.maximum(last - first, 0)
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield pd.DataFrame({"shard": with_ids[at], "doc_id": pd.array(np.repeat(ids, n), dtype="Int64")})
            if f["doc_id"].isna().any() and len(without):
                yield pd.DataFrame({"shard": without, "doc_id": pd.array([None] * len(without), dtype="Int64")})

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for number, part in f.groupby("shard", sort=True):
                index, file = _shard(folder, names[number])
                ids = part["doc_id"].dropna().astype("int64").to_numpy()
                first, many = index.rows(ids)
                rows = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                owner = pd.array(np.repeat(ids, many), dtype="Int64")
                if part["doc_id"].isna().any():
                    rows = np.concatenate([np.arange(index.empty_ids), rows])
                    owner = pd.array([None] * index.empty_ids + owner.tolist(), dtype="Int64")
                order = np.argsort(rows, kind="stable")
                rows, owner = rows[order], owner[order]
                for i in range(0, len(rows), 1024):
                    some = rows[i: i + 1024]
                    begins, ends = index.bounds[some], index.bounds[some + 1]
                    raw = _payloads(file, begins * width, ends * width)
                    yield pd.DataFrame({
                        "doc_id": owner[i: i + 1024], "start": bases[number] + begins, "n_tokens": ends - begins,
                        "ids": [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in raw],
                    })

    placed = keys.select("doc_id").distinct().mapInPandas(place, "shard long, doc_id long")
    return placed.repartition(shuffle_width(spark), "shard").mapInPandas(fetch, "doc_id long, start long, n_tokens long, ids binary")

"""N-gram Jaccard join by vertical partitioning: near-duplicate texts of a whole corpus, and their groups.

Every text becomes its set of word shingles. The global order of all shingles (by hash) is cut into fragments; each fragment
holds the posting lists of its shingles and works alone:

1. A fragment counts, for every posting list, the overlap of its first text with each of the others. These partial overlaps
   are summed per pair over all fragments. A sum that reaches the threshold proves a link. The work is linear in the posting
   lists, and a large group of near copies is linked to its first text without forming pairs within the group.
2. A fragment also knows which shingles no other text has. A text can only link if enough of its shingles are shared, so
   most texts leave here. The others get their shared shingles back with their frequency class.
3. Texts that remain and agree in a smallest shingle of either of two orders are likely near copies: within such a group one
   walks from text to text along exactly compared links.
4. For all texts that remain, rarest shingles first, two linked texts must share one of the first `shared - needed + 1` ones.
   Pairs that share one, and are not yet in one component, are compared exactly. Together with 1 and 3 this finds every component.

A shingle that many texts of one batch share is combined there: one text goes on in the name of all, so that a posting list
holds at most `HOT` texts of each batch. Neither texts nor links nor components are ever collected.

Shingles are compared by 64-bit hashes (48 of the bits and the fragment), which for two given texts is exact but for one chance in about 10^12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.graph import components
from gleaner.llm.storage import bounded_batches, lean, set_apart, shuffle_width, written
from gleaner.llm.vectors import groups

#: Shingles of this many texts or more form one frequency class; it is also the size from which a batch combines them.
HOT = 64
BATCH_BYTES, PIECE_BYTES = 2 << 20, 1 << 19
#: Row groups of tables with large binary columns.
ROW_GROUP = 16 << 20
#: Texts of a group that are compared in one go.
GROUP_ROWS = 2048
LOW48 = np.uint64((1 << 48) - 1)

# kind 0: shingles of a fragment; 1: shared shingles of texts; 2: partial overlaps of pairs; 3: one row per text.
ROWS = "kind byte, key int, u long, doc_id long, nu int, k0 long, k1 long, a binary, b binary, c binary, d binary"
COLUMNS = [x.split()[0] for x in ROWS.split(", ")]
TYPES = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in ROWS.split(", ")])


def _table(height: int, **columns) -> pa.RecordBatch:
    arrays = []
    for field in SCHEMA:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(height, field.type))
        elif isinstance(value, (int, np.integer)):
            arrays.append(pa.array(np.full(height, value), field.type))
        elif isinstance(value, pa.Array):
            arrays.append(value.cast(field.type))
        elif isinstance(value, np.ndarray) and value.dtype == np.uint64:
            arrays.append(pa.array(value.view(np.int64), field.type))
        else:
            arrays.append(pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def _runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal rows."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def _bucket(rows: np.ndarray, width: int) -> np.ndarray:
    return (W.mix(rows.astype(np.uint64)) % np.uint64(width)).astype(np.int32)


def _shared_blocks(row: np.ndarray, hashes: np.ndarray, level: np.ndarray, width: int) -> pa.RecordBatch:
    """Shared shingles of texts, one block per bucket of texts."""
    bucket = _bucket(row, width)
    order = np.lexsort((row, bucket))
    row, hashes, level, bucket = row[order], hashes[order], level[order], bucket[order]
    starts, lengths = _runs(bucket)
    a, b, c, d = [], [], [], []
    for s, n in zip(starts, lengths):
        at, count = _runs(row[s: s + n])
        a.append(row[s: s + n][at].tobytes())
        b.append(count.astype(np.int32).tobytes())
        c.append(hashes[s: s + n].tobytes())
        d.append(level[s: s + n].tobytes())
    return _table(len(starts), kind=1, key=bucket[starts], a=a, b=b, c=c, d=d)


def _stars(row: np.ndarray, sizes: np.ndarray, start_of: np.ndarray, per_mille: int, width: int) -> pa.RecordBatch:
    """Partial overlaps of each posting list's first text with its others, one block per bucket of texts.

    Lists lie in a row; `start_of` is where each entry's list begins. Pairs whose sizes are too different are left out.
    """
    hub = row[start_of]
    hub_n, other_n = sizes[start_of], sizes
    fits = (hub != row) & (1000 * np.minimum(hub_n, other_n).astype(np.int64) >= per_mille * np.maximum(hub_n, other_n).astype(np.int64))
    columns = _summed(hub[fits], row[fits], hub_n[fits], other_n[fits], np.ones(int(fits.sum()), np.int64))
    bucket = _bucket(columns[1], width)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in columns], bucket[order]
    starts, lengths = _runs(bucket)
    cut = lambda c, kind: [c[s: s + n].astype(kind).tobytes() for s, n in zip(starts, lengths)]
    hub, other, hub_n, other_n, counts = columns
    return _table(len(starts), kind=2, key=bucket[starts], a=cut(hub, np.int64), b=cut(other, np.int64), c=cut(hub_n.astype(np.int64) << 32 | other_n, np.int64), d=cut(counts, np.int64))


def _summed(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """One row per pair, its counts added up."""
    order = np.lexsort((v, u))
    u, v, nu, nv, n = (x[order] for x in (u, v, nu, nv, n))
    starts, _ = _runs(u, v)
    return [u[starts], v[starts], nu[starts], nv[starts], np.add.reduceat(n, starts) if len(starts) else n]


def shingle_rows(batches: Iterator[pa.RecordBatch], fragments: int, width: int, per_mille: int) -> Iterator[pa.RecordBatch]:
    """Texts to one row each, and blocks of their shingles by fragment."""
    for table in W.by_bytes(batches, "text", BATCH_BYTES):
        row = table["row"].to_numpy()
        hashes, counts = W.shingle_sets(*W.utf8(table["text"]), width, PIECE_BYTES)
        cuts = np.cumsum(counts) - counts
        some = counts > 0
        k0, k1 = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
        if len(hashes):
            k0[some] = np.add.reduceat(W.mix(hashes ^ W.PLACES[3]), cuts[some])
            k1[some] = np.add.reduceat(W.mix(hashes + W.PLACES[4]), cuts[some])
        yield _table(len(row), kind=3, key=_bucket(row, fragments), u=row, doc_id=table["doc_id"].combine_chunks(), nu=counts.astype(np.int32), k0=k0, k1=k1)
        if not len(hashes):
            continue
        owner = np.repeat(row, counts)
        size = np.repeat(counts, counts).astype(np.int32)
        weight = np.ones(len(hashes), np.int32)
        # combine shingles that many texts of this batch share
        order = np.lexsort((owner, hashes))
        starts, lengths = _runs(hashes[order])
        hot = lengths >= HOT
        keep = np.ones(len(hashes), dtype=bool)
        if hot.any():
            first = np.repeat(starts, lengths)
            in_hot = np.repeat(hot, lengths)
            at = order[in_hot]
            place = np.concatenate([[0], np.cumsum(lengths[hot])])[:-1]
            yield _stars(owner[at], size[at], np.repeat(place, lengths[hot]), per_mille, fragments)
            others = order[in_hot & (np.arange(len(order)) != first)]
            keep[others] = False
            weight[order[starts[hot]]] = HOT
            yield _shared_blocks(owner[others], hashes[others], np.full(len(others), HOT, np.uint8), fragments)
        hashes, owner, size, weight = hashes[keep], owner[keep], size[keep], weight[keep]
        fragment = ((hashes >> np.uint64(48)) * np.uint64(fragments) >> np.uint64(16)).astype(np.uint16)
        order = np.argsort(fragment, kind="stable")
        hashes, owner, size, weight, fragment = hashes[order], owner[order], size[order], weight[order], fragment[order]
        starts, lengths = _runs(fragment)
        a, b, c, d = [], [], [], []
        low = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6])
        for s, n in zip(starts, lengths):
            at, count = _runs(owner[s: s + n])
            a.append(owner[s: s + n][at].tobytes())
            b.append(np.stack([count.astype(np.int32), size[s: s + n][at]]).tobytes())
            c.append(low[s: s + n].tobytes())
            heavy = np.flatnonzero(weight[s: s + n] > 1).astype(np.int32)
            d.append(heavy.tobytes())
        yield _table(len(starts), kind=0, key=fragment[starts].astype(np.int32), a=a, b=b, c=c, d=d)


def fragment_rows(batches: Iterator[pa.RecordBatch], fragments: int, per_mille: int) -> Iterator[pa.RecordBatch]:
    """Fragments to partial overlaps and shared shingles; other rows pass."""
    blocks: dict[int, list[tuple[bytes, bytes, bytes, bytes]]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        rest = np.flatnonzero(kind != 0)
        if len(rest):
            yield batch.take(pa.array(rest))
        own = batch.take(pa.array(np.flatnonzero(kind == 0)))
        for key, *parts in zip(*(own.column(x).to_pylist() for x in ("key", "a", "b", "c", "d"))):
            blocks.setdefault(key, []).append(tuple(parts))
    while blocks:
        key, parts = blocks.popitem()
        row, size, hashes, heavy = [], [], [], []
        for a, b, c, d in parts:
            count, n = np.frombuffer(b, np.int32).reshape(2, -1)
            row.append(np.repeat(np.frombuffer(a, np.int64), count))
            size.append(np.repeat(n, count))
            low = np.zeros((len(row[-1]), 8), np.uint8)
            low[:, :6] = np.frombuffer(c, np.uint8).reshape(-1, 6)
            hashes.append(low.view(np.uint64).ravel())
            heavy.append(np.zeros(len(row[-1]), np.int32))
            heavy[-1][np.frombuffer(d, np.int32)] = HOT - 1
        del parts
        row, size, hashes, heavy = (np.concatenate(x) for x in (row, size, hashes, heavy))
        order = np.lexsort((row, hashes))
        starts, lengths = _runs(hashes[order])
        weight = np.add.reduceat(heavy[order], starts) + lengths
        at = order[np.repeat(lengths > 1, lengths)]
        inside = lengths[lengths > 1]
        yield _stars(row[at], size[at], np.repeat(np.cumsum(inside) - inside, inside), per_mille, fragments)
        at = order[np.repeat(weight > 1, lengths)]
        level = np.minimum(np.repeat(weight, lengths)[np.repeat(weight > 1, lengths)], HOT).astype(np.uint8)
        yield _shared_blocks(row[at], hashes[at], level, fragments)


def proven_links(batches: Iterator[pa.RecordBatch], per_mille: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose summed partial overlaps reach the threshold."""
    found = [[np.frombuffer(x, np.int64) for x in row] for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in "abcd"))]
    if found:
        u, v, sizes, n = (np.concatenate(x) for x in zip(*found))
        u, v, nu, nv, n = _summed(u, v, sizes >> 32, sizes & 0xFFFFFFFF, n)
        good = 1000 * n >= per_mille * (nu + nv - n)
        yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], names=["u", "v"])


SURVIVOR = "row long, n int, rare array<long>, shared binary, keys array<long>"


def surviving_rows(batches: Iterator[pa.RecordBatch], per_mille: int) -> Iterator[pa.RecordBatch]:
    """Texts with enough shared shingles, with the rarest of them that two linked texts cannot both avoid, and all of them.

    Blocks of fragments have the 48 low bits of a hash, combined shingles all 64; here 48 are used of either.
    """
    sizes, row, hashes, level = [], [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        texts = batch.take(pa.array(np.flatnonzero(kind == 3)))
        sizes.append((texts.column("u").to_numpy(), texts.column("nu").to_numpy()))
        blocks = batch.take(pa.array(np.flatnonzero(kind == 1)))
        for a, b, c, d in zip(*(blocks.column(x).to_pylist() for x in "abcd")):
            row.append(np.repeat(np.frombuffer(a, np.int64), np.frombuffer(b, np.int32)))
            hashes.append(np.frombuffer(c, np.uint64))
            level.append(np.frombuffer(d, np.uint8))
    if not row:
        return
    ids, n = (np.concatenate(x) for x in zip(*sizes))
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    row, hashes, level = (np.concatenate(x) for x in (row, hashes, level))
    own = np.searchsorted(ids, row)
    shared = np.bincount(own, minlength=len(ids))
    needed = (per_mille * n.astype(np.int64) + 999) // 1000
    use = (shared >= needed)[own]
    own, hashes, level = own[use], hashes[use] & LOW48, level[use]
    order = np.lexsort((hashes, level, own))
    own, hashes = own[order], hashes[order]
    starts, lengths = _runs(own)
    if not len(starts):
        return
    keys = np.stack([np.minimum.reduceat(W.mix(hashes ^ W.PLACES[i]), starts).view(np.int64) for i in (2, 5)], axis=1)
    for i in range(0, len(starts), 1024):
        some = slice(i, i + 1024)
        who = own[starts[some]]
        first = [hashes[s: s + m - k + 1].view(np.int64) for s, m, k in zip(starts[some], lengths[some], needed[who])]
        every = [np.sort(hashes[s: s + m]).tobytes() for s, m in zip(starts[some], lengths[some])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[who]), pa.array(n[who].astype(np.int32)), pa.array(first, pa.list_(pa.int64())), pa.array(every, pa.binary()), pa.array(list(keys[some]), pa.list_(pa.int64()))],
            names=["row", "n", "rare", "shared", "keys"],
        )


def walked_links(frames: Iterator[pd.DataFrame], per_mille: int) -> Iterator[pd.DataFrame]:
    """Components within groups of texts that are likely near copies, by walking along exactly compared links.

    From a reached text one goes on to all texts not yet reached that link with it, so a text that was reached is not compared
    with others that were.
    """
    for _, group in groups(frames, ["key", "block"]):
        group = group.drop_duplicates("row")
        if len(group) < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in group["shared"]]
        rows, n = group["row"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        s = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), s)
        open_ = np.ones(len(sets), bool)
        u, v = [], []
        for root in range(len(sets)):
            if not open_[root]:
                continue
            reached, open_[root] = [root], False
            while reached and open_.any():
                at = reached.pop()
                # no more can be common than either shares with anybody
                able = open_ & ((1000 + per_mille) * np.minimum(s, s[at]) >= per_mille * (n + n[at]))
                if not able.any():
                    continue
                use = able[owner]
                some, whose = flat[use], owner[use]
                place = np.minimum(np.searchsorted(sets[at], some), len(sets[at]) - 1)
                both = np.bincount(whose[sets[at][place] == some], minlength=len(sets))
                near = np.flatnonzero(able & (1000 * both >= per_mille * (n + n[at] - both)))
                open_[near] = False
                reached += near.tolist()
                u += rows[near].tolist()
                v += [rows[at]] * len(near)
        if u:
            yield pd.DataFrame({"u": u, "v": v})


def overlaps(frames: Iterator[pd.DataFrame], per_mille: int) -> Iterator[pd.DataFrame]:
    """Pairs whose exact overlap reaches the threshold."""
    for f in frames:
        n = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(f["a"], f["b"])]
        f = f.assign(n=np.array(n, dtype=np.int64))
        yield f.loc[1000 * f["n"] >= per_mille * (f["nu"] + f["nv"] - f["n"]), ["u", "v"]]


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, fragments: int | None = None) -> DataFrame:
    """All columns of `docs` with `n_shingles` and `component_id`, the smallest doc_id that the text reaches by links.

    Two texts link when their shingle sets' Jaccard similarity is `similarity` (whole per mille) or more. Null and empty texts
    have no shingles and link with nothing. Repeated rows are texts of their own, equal texts link. A text with a null doc_id
    takes part; its component is the smallest non-null one of its group, or null if it has none. A text of any length is
    taken whole; a task's memory grows with its longest text. An empty table gives no rows. `docs` needs `doc_id` and `text`;
    its other columns are kept, whatever their names, unless they have those of the two new ones, which replace them.
    """
    kept = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    own = set_apart(docs.select(*kept), NEEDED)
    texts = written(_numbered(own), "texts", row_group=ROW_GROUP)
    found = _groups(texts, similarity, width, fragments).select("__row", "n_shingles", "component_id")
    return texts.join(found, "__row").select(*own.columns, "n_shingles", "component_id").toDF(*kept, "n_shingles", "component_id")


def classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, fragments: int | None = None) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` per row of `docs`; see `near_duplicates`."""
    return _groups(_numbered(docs.select(*NEEDED)), similarity, width, fragments).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, fragments: int | None = None) -> DataFrame:
    """The rows of `docs` that stay when of each group of near duplicates one does.

    The one with the smallest doc_id stays, of several rows with it the first, and the first row where all have a null doc_id.
    Rows without shingles all stay. All columns are kept, whatever their names; long texts and empty tables as in `near_duplicates`.
    """
    own = set_apart(docs, NEEDED)
    texts = written(_numbered(own), "texts", row_group=ROW_GROUP)
    found = written(_groups(texts, similarity, width, fragments), "groups")
    usable = found.filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = usable.groupBy("component").agg(F.min_by("__row", order).alias("__first"))
    dropped = usable.join(first, "component").filter("__row <> __first").select("__row")
    # what goes grows with the corpus, so this is a shuffle join at every size
    return texts.join(dropped.hint("merge"), "__row", "left_anti").select(*own.columns).toDF(*docs.columns)


NEEDED = ("doc_id", "text")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.monotonically_increasing_id())


def _groups(texts: DataFrame, similarity: float, width: int, fragments: int | None) -> DataFrame:
    """`__row, doc_id, n_shingles, component_id, component` of `texts (__row, doc_id, text)`, which are read once.

    `component` is the smallest `__row` of the group, so groups differ in it also where ids are null or repeated.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    fragments = fragments or shuffle_width(spark)
    per_mille = round(1000 * similarity)
    source = texts.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    made = source.mapInArrow(lean(lambda x: shingle_rows(x, fragments, width, per_mille)), ROWS)
    # the fragment's number is its partition; other rows only pass
    parts = made.repartition(fragments, "key").mapInArrow(lean(lambda x: fragment_rows(x, fragments, per_mille)), ROWS)
    parts = written(parts, "fragments", row_group=ROW_GROUP)
    ids = parts.filter("kind = 3").select(F.col("u").alias("__row"), "doc_id", F.col("nu").alias("n"), "k0", "k1")

    # links that sums of partial overlaps prove, and equal sets
    sums = parts.filter("kind = 2").select("key", "a", "b", "c", "d").repartition(fragments, "key")
    stars = sums.select("a", "b", "c", "d").mapInArrow(lambda x: proven_links(x, per_mille), "u long, v long")
    first = ids.filter("n > 0").groupBy("k0", "k1", "n").agg(F.min("__row").alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    copies = written(ids.join(first, ["k0", "k1", "n"]).select(F.col("__row").alias("u"), "v").filter("u <> v"), "copies")

    # texts that can link at all, one of each equal set
    blocks = parts.filter("kind in (1, 3)").select(*COLUMNS)
    survivors = blocks.repartition(fragments, "key").mapInArrow(lambda x: surviving_rows(x, per_mille), SURVIVOR)
    survivors = written(survivors, "survivors", row_group=ROW_GROUP)
    one_each = survivors.join(copies.select(F.col("u").alias("row")), "row", "left_anti")

    # links within groups of likely near copies; a large group is cut into blocks that share its first text
    keyed = one_each.select("row", "n", "shared", F.explode("keys").alias("key"))
    crowd = survivors.select("row", F.explode("keys").alias("key")).groupBy("key").agg(F.min("row").alias("first"), F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("blocks")).filter("blocks > 1")
    # written, so that the planner knows its size and broadcasts it only if that is small
    keyed = keyed.join(written(crowd, "crowded"), "key", "left")
    own = F.coalesce(F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"), F.lit(0))
    keyed = keyed.withColumn("block", F.explode(F.when(F.col("row") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    keyed = keyed.select("key", "block", "row", "n", "shared").repartition(fragments, "key", "block").sortWithinPartitions("key", "block")
    walked = keyed.mapInPandas(lambda x: walked_links(x, per_mille), "u long, v long")
    near = written(components(stars.unionByName(copies).unionByName(walked)), "near")

    # Pairs of different components that share one of their rarest shingles. What two texts have in common from there on is
    # at most what either has left, so their first common shingle lies where both have enough left.
    placed = one_each.select("row", "n", "rare", (F.octet_length("shared") / 8).cast("int").alias("s")).join(near.select(F.col("node").alias("row"), "component"), "row", "left")
    rare = placed.select("row", "n", "s", F.coalesce("component", "row").alias("component"), F.posexplode("rare").alias("at", "shingle"))
    rare = rare.select("row", "n", "component", "shingle", (F.col("s") - F.col("at")).alias("left"))
    mixed = rare.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle")
    open_ = written(rare.join(mixed, "shingle"), "open")
    mine, other = (open_.select("shingle", *[F.col(c).alias(n) for c, n in zip(("row", "n", "component", "left"), (x, f"n{x}", f"c{x}", f"l{x}"))]) for x in "uv")
    pairs = mine.join(other, "shingle").filter(
        (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv"))
        & ((1000 + per_mille) * F.least("lu", "lv").cast("long") >= per_mille * (F.col("nu").cast("long") + F.col("nv")))
    )
    pairs = written(pairs.select("u", "v", "nu", "nv").distinct(), "pairs")
    sets = survivors.select("row", "shared")
    both = pairs.join(sets.withColumnsRenamed({"row": "u", "shared": "a"}), "u").join(sets.withColumnsRenamed({"row": "v", "shared": "b"}), "v")
    late = both.mapInPandas(lambda x: overlaps(x, per_mille), "u long, v long")

    links = near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late)
    placed = components(links).select(F.col("node").alias("__row"), "component")
    every = ids.select("__row", "doc_id", F.col("n").cast("long").alias("n_shingles")).join(placed, "__row", "left")
    every = written(every.withColumn("component", F.coalesce("component", "__row")), "placed")
    named = every.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return every.join(named, "component").select("__row", "doc_id", "n_shingles", "component_id", "component")

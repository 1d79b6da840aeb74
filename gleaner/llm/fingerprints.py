"""I-Match fingerprints: hashes of a text's terms of middling document frequency, once per randomised subset of the lexicon.

The lexicon holds the terms whose inverse document frequency lies within a band. Pseudorandom subsets of it are chosen by
hashes of the terms: the first is the whole lexicon, the others keep a half, a quarter, and so on down to 1/128 of it (nine of
each), so that texts of any length have subsets of which they hold a few terms. A text's distinct terms of a subset, sorted, are hashed to one
number; the numbers of all subsets are its fingerprint. Two texts are as alike as the share of their numbers that agree.

A term of the lexicon occurs in at least one of 2**`idf[1]` texts, so there are at most 2**`idf[1]` times as many terms as a text
has on average, however many texts there are. All of it is native expressions: no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.storage import written

#: Subsets of the lexicon: all of it, and chains in which every subset is a random half of the one before.
CHAINS, DEPTH = 9, 7
SUBSETS = 1 + CHAINS * DEPTH
#: Terms of the lexicon up to which it is broadcast; beyond it, it is joined by shuffle.
BROADCAST_TERMS = 500_000
BETWEEN_TERMS = r"[^\p{L}\p{N}]+"
KEY = ["id0", "h"]


# ---------------------------------------------------------------- terms and the lexicon

def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case; an empty string may be among them."""
    return F.array_distinct(F.split(F.lower(text), BETWEEN_TERMS))


def in_half(term: Column, chain: int, depth: int) -> Column:
    """Whether a hash of a term belongs to the half that a chain goes on with: a bit of its own for every chain and depth."""
    return term.bitwiseAND(F.lit(1 << (chain * DEPTH + depth)).cast("long")) != 0


def lexicon(docs: DataFrame, idf: tuple[float, float]) -> DataFrame:
    """`(t)`: hashes of the terms whose inverse document frequency, in bits, lies within `idf`."""
    n = docs.count()
    each = docs.select(F.explode(terms(F.col("text"))).alias("term")).filter("term <> ''").select(F.xxhash64("term").alias("t"))
    counts = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    least, most = n / 2.0 ** idf[1], n / 2.0 ** idf[0]
    return counts.filter(F.col("df").between(least, most)).select("t")


# ---------------------------------------------------------------- fingerprints

def _number(some: Column, subset: int) -> Column:
    """0 for no terms, else 1 to 65535."""
    return F.when(F.size(some) > 0, (F.pmod(F.xxhash64(some, F.lit(subset)), F.lit(65535)) + 1).cast("int")).otherwise(F.lit(0))


def _half(some: str, chain: int, depth: int) -> Column:
    return F.filter(some, lambda x: in_half(x, chain, depth))


def with_numbers(df: DataFrame, found: dict[str, str]) -> DataFrame:
    """Adds one array of `SUBSETS` numbers (the value in `found`) for each column of sorted hashes of terms (the key).

    A chain's next subset is taken from the one before, step by step, so the work per chain is twice the terms, not `DEPTH` times.
    """
    kept = list(df.columns)
    parts = {c: [F.array(_number(F.col(c), 0))] for c in found}
    names = {(c, chain): f"__{c}_{chain}" for c in found for chain in range(CHAINS)}
    df = df.withColumns({names[c, chain]: F.col(c) for c, chain in names})
    for depth in range(DEPTH):
        df = df.withColumns({name: _half(name, chain, depth) for (_, chain), name in names.items()})
        df = df.withColumns({f"__{c}_at{depth}": F.array(*[_number(F.col(names[c, k]), 1 + depth * CHAINS + k) for k in range(CHAINS)]) for c in found})
        for c in found:
            parts[c].append(F.col(f"__{c}_at{depth}"))
    return df.select(*kept, *[F.concat(*parts[c]).alias(name) for c, name in found.items()])


def as_text(fingerprint: Column) -> Column:
    """Four hexadecimal digits per number."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 4, F.lit("0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal numbers among those of which not both are 0; 1 where all are 0 in both."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise(x == y))
    counted = F.size(F.filter(pairs, lambda p: p.isNotNull()))
    same = F.size(F.filter(pairs, lambda p: F.coalesce(p, F.lit(False))))
    return F.when(counted == 0, F.lit(1.0)).otherwise(same / counted)


def keyed(docs: DataFrame) -> DataFrame:
    """`doc_id, text` (null: empty) and the two numbers that name a text of an id; rows equal in both share them."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return known.select("doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id0"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Per different row of `keyed`: how often it occurs, its length, the row after it (`next`) and the one before it (`prior`).

    Ids ascend, null first, several texts of an id by a hash of theirs; after the last comes the first. Rows are dealt by
    range; only the first and the last row of each range are put in order in one task.
    """
    each = rows.groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), *KEY, (F.col("n_chars") / 2).cast("long").alias("half"))
    ranged = written(each, "rows").withColumn("place", place).repartitionByRange("place").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    ends = ranged.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    along = Window.orderBy("part")  # one row per range
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(along), F.last("last").over(whole)).alias("ahead"),
    )
    inside = Window.partitionBy("part").orderBy("place")
    lined = ranged.select("*", F.lead("place").over(inside).alias("later"), F.lag("place").over(inside).alias("earlier")).join(ends, "part")
    return lined.select("doc_id", *KEY, "copies", "n_chars", F.coalesce("later", "after").alias("next"), F.coalesce("earlier", "ahead").alias("prior"))


def edited(rows: DataFrame) -> DataFrame:
    """Different rows of `keyed` with `neighbours` and `edited`: the last half of the text replaced by as much of the next one's beginning."""
    known = rows.select(*KEY, "text").join(neighbours(rows).hint("merge"), KEY)
    # the join has sorted the rows by their key, so that equal ones lie together
    single = known.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("text", "doc_id", "copies", "n_chars", "next", "prior")])
    heads = single.select(F.col("prior.id0").alias("id0"), F.col("prior.h").alias("h"), F.substring("text", F.lit(1), F.col("prior.half").cast("int")).alias("head"))
    both = single.join(heads.hint("merge"), KEY)
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    return both.select(*KEY, "doc_id", "copies", "n_chars", "next", "text", F.concat(F.substring("text", F.lit(1), kept), "head").alias("edited"))


def fingerprinted(rows: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """Rows of `edited` with `fingerprint` and `edited_fingerprint` as arrays of numbers, and the edited text's SHA-256.

    Terms leave the row and come back to it by its key, by which the rows are dealt already, so nothing is shuffled.
    """
    about = ("doc_id", "copies", "n_chars", "next", "edited_sha256", "t0", "t1")
    whole = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "t0": F.xxhash64("text"), "t1": F.xxhash64("edited")})
    sides = F.array(F.struct(F.lit(0).alias("side"), terms(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("side"), terms(F.col("edited")).alias("terms")))
    # one empty term of the first side stands for the row itself and takes its columns along
    sides = F.concat(sides, F.array(F.struct(F.lit(-1).alias("side"), F.array(F.lit("")).alias("terms"))))
    sided = whole.select(*KEY, *about, F.explode(sides).alias("s"))
    carried = [F.when(F.col("s.side") < 0, F.col(c)).alias(c) for c in about]
    each = sided.select(*KEY, *carried, F.col("s.side").alias("side"), F.explode("s.terms").alias("term")).filter("side < 0 or term <> ''")
    each = each.withColumn("t", F.when(F.col("side") >= 0, F.xxhash64("term"))).drop("term")
    words = words.withColumn("listed", F.lit(True))
    joined = each.join(F.broadcast(words) if small else words, "t", "left").filter("side < 0 or listed")
    found = joined.groupBy(*KEY).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in about],
        *[F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("t")))).alias(f"found{i}") for i in (0, 1)],
    )
    for i, empty in ((0, F.col("n_chars") == 0), (1, F.col("edited_sha256") == F.sha2(F.lit(""), 256))):
        # a text without any term of the lexicon is told by its own hash, an empty one by nothing
        alone = F.when(empty, F.array().cast("array<long>")).otherwise(F.array(f"t{i}"))
        found = found.withColumn(f"found{i}", F.when(F.size(f"found{i}") > 0, F.col(f"found{i}")).otherwise(alone))
    found = with_numbers(found, {"found0": "fingerprint", "found1": "edited_fingerprint"})
    return found.select(*KEY, "doc_id", "copies", "n_chars", "next", "edited_sha256", "fingerprint", "edited_fingerprint")


def fingerprints(docs: DataFrame, idf: tuple[float, float] = (1.0, 10.0)) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` per row of `docs` (`doc_id`, `text`; others are ignored).

    The lexicon holds terms (lower-case runs of letters and digits) of which one in at least 2**`idf[0]` and at most
    2**`idf[1]` texts has one. A fingerprint has four hexadecimal digits per subset of it. Equal texts have equal
    fingerprints. A text without any of these terms is told by a hash of the whole of it; an empty one has zeros throughout.

    The edited text has the last half of the text (rounded down) replaced by as many code points from the beginning of the
    next text, or all that it has: the next one by doc_id, after the last the first. `near_edited` and `near_next` say how
    alike the text's fingerprint is to that of the edited text and of the next one, from 0 to 1; two texts of zeros are
    alike. A null text is empty. Null ids come first; several texts of one id follow each other by a hash of the text, and
    rows equal in id and text are one document with as many equal rows in the result. Texts of any length are taken whole. An
    empty table gives no rows.
    """
    rows = keyed(docs)
    words = written(lexicon(rows, idf), "lexicon")
    found = written(fingerprinted(edited(rows), words, words.count() <= BROADCAST_TERMS), "fingerprints")
    after = found.select(F.col("id0").alias("next_id0"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    both = found.withColumns({"next_id0": F.col("next.id0"), "next_h": F.col("next.h")}).join(after, ["next_id0", "next_h"])
    out = both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "copies",
    )
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies", "copy")

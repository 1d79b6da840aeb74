"""I-Match fingerprints against a plain computation."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import fingerprints as P, queries


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def string_hash(t):
    return signed(xxhash.xxh64(t.encode(), seed=42).intdigest())


def member(t, j):
    depth, chain = divmod(j - 1, P.CHAINS)
    return j == 0 or all(t >> (chain * P.DEPTH + d) & 1 for d in range(depth + 1))


def split_terms(text):
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


@pytest.fixture(scope="module")
def subsets(spark):
    """Sorted hashes to a subset's number, by Spark's own hash function."""

    def hashes(lists):
        table = spark.createDataFrame([(i, j, x) for (i, j), x in lists.items()], "i int, j int, x array<long>")
        return {(r.i, r.j): r.n for r in table.select("i", "j", (F.pmod(F.xxhash64("x", "j"), F.lit(65535)) + 1).alias("n")).collect()}

    return hashes


def expected(rows, subsets, low=1.0, high=10.0):
    """Rows as (id, text), each pair once, in the operator's order."""
    hashes = subsets
    df = Counter(t for _, text in rows for t in split_terms(text))
    words = {t for t, n in df.items() if len(rows) / 2**high <= n <= len(rows) / 2**low}
    edits = []
    for i, (_, text) in enumerate(rows):
        k = len(text) // 2
        edits.append(text[: len(text) - k] + rows[(i + 1) % len(rows)][1][:k])
    texts = [t for _, t in rows] + edits
    found = [sorted(string_hash(t) for t in split_terms(x) & words) or ([string_hash(x)] if x else []) for x in texts]
    lists = {}
    for i, f in enumerate(found):
        for j in range(P.SUBSETS):
            own = [t for t in f if member(t, j)]
            if own:
                lists[i, j] = own
    numbers = hashes(lists)
    prints = [[numbers.get((i, j), 0) for j in range(P.SUBSETS)] for i in range(len(texts))]

    def like(a, b):
        counted = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in counted) / len(counted) if counted else 1.0

    hexed = lambda p: "".join(f"{x:04x}" for x in p)
    n = len(rows)
    return [
        (doc, len(text), hashlib.sha256(edits[i].encode()).hexdigest(), hexed(prints[i]), hexed(prints[n + i]), like(prints[i], prints[n + i]), like(prints[i], prints[(i + 1) % n]))
        for i, (doc, text) in enumerate(rows)
    ]


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=key)


def test_against_plain_computation(spark, sf_dir, subsets):
    rows = sorted((r.doc_id, r.text or "") for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    found = as_rows(queries.op13_fingerprints(spark, sf_dir))
    assert found == sorted(expected(rows, subsets), key=key)
    by_text = {}
    for (_, text), row in zip(rows, found):
        assert by_text.setdefault(text, row[3]) == row[3]
    assert sum(r[5] for r in found) > 2 * sum(r[6] for r in found)


def test_awkward_rows(spark, docs, subsets):
    """Null ids, several texts of an id, empty texts; repeated rows are one document that is listed twice."""
    order = [(r.doc_id, r.text) for r in P.keyed(docs).distinct().orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text", F.col("doc_id").isNull())).collect()]
    all_rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    found = P.fingerprints(docs, idf=(0.0, 20.0))
    want = {(d, t): row for (d, t), row in zip(order, expected(order, subsets, 0.0, 20.0))}
    assert as_rows(found) == sorted((want[r] for r in all_rows), key=key)
    empty = [r for r in as_rows(found) if r[1] == 0]
    assert len(empty) == 3 and all(r[3] == "0" * 4 * P.SUBSETS for r in empty)


def test_lexicon_by_shuffle_is_the_same(spark, sf_dir, monkeypatch):
    table = queries.table(spark, sf_dir, "documents").limit(60).withColumn("t", F.lit(1)).withColumn("next", F.lit("x"))
    one = as_rows(P.fingerprints(table))
    monkeypatch.setattr(P, "BROADCAST_TERMS", 0)
    assert as_rows(P.fingerprints(table)) == one


def test_few_rows(spark, nothing):
    assert P.fingerprints(nothing).count() == 0
    one = as_rows(P.fingerprints(spark.createDataFrame([(4, "one text of its own")], "doc_id long, text string")))
    assert one[0][2] == hashlib.sha256(b"one text oone text ").hexdigest() and one[0][6] == 1.0


def test_the_band(spark):
    table = spark.createDataFrame([(i, f"all {'half ' if i % 2 else ''}{'rare' if i == 3 else ''}") for i in range(64)], "doc_id long, text string")
    words = lambda *idf: {r.t for r in P.lexicon(P.keyed(table), idf).collect()}
    assert words(0, 10) == {string_hash(w) for w in ("all", "half", "rare")} and words(1, 5) == {string_hash("half")}
    for chain, depth in ((0, 0), (4, 3), (8, 6)):
        share = spark.range(4000).select(F.avg(P.in_half(F.xxhash64("id"), chain, depth).cast("int"))).first()[0]
        assert abs(share - 0.5) < 0.05

"""Alignment of two tokenizers against a plain comparison of all token pairs."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import alignment, queries
from gleaner.llm.tokens import BYTES

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """Text -> (tokens of A, tokens of B) as (id, begin, end), or None where the bytes are not given back."""
    a, b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    back = {v: k for k, v in BYTES.items()}

    def tokens(ids, parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip(ids, [0, *ends[:-1]], ends))

    def split(text):
        if not text:
            return None
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        parts_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = (" " + text).encode()
        return (tokens(ids_a, parts_a), tokens(ids_b, parts_b)) if b"".join(parts_a) == want == b"".join(parts_b) else None

    return split


def expected(rows, brute):
    found = [brute(t) for _, t in rows]
    links = []
    for f in found:
        mine = []
        j = 0
        for i, x, y in (f[0] if f else []):
            while f[1][j][2] <= x:
                j += 1
            k = j
            while k < len(f[1]) and f[1][k][1] < y:
                mine.append((i, f[1][k][0]))
                k += 1
        links.append(mine)
    counts = Counter(p for m in links for p in m)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc, _), f, mine in zip(rows, found, links):
        if not f:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({t[2] for t in f[0]} & {t[2] for t in f[1]})
        groups = [([], []) for _ in ends]
        for side in (0, 1):
            for i, begin, _ in f[side]:
                groups[bisect.bisect_right(ends, begin)][side].append(str(i))
        text = ";".join("|".join(",".join(side) for side in g) for g in groups)
        out.append((doc, len(f[0]), len(f[1]), len(ends), len(mine), sum(counts[p] == best[p[1]] for p in mine), sum(counts[p] for p in mine), text))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=key)


ODD = [
    (20, "a  b\n c\td <s> <|endoftext|> <0x41> ▁ x"), (21, "tags <s> <unk> <|endoftext|> <0x41> in the text"), (22, "two\nlines\n\nmore\nwords"), (23, "naïve façade ﬁne ½   Ω"),
    (24, " leading and trailing "), (25, "日本語の文章 zwölf 🙂🙂 emoji"), (26, "\n"), (27, "."), (28, "it's 12345 ... don't!?"), (29, "▁"), (30, "plain words again and again, plain words"),
]


def test_alignment_against_all_pairs(spark, docs, brute):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = [tuple(r) for r in table.collect()]
    assert as_rows(alignment.align(table, FIRST, SECOND)) == sorted(expected([r for r in rows if r[1] != ""] + [r for r in rows if r[1] == ""], brute), key=key)
    marked = {r.doc_id: r.n_a for r in alignment.align(table, FIRST, SECOND).filter("doc_id in (21, 29)").collect()}
    assert marked[21] > 0 and marked[29] == 0


def test_alignment_on_the_documents(spark, sf_dir, brute, monkeypatch):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected(rows, brute)]
    found = queries.op11_alignment(spark, sf_dir).withColumnRenamed("groups_sha256", "groups")
    assert as_rows(found) == sorted(want, key=key)


def test_chunks_do_not_change_counts(spark, sf_dir):
    table = queries.table(spark, sf_dir, "documents")
    one = as_rows(alignment.align(table.coalesce(1), FIRST, SECOND))
    assert one == as_rows(alignment.align(table.repartition(7), FIRST, SECOND))
    assert one == as_rows(alignment.align(table.withColumn("batch", F.lit(1)).withColumn("pair", F.lit("x")), FIRST, SECOND))


def test_nothing(nothing):
    assert alignment.align(nothing, FIRST, SECOND).count() == 0


def test_gallop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 3000):
        ends = np.unique(rng.integers(0, 10_000, n))
        wanted = np.append(np.sort(rng.integers(0, ends[-1] + 1, 200)), ends[-1])
        zero = np.zeros(len(wanted), np.int64)
        for guess in (zero, zero + len(ends) - 1, rng.integers(-5, len(ends) + 5, len(wanted))):
            assert (alignment.gallop(wanted, ends, zero, zero + len(ends), guess) == np.searchsorted(ends, wanted)).all()

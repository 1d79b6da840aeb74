"""Operators on vectors and pages, components, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from gleaner.llm import ball_search, graph, multi_index, warc

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = rng.standard_normal(16)
        rows.append([i, v, i % 3])
    for i in range(400, 700):  # near copies of a few vectors, a common one among them
        at = 0 if i % 2 else int(rng.integers(0, 20))
        rows.append([i, rows[at][1] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12, 0.2]), rows[at][2]])
    table = [(i, [float(np.float32(x)) for x in v], lab, 0.5) for i, v, lab in rows]
    nan, null = list(table[0][1]), list(table[0][1])
    nan[3], null[3] = float("nan"), None
    odd = [(700, None, 0, 0.5), (750, nan, 0, 0.5), (800, null, 0, 0.5), (850, [0.0] * 16, 0, 0.5), (900, table[0][1], None, 0.5), (None, table[0][1], 0, 0.5), (950, [1.0, 2.0], 0, 0.5), (7, table[7][1], 1, 0.5)]
    return spark.createDataFrame(table + odd, SCHEMA)


def usable(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)


def test_multi_index_against_brute_force(vectors):
    rows = vectors.collect()
    got = multi_index.near_duplicates(vectors).toPandas()
    good = [r for r in rows if usable(r.embedding) and any(r.embedding) and r.label is not None]
    unit = np.array([r.embedding for r in good], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([r.label for r in good])
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    want = links.sum()
    assert got["n_links"].sum() <= want and got["n_links"].sum() >= 0.97 * want and want > 1000
    assert len(got) == len(rows) and (got[got["vec_id"].isin([700, 750, 800, 850, 900, 950])]["n_links"] == 0).all()
    assert (got["kept"] == (got["vec_id"] == got["component_id"]).fillna(False)).all()
    single = got[got["n_links"] == 0]
    assert (single["vec_id"].fillna(-1) == single["component_id"].fillna(-1)).all()


def test_multi_index_recall_over_many_cells(spark):
    """Vectors without groups of their own, each third one with a neighbour just above the threshold: the hardest case for cells."""
    rng = np.random.default_rng(11)
    first = rng.standard_normal((15_000, 64))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    noise = rng.standard_normal((5_000, 64))
    noise -= (noise * first[:5_000]).sum(axis=1, keepdims=True) * first[:5_000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.choice([0.932, 0.94, 0.96], 5_000)[:, None]
    unit = np.concatenate([first, cosine * first[:5_000] + np.sqrt(1 - cosine**2) * noise])
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(unit)), "embedding": unit.tolist(), "label": 0}), "vec_id long, embedding array<double>, label int")
    assert len(multi_index.fit(unit, len(unit), 0.93, 0.99).first) ** 2 > 100
    want = sum(int((unit[i: i + 2_000] @ unit.T >= 0.93).sum()) for i in range(0, len(unit), 2_000)) - len(unit)
    got = multi_index.near_duplicates(table).agg({"n_links": "sum"}).first()[0]
    print(f"links {got} of {want}")
    assert want >= 10_000 and 0.98 * want <= got <= want


def test_scores_are_exact_whatever_the_size_of_a_query(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2000, 2000, 8)], 0, 0.5) for i in range(1, 50)]
    rows += [(0, [float(x) for x in rng.integers(2**43, 2**44, 8)], 0, 0.5), (50, [float(2**50 + i) for i in range(8)], 0, 0.5)]
    table = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    whole = {i: [int(x) for x in v] for i, v, *_ in rows}
    scores = sorted((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in whole.items() if i not in (0, 50))
    want = {(0, n, i, -x) for n, (x, i) in enumerate(scores[:5], 1)}
    got = ball_search.top_k(table.filter("vec_id != 50"), scale=1).select("query_id", "rank", "vec_id", "score")
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(Exception, match="64 bits"):
        ball_search.top_k(table, scale=1).collect()
    with pytest.raises(Exception, match="64 bits"):
        ball_search.top_k(table.selectExpr("vec_id", "array(1e300D) as embedding"), scale=256).collect()


def test_vector_operators_on_nothing(spark, vectors):
    empty = vectors.limit(0)
    assert multi_index.near_duplicates(empty).count() == 0 and ball_search.top_k(empty).count() == 0
    useless = spark.createDataFrame([(50, None, 1, 0.0), (100, [], 1, 0.0)], SCHEMA)
    assert ball_search.top_k(useless).count() == 0
    assert [(r.n_links, r.kept) for r in multi_index.near_duplicates(useless).collect()] == [(0, True)] * 2


@pytest.mark.parametrize("shard_rows", [16, 8192])
def test_top_k_is_exact(vectors, shard_rows, monkeypatch):
    monkeypatch.setattr(ball_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ball_search, "LEAF_ROWS", 8)
    good = [(r.vec_id, np.floor(256 * np.array(r.embedding, np.float64)).astype(np.int64)) for r in vectors.collect() if r.vec_id is not None and usable(r.embedding)]
    want = Counter()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in ball_search.top_k(vectors, every=50).collect())
    assert got == want


def test_every_length_is_searched_on_its_own(spark, vectors):
    """Longer rows, useful or not, take nothing from the shorter ones; each vector meets all vectors of its length."""
    rng = np.random.default_rng(6)
    longer = [[float(np.float32(x)) for x in rng.standard_normal(24)] for _ in range(40)]
    rows = [(1000 + i, longer[i % 30], i % 30 % 2, 0.5) for i in range(40)]
    rows += [(1050, [float("nan")] * 128, 0, 0.5), (1100, [None] * 200, 0, 0.5), (None, [1.0] * 300, 0, 0.5), (1150, [1.0] * 250, None, 0.5), (1200, [], 0, 0.5), (1250, [2.0], 1, 0.5), (1251, [0.5], 1, 0.5)]
    mixed = vectors.union(spark.createDataFrame(rows, SCHEMA))
    good = [(r.vec_id, np.floor(256 * np.array(r.embedding, np.float64)).astype(np.int64)) for r in mixed.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = Counter()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in ball_search.top_k(mixed, every=50).collect())
    assert got == want and {q for q, *_ in want} > {0, 50, 1000, 1250}

    columns = ["vec_id", "n_links", "component_id", "kept"]
    alone = multi_index.near_duplicates(vectors).select(*columns).collect()
    linked = multi_index.near_duplicates(mixed).select(*columns).collect()
    old = sum(r.n_links for r in alone)
    of = lambda found, least, most: [r for r in found if r.vec_id is not None and least <= r.vec_id < most]
    assert old > 1000 and sum(r.n_links for r in of(linked, 0, 1000)) >= 0.98 * sum(r.n_links for r in of(alone, 0, 1000))
    assert {(r.vec_id, r.n_links, r.component_id) for r in of(linked, 1000, 1040)} == {(1000 + i, int(i < 10 or i >= 30), 1000 + i % 30) for i in range(40)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in of(linked, 1050, 1252)} == {i: (0, i) for i in (1050, 1100, 1150, 1200)} | {1250: (1, 1250), 1251: (1, 1250)}


def test_fewer_candidates_than_k(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0), (3, [0.5, 0.5], 1, 0.0), (2, [0.5, 0.9], 1, 0.0)], SCHEMA)
    assert [tuple(r) for r in ball_search.top_k(few).orderBy("rank").collect()] == [(0, 1, 2, 32768), (0, 2, 3, 32768)]


def test_pages_come_back_from_the_archive(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nEvil: 1", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é" * 50_000), (None, "http://e/", "<p>x</p>"), (7, "u", "one"), (7, "u", "one")]
    pages = spark.createDataFrame([(*r, i, "y") for i, r in enumerate(rows)], "page_id long, url string, html string, row long, payload string")
    read = warc.read(spark, warc.write(pages))
    got = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), digest(h)) for p, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([
        (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2), (7, "response", None), (7, "revisit", 7),
    ])
    for r in warc.record_bytes(read).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and "Evil" not in fields and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
    some = warc.read(spark, warc.write(pages, least_bytes=5)).collect()
    assert Counter((r.page_id, r.record_type) for r in some if r.payload_bytes < 5) == Counter({(3, "response"): 1, (4, "response"): 1, (7, "response"): 2})
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (5, 5)]
    low = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(len(low)):
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == low
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, sf_dir), name)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert pieces.filter("length(ids) <> 4 * length").count() == 0 and pieces.count() > 0

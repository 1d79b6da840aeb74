"""Hard negatives against brute force, and bounds against scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import hard_negatives as H, queries

SCHEMA = "vec_id long, embedding array<double>, label int, q int, dim string"


def brute(rows, every=100, positives=5, negatives=10):
    own = []
    for r in rows:
        v = r.embedding
        if r.vec_id is None or r.label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((r.vec_id, r.label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for a, lab, v in own:
        if a % every:
            continue
        partners = [(-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, other, w in own if i != a and len(w) == len(v)]
        partners.sort()
        for p, pid, _ in [x for x in partners if x[2]][:positives]:
            fit = [(s, i) for s, i, same in partners if not same and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        v = rng.standard_normal(24) + (2 if i % 3 else 0)
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    rows += [(i, rows[i % 5][1], i % 3) for i in range(900, 1300)]  # very common vectors
    rows += [(i, rng.integers(-1, 2, 24).astype(float).tolist(), i % 2) for i in range(1300, 1500)]  # many ties
    nan, null = [1.0] * 24, [1.0] * 24
    nan[3], null[5] = float("nan"), None
    rows += [(1500, None, 0), (1600, nan, 0), (1700, null, 1), (1800, [1.0] * 24, None), (None, [1.0] * 24, 1), (1900, [], 0), (2000, [0.0] * 24, 1)]
    rows += [(2100, [1.0, 2.0], 0), (2200, [2.0, 1.0], 0), (2201, [1.0, 1.0], 1), (2300, [3.0], 5), (200, rows[200][1], 2), (7, rows[7][1], 0)]
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard,block", [(8192, 2048), (100, 4)])
def test_against_brute_force(vectors, monkeypatch, shard, block):
    monkeypatch.setattr(H, "SHARD_ROWS", shard)
    monkeypatch.setattr(H, "ANCHOR_ROWS", block)
    want = brute(vectors.collect())
    assert len(want) > 400 and found(H.mine(vectors)) == want


def test_large_numbers_are_exact_or_an_error(spark):
    rng = np.random.default_rng(1)
    big = [(i, (rng.integers(1, 1 << 20, 8).astype(float) * (1 << 2 if i % 2 else 1)).tolist(), i % 2, 0, "") for i in range(300)]
    table = spark.createDataFrame(big, SCHEMA)
    assert found(H.mine(table)) == brute(table.collect())
    with pytest.raises(Exception, match="does not fit"):
        H.mine(spark.createDataFrame([(0, [1e300], 0, 0, ""), (1, [1.0], 0, 0, "")], SCHEMA)).collect()
    with pytest.raises(Exception, match="does not fit"):
        H.mine(spark.createDataFrame([(0, [1e15], 0, 0, ""), (1, [1e15], 0, 0, "")], SCHEMA)).collect()


def test_few_rows(spark, vectors):
    assert found(H.mine(vectors.limit(0))) == []
    one = spark.createDataFrame([(0, [1.0, 0.5], 0, 0, "")], SCHEMA)
    assert found(H.mine(one)) == []
    three = spark.createDataFrame([(0, [1.0, 0.5], 0, 0, ""), (1, [1.0, 0.5], 0, 0, ""), (2, [0.5, 0.5], 1, 0, "")], SCHEMA)
    assert found(H.mine(three)) == brute(three.collect())


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-300, 300, (40, 70)).astype(float), rng.integers(-300, 300, (50, 70)).astype(float)
    scores, before = x @ y.T, None
    for (mx, dx), (my, dy) in zip(H.split_summary(H.summary(x), 70), H.split_summary(H.summary(y), 70)):
        middle, reach = mx @ my.T, dx @ dy.T
        assert (np.abs(scores - middle) <= reach + 1e-6).all()
        assert before is None or (reach <= before + 1e-6).all() or reach.mean() < before.mean()
        before = reach


def test_labels_change_where_the_query_says_so(spark, sf_dir):
    table = queries.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute(table.withColumn("label", label).collect())
    assert found(queries.op12_hard_negatives(spark, sf_dir)) == want

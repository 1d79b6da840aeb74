"""Small frames for the points where engines and languages differ."""

from __future__ import annotations

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.functions import tokens as TK
from gleaner.functions.stopwords import STOPWORDS
from gleaner.operators import describe, prepare
from gleaner.operators import profile as P


def one(spark, value, type_, expr):
    return spark.createDataFrame([(value,)], f"v {type_}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text,want", [
    ("TRUE", True), (" yes\t", True), ("t", True), ("1", True), ("0", False), ("No", False), ("f", False),
    ("1.0", None), ("maybe", None), ("", None), (None, None),
])
def test_booleans(spark, text, want):
    assert one(spark, text, "string", X.normal_boolean) is want


@pytest.mark.parametrize("text,want", [("12", 12), (" 12 ", 12), ("12.0", 12), ("-3", -3), ("12.5", None), ("x", None), (None, None),
    ("9.0e15", 9 * 10**15), ("1e16", 10**16), ("12345678901234567.0", 12345678901234567), ("12345678901234567.5", None),
    ("12345678901234567", 12345678901234567), ("1e400", None), ("NaN", None), ("0.00000000001", None)])
def test_numbers(spark, text, want):
    assert one(spark, text, "string", X.lenient_long) == want


@pytest.mark.parametrize("text,want", [
    ("  a  ", "a"), ("a\r\nb\rc", "a\nb\nc"), ("nan", None), ("None", None), (" ", None), ("none", "none"),
])
def test_strings(spark, text, want):
    assert one(spark, text, "string", X.normal_string) == want


@pytest.mark.parametrize("text,want", [
    ("  a \t b\r\n\r\n\r\n\r\nc  ", "a b\n\nc"), ("\n\n", None), ("a\n\nb", "a\n\nb"), (None, None),
])
def test_clean_text(spark, text, want):
    assert one(spark, text, "string", X.clean_text) == want


@pytest.mark.parametrize("text,want", [("", 0), (" \t", 0), ("a", 1), ("\x1ca\x1d\x1eb\u3000", 2), (" a\u200bb  c\x85", 2), ("\U0001f600 \xa0!", 2), (None, None)])
def test_word_count(spark, text, want):
    assert one(spark, text, "string", X.word_count) == want


@pytest.mark.parametrize("day,want", [
    ("2023-11-07", "2023-11-07/2023-11-13"), ("2023-11-13", "2023-11-07/2023-11-13"), ("2023-11-14", "2023-11-14/2023-11-20"),
])
def test_weeks_run_from_tuesday(spark, day, want):
    assert one(spark, day, "string", lambda c: X.week_label(c.cast("timestamp"))) == want


@pytest.mark.parametrize("text,want", [("Brazilian Portuguese", "brazilian_portuguese"), ("  --", "unknown"), ("a__b", "a_b")])
def test_slug(spark, text, want):
    assert one(spark, text, "string", X.slug) == want


@pytest.mark.parametrize("value,want", [(29, "<30m"), (30, "30m-1h59m"), (-5, "<30m"), (6000, "100h+"), (None, None)])
def test_bands(spark, value, want):
    row = prepare.add_bands(spark.createDataFrame([(value,)], "playtime_at_review bigint")).first()
    assert row.playtime_at_review_band == want


TEXTS = [
    "abc'--def x's 'abc' 12-- 12-a -12 1_2 ²³ a² 123 don't--stop rock'n'roll- _x_ 2nd ٣٤ 7-7",
    "你好 world игра naïve côte ① x", "--'' a-b-c--", "", "42",
]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_follow_word_boundaries(spark, text):
    df = spark.createDataFrame([(text, "english")], "review string, language string")
    want = [t for t in re.findall(r"\b[\w'-]+\b", text.lower()) if not t.isdigit()]
    assert df.select(TK.tokens("review", None, 1).alias("t")).first().t == want


def test_stopwords_by_language_of_the_row(spark):
    df = spark.createDataFrame([("the game el juego", "english"), ("the game el juego", "spanish"), ("the game", "klingon")],
                               "review string, language string")
    got = [r.t for r in df.select(TK.tokens("review", STOPWORDS).alias("t")).collect()]
    assert got == [["el", "juego"], ["the", "game"], ["the", "game"]]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "tokens array<string>")
    assert [r.g for r in df.select(TK.ngrams("tokens", 2).alias("g")).collect()] == [["a b", "b c"], [], []]


def test_lengths(spark):
    df = prepare.add_lengths(spark.createDataFrame([("a b \n c\x1cd",), (None,)], "review string"))
    rows = df.collect()
    assert [rows[0][c] for c in describe.TEXT_VARIABLES] == [9, 4, 4, 2]
    assert [rows[1][c] for c in describe.TEXT_VARIABLES] == [0, 0, 0, None]


def test_flags_are_three_valued(spark):
    raw = prepare.ensure_columns(spark.createDataFrame(
        [("1", None, None, 5, 9), ("2", False, 3, 9, 5), ("3", True, 0, 5, None)],
        "recommendationid string, voted_up boolean, comment_count bigint, playtime_at_review bigint, playtime_forever bigint",
    ))
    rows = {r.recommendationid: r for r in prepare.derive(raw).collect()}
    assert [rows[i].is_negative for i in "123"] == [None, True, False]
    assert [rows[i].has_comments for i in "123"] == [False, True, False]
    assert [rows[i].playtime_post_review for i in "123"] == [4, None, None]
    assert [rows[i].played_after_review for i in "123"] == [True, False, None]


# ---------------------------------------------------------------- profiles against plain Python

def skewed(n=4000):
    """One key holds a third of the rows, one value another third of it."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 11}")
        value = rng.choice([0.0, 0.0, -rng.random() * 50, rng.lognormvariate(3, 3), float(i), None])
        rows.append((key, value))
    return rows


def test_profile_equals_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in P.numeric_profile(df, ["k"], ["v"], [0.1, 0.5, 0.95]).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        r = got[key]
        assert (r.count_non_null, r.count_null) == (len(values), sum(1 for k, v in rows if k == key and v is None))
        assert r.count_zero == sum(v == 0 for v in values)
        for q, p in ((r.q0_1, 10), (r.q0_5, 50), (r.q0_95, 95)):
            assert q == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-12)
        assert r["mean"] == pytest.approx(np.mean(values), rel=1e-12)
        assert r["std"] == pytest.approx(statistics.stdev(values), rel=1e-9)
        assert (r["min"], r["max"]) == (min(values), max(values))


def test_spread_of_large_values_keeps_its_precision(spark):
    values = [1.7e9 + d for d in (0, 1, 2, 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert P.numeric_profile(df, [], ["v"]).first()["std"] == pytest.approx(statistics.stdev(values), rel=1e-12)


def test_profile_of_nothing_but_nulls_and_of_one_value(spark):
    rows = describe.numeric_summary(spark.createDataFrame([(None, 5.0)], "a double, b double"), ["a", "b"]).collect()
    got = {r.variable: r for r in rows}
    assert (got["a"].count_non_null, got["a"].count_null, got["a"]["mean"], got["a"].count_zero) == (0, 1, None, None)
    assert (got["b"]["std"], got["b"]["median"], got["b"].p95) == (None, 5.0, 5.0)


def test_top_shares_equal_a_sort(spark):
    rng = random.Random(3)
    values = [float(rng.choice([0, 1, 1, 2, int(rng.lognormvariate(4, 2))])) for _ in range(1100)]
    df = spark.createDataFrame([(v,) for v in values], "votes_up double")
    got = describe.concentration_summary(df, ["votes_up"]).first()
    ranked, total = sorted(values, reverse=True), sum(values)
    for share, f in ((got.share_top_1_percent, 0.01), (got.share_top_5_percent, 0.05), (got.share_top_10_percent, 0.10)):
        n = max(1, int(np.ceil(len(values) * f)))
        assert share == pytest.approx(sum(ranked[:n]) / total * 100, abs=1e-4)

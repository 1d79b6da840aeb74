"""Large lexicons and theme dictionaries against plain counting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions.lookups import constant_lookup
from gleaner.operators import emotions, themes


def word(rng, most=5):
    return "".join(rng.choice("abé") for _ in range(rng.randint(1, most)))


@pytest.fixture(scope="module")
def reviews():
    rng = random.Random(3)
    return [[word(rng) for _ in range(rng.randint(0, 40))] for _ in range(150)] + [["a"] * 3000, ["a", "b"] * 500, []]


@pytest.fixture(scope="module")
def text(spark, reviews):
    rows = [(i % 100, t, len(t)) for i, t in enumerate(reviews)]
    return spark.createDataFrame(rows, f"n int, tokens array<string>, {themes.TOKENS} bigint").withColumn(emotions.TOKENS, F.col(themes.TOKENS))


def dictionary(size):
    rng = random.Random(8)
    out = {"empty": ["  ", "a  b"]}
    for i in range(size):
        terms = [word(rng), f"{word(rng)} {word(rng)}", f"{word(rng, 2)} {word(rng, 2)} {word(rng, 2)}", "a a", "Ab ", "a a a b"]
        out.setdefault(f"theme{i % 7}", []).extend(terms)
    return out


def expected(tokens, themes_of, mode):
    joined = " ".join(tokens) if mode == "substring" else f" {'  '.join(tokens)} "
    out = []
    for theme, terms in themes_of.items():
        for term in terms:
            sought = term if mode == "substring" else f" {term.replace(' ', '  ')} "
            n = joined.count(sought) if " " in term else tokens.count(term)
            if n and "  " not in term:
                out.append((theme, term, n))
    return sorted(out)


@pytest.mark.parametrize("mode", themes.PHRASE_MODES)
def test_terms_of_a_large_dictionary(text, reviews, mode):
    given = dictionary(300)
    clean = themes.clean_themes(given)
    found = themes.theme_terms_found(text, given, phrase_mode=mode).select("tokens", "theme_hits").collect()
    assert len(found) == len(reviews)
    for r in found:
        assert sorted(tuple(h) for h in r.theme_hits) == expected(r.tokens, clean, mode)
    once = themes.theme_terms_found(text, given, False, mode).select(F.explode("theme_hits.hits").alias("n")).distinct().collect()
    assert [r.n for r in once] == [1]


def test_the_plan_does_not_grow_with_the_dictionary(text):
    def size(terms):
        plan = themes.theme_terms_found(text, {"t": [*terms, "ab cd", "x"]})._jdf.queryExecution().analyzed()
        return len(plan.expressions().toString().split("lambda"))

    assert size([]) == size([f"word{i}" for i in range(10_000)] + [f"word{i} and{i}" for i in range(10_000)])


def test_twenty_thousand_terms(spark):
    terms = [f"w{i}" for i in range(10_000)] + [f"w{i} v{i} u{i}" for i in range(10_000)]
    row = spark.createDataFrame([(["w7", "w9999", "v9999", "u9999", "xw12", "v12", "u12"],)], "tokens array<string>")
    got = themes.theme_terms_found(row, {"t": terms}).first().theme_hits
    assert sorted(h.term for h in got) == ["w12 v12 u12", "w7", "w9999", "w9999 v9999 u9999"]
    got = themes.theme_terms_found(row, {"t": terms}, phrase_mode="token").first().theme_hits
    assert sorted(h.term for h in got) == ["w7", "w9999", "w9999 v9999 u9999"]


def test_unknown_mode(text):
    with pytest.raises(ValueError, match="phrase_mode"):
        themes.theme_terms_found(text, {"t": ["a b"]}, phrase_mode="word")


def test_a_lexicon_of_any_size(spark, text, reviews):
    """In place and by join; the most frequent token is beyond the share that goes by broadcast, others are below it."""
    rng = random.Random(5)
    pairs = sorted({(word(rng), rng.choice([*K.EMOTIONS, "other"])) for _ in range(400)} | {("a", "joy"), ("a", "trust")})
    lexicon = spark.createDataFrame(pairs, "word string, emotion string")
    columns = ["n", "tokens", emotions.MATCHES, *[f"{e}_{x}" for e in K.EMOTIONS for x in ("count", "per_100_tokens")]]
    ways = [emotions.enrich_with_emotions(text, lexicon, limit=limit) for limit in (10_000, 3)]
    assert ways[0].columns == ways[1].columns
    one, other = (sorted(map(repr, df.select(columns).collect())) for df in ways)
    assert one == other and len(one) == len(reviews)
    of = {}
    for w, e in pairs:
        if e in K.EMOTIONS:
            of.setdefault(w, set()).add(e)
    for r in ways[1].collect():
        assert r[emotions.MATCHES] == sum(t in of for t in r.tokens) and r.joy_count == sum("joy" in of.get(t, ()) for t in r.tokens)


def test_a_lexicon_without_tokens(spark, text):
    lexicon = spark.createDataFrame([("a", "joy"), ("b", "joy")], "word string, emotion string")
    empty = text.filter("n < 0")
    assert emotions.enrich_with_emotions(empty, lexicon, limit=0).count() == 0
    assert emotions.enrich_with_emotions(text.filter("size(tokens) = 0"), lexicon, limit=0).first().joy_count == 0


def test_constant_lookup(spark):
    entries = {f"key{i}": i for i in range(500)} | {"": -1, "é": -2, 'q"\\': -3}
    look = constant_lookup(entries, "int")
    keys = spark.createDataFrame([(k,) for k in [*entries, "none", None]], "k string")
    assert {r.k: r.v for r in keys.select("k", look(F.col("k")).alias("v")).collect()} == entries | {"none": None, None: None}

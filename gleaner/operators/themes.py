"""Theme profile of reviews from a dictionary theme -> words and phrases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import exprs as X
from gleaner.functions.lookups import constant_lookup
from gleaner.functions.stopwords import ENGLISH_WITHOUT_DOMAIN_WORDS
from gleaner.operators import categories as C
from gleaner.operators.text import text_subset

TOKENS, MATCHES = "token_count_for_theme_analysis", "theme_match_count_total"
Themes = Mapping[str, Sequence[str]]


def clean_themes(themes: Themes) -> dict[str, list[str]]:
    """Names and terms trimmed and lower-cased, blanks and repeats dropped, themes without terms dropped."""
    out = {}
    for name, terms in themes.items():
        kept = sorted({str(t).strip().lower() for t in terms} - {""})
        if name.strip() and kept:
            out[name.strip().lower()] = kept
    return out


def theme_subset(
    df: DataFrame, target: str = "english", min_length: int = 2, remove_stopwords: bool = True
) -> DataFrame:
    """Reviews of the target language with at least one token; the stop words keep the domain words."""
    return text_subset(df, min_length, ENGLISH_WITHOUT_DOMAIN_WORDS if remove_stopwords else None, target, token_count=TOKENS)


PHRASE_MODES = ("substring", "token")
#: Letters on either side of a phrase's first blank that tell which phrases may begin there.
EDGE = 3


def _edge(phrase: str) -> tuple[str, str]:
    before, after = phrase.split(" ")[:2]
    return before[-EDGE:], after[:EDGE]


def theme_terms_found(text: DataFrame, themes: Themes, count_every_hit: bool = True, phrase_mode: str = "substring") -> DataFrame:
    """Adds `theme_hits`: an array of (theme, term, hits) for the terms that occur in each review.

    Words match whole tokens. Phrases match without overlaps: as substrings of the joined tokens (`phrase_mode="substring"`, so
    they may begin and end within a token), or as whole tokens in a row (`"token"`). The dictionary is an index of constants:
    tokens look up words, and pairs of neighbouring tokens look up the phrases that may begin there; only terms found in this
    way are counted. Everything happens inside the row, and the plan does not grow with the number of terms.
    """
    if phrase_mode not in PHRASE_MODES:
        raise ValueError(f"phrase_mode must be one of {PHRASE_MODES}")
    hit = "struct<theme:string,term:string,hits:bigint>"
    pairs = [(theme, term) for theme, terms in clean_themes(themes).items() for term in terms]
    words = [(t, w) for t, w in pairs if " " not in w]
    # tokens hold no blanks, so a phrase with two blanks in a row occurs nowhere
    phrases = [(t, p) for t, p in pairs if " " in p and "  " not in p]
    terms = words + phrases
    if not terms:
        return text.withColumn("theme_hits", F.array().cast(f"array<{hit}>"))

    starts: dict[str, list[int]] = {}
    for number, (_, term) in enumerate(terms, 1):
        before, after = ("", "") if number <= len(words) else _edge(term) if phrase_mode == "substring" else term.split(" ")[:2]
        starts.setdefault(f"{before} {after}" if before else term, []).append(number)
    index = constant_lookup(starts, "array<int>")
    named = constant_lookup({str(i): list(term) for i, term in enumerate(terms, 1)}, "array<string>")

    keys = F.array_distinct("tokens")
    if phrases:
        t = F.col("tokens")
        # a look at two letters spares most pairs the lookup; there are no more such letters than an alphabet has
        heads = [term.split(" ")[:2] for _, term in phrases]
        ends_in, begins_with = sorted({a[-1] for a, _ in heads}), sorted({b[0] for _, b in heads})
        likely = F.filter(F.sequence(F.lit(2), F.size(t)), lambda i: (
            F.right(F.element_at(t, i - 1), F.lit(1)).isin(ends_in) & F.left(F.element_at(t, i), F.lit(1)).isin(begins_with)
        ))
        neighbours = F.when(F.size(t) > 1, F.transform(likely, lambda i: F.struct(F.element_at(t, i - 1).alias("a"), F.element_at(t, i).alias("b"))))
        if phrase_mode == "token":
            ends = [lambda p: F.concat(p["a"], F.lit(" "), p["b"])]
        else:
            lengths = sorted({tuple(map(len, _edge(p))) for _, p in phrases})
            ends = [lambda p, x=x, y=y: F.concat(F.right(p["a"], F.lit(x)), F.lit(" "), F.left(p["b"], F.lit(y))) for x, y in lengths]
        at = F.flatten(F.transform(neighbours, lambda p: F.array(*[end(p) for end in ends])))
        keys = F.concat(keys, F.coalesce(F.array_distinct(at), F.array().cast("array<string>")))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(keys, index), lambda x: x.isNotNull()))))

    blank = F.lit(" ") if phrase_mode == "substring" else F.lit("  ")
    joined = F.array_join("tokens", " ") if phrase_mode == "substring" else F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" "))

    def hits(number: Column) -> Column:
        term = named(number.cast("string"))
        word = term[1]
        sought = word if phrase_mode == "substring" else F.concat(F.lit(" "), F.replace(word, F.lit(" "), blank), F.lit(" "))
        phrase_hits = (F.length("__joined") - F.length(F.replace(F.col("__joined"), sought, F.lit("")))) / F.length(sought)
        word_hits = F.size(F.filter("tokens", lambda t: t == word))
        n = F.when(number <= len(words), word_hits).otherwise(phrase_hits).cast("bigint")
        return F.struct(term[0].alias("theme"), word.alias("term"), n.alias("hits"))

    base = text.withColumns({"__joined": joined if phrases else F.lit(""), "__numbers": numbers})
    present = F.filter(F.transform("__numbers", hits), lambda h: h["hits"] > 0)
    if not count_every_hit:
        present = F.transform(present, lambda h: h.withField("hits", F.lit(1).cast("bigint")))
    return base.withColumn("theme_hits", present).drop("__joined", "__numbers")


def enrich_with_themes(text: DataFrame, themes: Themes, count_every_hit: bool = True, phrase_mode: str = "substring") -> DataFrame:
    """Per theme: count, presence, matched terms and hits per 100 tokens; in total: matches and themes present."""
    names = list(clean_themes(themes))
    found = theme_terms_found(text, themes, count_every_hit, phrase_mode)

    def of(theme: str):
        return F.filter("theme_hits", lambda h: h["theme"] == theme)

    def total(hits):
        return F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a + h["hits"])

    counted = found.withColumns({
        **{f"{t}_count": total(of(t)) for t in names},
        **{f"{t}_matched_terms": F.array_join(F.array_sort(of(t).getField("term")), "; ") for t in names},
        MATCHES: total(F.col("theme_hits")),
        "themes_present_count": F.size(F.array_distinct(F.col("theme_hits").getField("theme"))).cast("bigint"),
    })
    return counted.withColumns({
        **{f"{t}_present": X.quoted(f"{t}_count") > 0 for t in names},
        **{f"{t}_per_100_tokens": C.rate(t, TOKENS) for t in names},
    })


def theme_overview(
    cleaned: DataFrame, enriched: DataFrame, themes: Themes, target: str = "english", keys: Sequence[str] = ()
) -> DataFrame:
    return C.overview(
        cleaned, enriched, keys, list(clean_themes(themes)), target, TOKENS, MATCHES, "theme", "total_theme_matches"
    )


def theme_distribution(enriched: DataFrame, themes: Themes, keys: Sequence[str] = ()) -> DataFrame:
    return C.distribution(enriched, keys, list(clean_themes(themes)), TOKENS, MATCHES, "theme")


def theme_by_polarity(enriched: DataFrame, themes: Themes, keys: Sequence[str] = ()) -> DataFrame:
    return C.by_polarity(enriched, keys, list(clean_themes(themes)), TOKENS, MATCHES)


def theme_by_band(enriched: DataFrame, themes: Themes, keys: Sequence[str] = ()) -> DataFrame:
    """Rows without a band are left out."""
    banded = enriched.filter(F.col("playtime_at_review_band").isNotNull())
    return C.by_group(banded, [*keys, "playtime_at_review_band"], list(clean_themes(themes)), TOKENS, MATCHES)


def theme_by_month(enriched: DataFrame, themes: Themes, keys: Sequence[str] = ()) -> DataFrame:
    return C.by_group(enriched, [*keys, "review_created_year_month"], list(clean_themes(themes)), TOKENS, MATCHES)


def theme_top_terms(enriched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Terms of each theme by the number of reviews that hold them; the dictionary bounds the rows per theme."""
    hits = enriched.select(*keys, F.explode("theme_hits").alias("hit")).select(*keys, "hit.theme", "hit.term")
    counts = hits.groupBy(*keys, "theme", "term").agg(F.count(F.lit(1)).alias("frequency"))
    group = [*keys, "theme"]
    rank = F.row_number().over(X.ordered_within(group, F.desc("frequency"), F.asc("term"))).cast("bigint")
    total = F.sum("frequency").over(X.over_keys(group))
    relative = X.per_thousand(F.col("frequency"), total).alias("relative_frequency_per_1000_theme_hits")
    return counts.select(*group, rank.alias("rank"), "term", "frequency", relative)

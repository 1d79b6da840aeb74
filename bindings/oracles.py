"""The same results as plain SQL for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

from bindings import fixtures as B
from bindings import lookups as L
from gleaner.functions import constants as K
from gleaner.functions.stopwords import ENGLISH_WITHOUT_DOMAIN_WORDS, STOPWORDS, WORD_CLOUD_STOPWORDS
from gleaner.operators import charts, describe, prepare
from gleaner.sources import schema as S

DAY, WEEK, MONTH, YM = (
    "review_created_date_day", "review_created_date_week", "review_created_date_month", "review_created_year_month",
)
_SPACES = "".join(rf"\x{{{p:x}}}" for p in K.WHITESPACE_POINTS)
WS = f"[{_SPACES}]"
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
DIGITS = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]+"
_CHARS = " || ".join(f"chr({p})" for p in K.WHITESPACE_POINTS)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s + '"'


def strip(e: str) -> str:
    return f"trim({e}, {_CHARS})"


def band(c: str, edges: list, labels: list) -> str:
    whens = " ".join(f"when {c} <= {e} then {q(l)}" for e, l in zip(edges, labels))
    return f"case {whens} when {c} is not null then {q(labels[-1])} end"


def pct(a: str, b: str) -> str:
    return f"round(({a})::double / nullif({b}, 0) * 100, 4)"


def k1000(a: str, b: str) -> str:
    return f"round(({a})::double / nullif({b}, 0) * 1000, 6)"


def ts(seconds: str) -> str:
    return f"make_timestamp(({seconds}) * 1000000)"


def trues(c: str) -> str:
    return f"count(*) filter (where {c})"


# ---------------------------------------------------------------- common tables

R_NUM = f"r_num as ({B.orders_as_reviews('duckdb')})"
R_TXT = f"{R_NUM}, r_txt as ({B.documents_as_reviews('duckdb', reviews='r_num')})"
R_RAW = f"{R_TXT}, r_raw as ({B.raw_text_reviews('duckdb')})"

_BANDS = {
    "playtime_at_review": (K.PLAYTIME_EDGES, K.PLAYTIME_LABELS), "num_reviews": (K.REVIEWER_EDGES, K.REVIEWER_LABELS),
    "num_games_owned": (K.LIBRARY_EDGES, K.LIBRARY_LABELS), "review_length_words": (K.WORDS_EDGES, K.WORDS_LABELS),
}
_TIMES = {
    "timestamp_created": "review_created", "timestamp_updated": "review_updated", "last_played": "last_played",
    "timestamp_dev_responded": "developer_responded",
}


def week(t: str) -> str:
    start = f"(cast({t} as date) - cast((isodow({t}) + 5) % 7 as integer))"
    return f"strftime({start}, '%Y-%m-%d') || '/' || strftime({start} + 6, '%Y-%m-%d')"


def derived(source: str) -> str:
    """All derived columns over a typed table that has `review` and `weighted_vote_score`."""
    text = "coalesce(review, '')"
    first = f"""
  voted_up as is_positive, not voted_up as is_negative, review is not null as has_text_review,
  developer_response is not null as has_developer_response, coalesce(comment_count, 0) > 0 as has_comments,
  coalesce(votes_up, 0) > 0 as has_helpful_votes, coalesce(votes_funny, 0) > 0 as has_funny_votes,
  steam_purchase as is_steam_purchase, received_for_free as is_free_copy,
  written_during_early_access as is_early_access_review, primarily_steam_deck as is_primarily_steam_deck,
  case when playtime_forever >= playtime_at_review then playtime_forever - playtime_at_review end as playtime_post_review,
  playtime_forever > playtime_at_review as played_after_review,
  timestamp_updated > timestamp_created as review_updated_after_creation,
  deck_playtime_at_review > 0 as used_steam_deck_at_review, playtime_last_two_weeks > 0 as recent_playtime_recorded,
  round((timestamp_updated - timestamp_created)::double / 86400, 3) as days_between_creation_and_update,
  round((last_played - timestamp_created)::double / 86400, 3) as days_between_review_and_last_played,
  round((timestamp_dev_responded - timestamp_created)::double / 86400, 3) as days_to_developer_response,
  length({text})::bigint as review_length_chars,
  length(regexp_replace({text}, '{WS}+', '', 'g'))::bigint as review_length_chars_no_spaces,
  len(regexp_extract_all({text}, '[^{_SPACES}]+'))::bigint as review_length_words,
  (length(review) - length(replace(review, chr(10), '')) + 1)::bigint as review_length_lines,
  {', '.join(f"strftime({ts(c)}, '%Y-%m-%d') as {n}_date" for c, n in _TIMES.items())},
  year({ts('timestamp_created')})::bigint as review_created_year,
  month({ts('timestamp_created')})::bigint as review_created_month,
  strftime({ts('timestamp_created')}, '%Y-%m') as {YM},
  strftime({ts('timestamp_created')}, '%Y-%m-%d') as {DAY}, {week(ts('timestamp_created'))} as {WEEK},
  strftime({ts('timestamp_created')}, '%Y-%m') as {MONTH},
  strftime({ts('timestamp_updated')}, '%Y-%m') as review_updated_date_month,
  strftime({ts('timestamp_dev_responded')}, '%Y-%m') as developer_responded_date_month"""
    bands = ", ".join(f"{band(c, *b)} as {c}_band" for c, b in _BANDS.items())
    return f"select *, {bands} from (select *, {first} from {source})"


NUM = f"with {R_NUM}, c as ({derived('(select *, null::varchar as review, null::varchar as weighted_vote_score from r_num)')})"
TXT = f"with {R_TXT}, c as ({derived('(select *, null::varchar as weighted_vote_score from r_txt)')})"


def lists(stops) -> str:
    if not stops:
        return "false"
    if isinstance(stops, dict):
        whens = " ".join(f"when {q(l)} then list_contains([{', '.join(map(q, w))}], t)" for l, w in stops.items())
        return f"case language {whens} else false end"
    return f"list_contains([{', '.join(map(q, stops))}], t)"


def tokens(stops, source: str = "c", where: str = "true", least: int = 2) -> str:
    """Usable texts with tokens and token count; the stop test is resolved per row."""
    found = f"list_filter(regexp_extract_all(lower(review), '{TOKEN}'), lambda t: length(t) >= {least} and not regexp_full_match(t, '{DIGITS}') and not ({lists(stops)}))"
    return f"""(select * from (select *, len(tokens)::bigint as token_count from (
      select * replace (coalesce(language, 'unknown') as language), {found} as tokens
      from {source} where review is not null and {strip('review')} <> '' and {where})) where token_count > 0)"""


ENGLISH = "coalesce(language, 'unknown') = 'english'"
TEXT = f"{TXT}, t as {tokens(L.STOPS)}"
EMO_T = f"{TXT}, t as {tokens(STOPWORDS['english'], where=ENGLISH)}"
THEME_T = f"{TXT}, t as {tokens(ENGLISH_WITHOUT_DOMAIN_WORDS, where=ENGLISH)}"
CLOUD_T = f"{TXT}, t as {tokens(WORD_CLOUD_STOPWORDS, where=ENGLISH)}"
LEX = f"lex(word, emotion) as (values {', '.join(f'({q(w)}, {q(e)})' for w, e in L.LEXICON_PAIRS)})"


def grams(n: int, extra: str = "") -> str:
    if n == 1:
        return f"select {extra} unnest(tokens) as term, is_positive, is_negative from t"
    piece = " || ' ' || ".join(f"tokens[i + {j}]" for j in range(n))
    return (f"select {extra} {piece} as term, is_positive, is_negative "
            f"from (select *, unnest(range(1, len(tokens) - {n} + 2)) as i from t where len(tokens) >= {n})")


# ---------------------------------------------------------------- generators

def stats_rows(columns: list[str], source: str = "c") -> str:
    marks = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}
    parts = []
    for c in columns:
        v = f"{c}::double"
        parts.append(f"""select {q(c)} as variable, count({c}) as count_non_null, count(*) - count({c}) as count_null,
          case when count({c}) > 0 then count(*) filter (where {c} = 0) end as count_zero,
          round(avg({v}), 4) as mean, round(median({v}), 4) as median, round(stddev_samp({v}), 4) as std, round(min({v}), 4) as min,
          {', '.join(f"round(quantile_cont({v}, {p}), 4) as {n}" for n, p in marks.items())},
          round(max({v}), 4) as max, round(sum({v}), 4) as sum from {source}""")
    return " union all ".join(parts)


def stats_by(columns: list[str]) -> str:
    out = []
    for c in columns:
        v = f"{c}::double"
        out.append(f"""count({c}) as {c}_count_non_null, round(avg({v}), 4) as {c}_mean, round(median({v}), 4) as {c}_median,
          round(stddev_samp({v}), 4) as {c}_std, round(min({v}), 4) as {c}_min, round(quantile_cont({v}, 0.25), 4) as {c}_p25,
          round(quantile_cont({v}, 0.75), 4) as {c}_p75, round(quantile_cont({v}, 0.9), 4) as {c}_p90, round(max({v}), 4) as {c}_max""")
    return ", ".join(out)


def rates_by(flags: list[str]) -> str:
    return ", ".join(
        f"count(*) as {f}_review_count, {trues(f)} as {f}_true_count, {pct(trues(f), 'count(*)')} as {f}_percentage"
        for f in flags
    )
def others(column, labels):
    return f"count(*) filter (where {column} not in ({', '.join(q(x) for x in labels)})) as other"


def others(column: str, labels: list[str]) -> str:
    return f"count(*) filter (where {column} not in ({', '.join(q(x) for x in labels)})) as other"


def bands_by(column: str, labels: list[str], prefix: bool = True) -> str:
    p = f"{column}_" if prefix else ""
    cells = [f"count(*) filter (where {column} = {q(l)}) as {ident(p + l)}" for l in labels]
    return ", ".join([*cells, f"count(*) filter (where {column} is null) as {ident(p + 'unknown')}"])


def monthly(select: str) -> str:
    return f"{NUM} select {MONTH}, {select} from c where {MONTH} is not null group by {MONTH}"


POLARITY = f"""count(recommendationid) as review_count, {trues('is_positive')} as positive_reviews, {trues('is_negative')} as negative_reviews,
  {pct(trues('is_positive'), 'count(recommendationid)')} as positive_percentage, {pct(trues('is_negative'), 'count(recommendationid)')} as negative_percentage"""


def running(period: str, unit: str, more: str = "", outer: str = "") -> str:
    return f"""{NUM} select *, sum(review_count) over (order by {period} rows unbounded preceding)::bigint as cumulative_reviews,
      review_count - lag(review_count) over (order by {period}) as review_count_change_vs_previous_{unit},
      round(positive_percentage - lag(positive_percentage) over (order by {period}), 4) as positive_percentage_change_vs_previous_{unit}{outer}
      from (select {period}, {POLARITY}{more} from c group by {period})"""


def metric_rows(source: str, metrics: dict[str, str], keys: str = "") -> str:
    return " union all ".join(
        f"select {keys} {q(m)} as metric, cast({e} as varchar) as value from {source}" for m, e in metrics.items()
    )


def xtab(row: str, base: str = NUM) -> str:
    cells = {"False": "not is_positive", "True": "is_positive", "unknown": "is_positive is null"}
    counts = ", ".join(f"{trues(e)} as {ident(n)}" for n, e in cells.items())
    shares = ", ".join(
        f"{pct(ident(n), 'sum(n) over ()')} as {ident(n + '_percentage_of_total')}" for n in cells
    )
    return f"""{base} select * exclude (n), {shares} from (
      select coalesce({row}, 'unknown') as {row}, count(*) as n, {counts} from c group by coalesce({row}, 'unknown'))"""


def ranked(base: str, n: int, gram: int, label: str, where: str = "true") -> str:
    return f"""{base}, g as (select term, count(*) as frequency from ({grams(gram)}) where {where} group by term)
      select row_number() over (order by frequency desc, term) as rank, term as {label}, frequency,
        {k1000('frequency', '(select sum(frequency) from g)')} as relative_frequency_per_1000_{label}s
      from g order by rank limit {n}"""


def ranked_by_language(base: str, n: int, gram: int = 1, label: str = "token", where: str = "true") -> str:
    return f"""{base}, g as (select language, term, count(*) as frequency from ({grams(gram, 'language,')}) where {where} group by language, term)
      select * from (select language, row_number() over (partition by language order by frequency desc, term) as rank, term as {label},
        frequency, {k1000('frequency', 'sum(frequency) over (partition by language)')} as relative_frequency_per_1000_{label}s from g)
      where rank <= {n}"""


def distinctive(base: str, a: str, b: str, n: int, by: str = "") -> str:
    cond = {"positive": "is_positive", "negative": "is_negative"}
    part = f"partition by {by}" if by else ""
    key = f"{by}," if by else ""
    return f"""{base}, g as (select {key} term, {trues(cond[a])} as fa, {trues(cond[b])} as fb from ({grams(1, key)}) group by {key} term),
      r as (select *, coalesce(fa::double / nullif(sum(fa) over ({part}), 0), 0) as ra, coalesce(fb::double / nullif(sum(fb) over ({part}), 0), 0) as rb
        from g where fa > 0 or fb > 0),
      d as (select {key} term as token, fa as {a}_frequency, fb as {b}_frequency, round(ra * 1000, 6) as {a}_relative_per_1000,
        round(rb * 1000, 6) as {b}_relative_per_1000, round((ra - rb) * 1000, 6) as difference_per_1000,
        round(log2((ra + 1e-12) / (rb + 1e-12)), 6) as log_ratio from r)
      select * exclude (place) from (select *, row_number() over ({part} order by difference_per_1000 desc, {a}_frequency desc, token) as place from d)
      where place <= {n}"""


SEG = "(select unnest(['overall', 'positive', 'negative']) as segment)"
IN_SEG = "(s.segment = 'overall' or (s.segment = 'positive' and t.is_positive) or (s.segment = 'negative' and t.is_negative))"


LENGTHS = ", ".join(
    f"round({f}(review_length_{u}), 4) as {n}_review_length_{u}" for u in ("words", "chars") for n, f in (("mean", "avg"), ("median", "median"))
)
WORD_LENGTHS = LENGTHS[: LENGTHS.index(", round(avg(review_length_chars)")]


def text_metrics(*group: str, share: bool = False, base: str = TEXT) -> str:
    part = f", {pct('count(*)', '(select count(*) from t)')} as review_percentage" if share else ""
    by, same = ", ".join(group), " and ".join(f"u.{g} is not distinct from a.{g}" for g in group)
    return f"""{base}, u as (select {by}, count(distinct term) as unique_tokens from (select {by}, unnest(tokens) as term from t) group by {by})
      select a.*, u.unique_tokens, round(u.unique_tokens::double / a.total_tokens, 6) as type_token_ratio from (
        select {by}, count(*) as review_count{part}, sum(token_count)::bigint as total_tokens, {WORD_LENGTHS}
        from t group by {by}) a join u on {same}"""


def polarity_by_language(base: str, segment: str, where: str) -> str:
    """One segment of every language; a language without rows of the segment keeps its row."""
    return f"""{base} select l.language, '{segment}' as segment, coalesce(a.n, 0) as review_count, coalesce(a.k, 0) as total_tokens, coalesce(u.n, 0) as unique_tokens,
      round(coalesce(u.n, 0)::double / nullif(coalesce(a.k, 0), 0), 6) as type_token_ratio, a.* exclude (language, n, k)
      from (select distinct language from t) l
      left join (select language, count(*) as n, sum(token_count)::bigint as k, {LENGTHS} from t where {where} group by language) a on a.language = l.language
      left join (select language, count(distinct term) as n from ({grams(1, 'language,')}) where {where} group by language) u on u.language = l.language"""


def enriched_emotions() -> str:
    hits = ", ".join(f"list_sum(list_transform(tokens, lambda t: case when list_contains([{', '.join(q(w) for w, es in L.LEXICON.items() if e in es)}]::varchar[], t) then 1 else 0 end))::bigint as {e}_count" for e in K.EMOTIONS)
    rates = ", ".join(f"round({e}_count::double / token_count * 100, 6) as {e}_per_100_tokens" for e in K.EMOTIONS)
    matched = f"list_sum(list_transform(tokens, lambda t: case when list_contains([{', '.join(map(q, L.LEXICON))}], t) then 1 else 0 end))::bigint"
    return f"{EMO_T}, e as (select *, {rates} from (select *, {matched} as emotion_token_count, {hits} from t))"


def hits_in_theme(theme: str, every: bool = True, whole_tokens: bool = False) -> str:
    parts = []
    for term in L.THEMES[theme]:
        if " " in term and whole_tokens:
            sought = f" {term.replace(' ', '  ')} "
            n = f"((length(spaced) - length(replace(spaced, {q(sought)}, ''))) // {len(sought)})"
        elif " " in term:
            n = f"((length(joined) - length(replace(joined, {q(term)}, ''))) // {len(term)})"
        else:
            n = f"len(list_filter(tokens, lambda t: t = {q(term)}))"
        parts.append(n if every else f"least({n}, 1)")
    return "(" + " + ".join(parts) + ")::bigint"


def term_found(term: str) -> str:
    return f"contains(joined, {q(term)})" if " " in term else f"list_contains(tokens, {q(term)})"


def enriched_themes() -> str:
    counts = ", ".join(f"{hits_in_theme(t)} as {t}_count" for t in L.THEMES)
    terms = ", ".join(
        f"""list_aggregate(list_filter([{', '.join(f"case when {term_found(w)} then {q(w)} end" for w in sorted(ws))}], lambda x: x is not null), 'string_agg', '; ') as {t}_matched"""
        for t, ws in L.THEMES.items()
    )
    more = ", ".join(
        f"{t}_count > 0 as {t}_present, round({t}_count::double / token_count * 100, 6) as {t}_per_100_tokens, coalesce({t}_matched, '') as {t}_matched_terms"
        for t in L.THEMES
    )
    total = " + ".join(f"{t}_count" for t in L.THEMES)
    present = " + ".join(f"(case when {t}_count > 0 then 1 else 0 end)" for t in L.THEMES)
    return f"""{THEME_T}, e as (select *, {more}, ({total})::bigint as theme_match_count_total, ({present})::bigint as themes_present_count
      from (select *, {counts}, {terms} from (select *, array_to_string(tokens, ' ') as joined from t)))"""


def mean_rate(c: str) -> str:
    total = f"sum(round({c}_per_100_tokens * 1000000)::bigint)"
    return f"((2 * {total} + count(*)) // (2 * nullif(count(*), 0)))::double / 1000000"


def profile(categories: list[str], matches: str) -> str:
    parts = ", ".join(
        f"round(avg({c}_count), 6) as {c}_mean_count, {mean_rate(c)} as {c}_mean_per_100_tokens, {pct(f'count(*) filter (where {c}_count > 0)', 'count(*)')} as {c}_review_share"
        for c in categories
    )
    return f"count(*) as review_count, coalesce(sum(token_count), 0)::bigint as total_tokens, coalesce(sum({matches}), 0)::bigint as {matches}, {parts}"


def by_group(base: str, group: str, categories: list[str], matches: str) -> str:
    where = f"where {group} is not null" if group.endswith("band") else ""
    return f"{base} select {group}, {profile(categories, matches)} from e {where} group by {group}"


def by_segment(base: str, categories: list[str], matches: str) -> str:
    cond = {"overall": "true", "positive": "is_positive", "negative": "is_negative"}
    return base + " " + " union all ".join(
        f"select '{s}' as segment, {profile(categories, matches)} from e where {w}" for s, w in cond.items()
    )


def distribution(base: str, categories: list[str], name: str) -> str:
    return base + " " + " union all ".join(
        f"""select {q(c)} as {name}, sum({c}_count)::bigint as total_hits, {k1000(f'sum({c}_count)', 'sum(token_count)')} as hits_per_1000_tokens,
          count(*) filter (where {c}_count > 0) as reviews_with_{name}, {pct(f'count(*) filter (where {c}_count > 0)', 'count(*)')} as review_share_with_{name},
          round(avg({c}_count), 6) as mean_count_per_review, {mean_rate(c)} as mean_per_100_tokens from e"""
        for c in categories
    )


def overview(base: str, categories: list[str], matches: str, name: str, metric: str) -> str:
    return base + " " + metric_rows("(select 1)", {
        "target_language": "'english'",
        "rows_in_cleaned_dataset": "(select count(*) from c)",
        "rows_in_target_language": f"(select count(*) from c where {ENGLISH})",
        "reviews_with_usable_text": "(select count(*) from e)",
        f"reviews_with_any_{name}_match": f"(select count(*) from e where {matches} > 0)",
        "total_tokens_analysed": "(select coalesce(sum(token_count), 0)::bigint from e)",
        metric: f"(select coalesce(sum({matches}), 0)::bigint from e)",
        **{f"reviews_with_{c}_signal": f"(select count(*) from e where {c}_count > 0)" for c in categories},
    })


THEMES = list(L.THEMES)
EMO, THE = "emotion_token_count", "theme_match_count_total"


# ---------------------------------------------------------------- raw and normalised tables

def norm_string(c: str) -> str:
    t = strip(f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')")
    return f"(case when {t} not in ('', 'nan', 'None') then {t} end)"


def norm_number(c: str) -> str:
    return f"try_cast({c} as bigint)"


def norm_bool(c: str) -> str:
    t = f"lower({strip(c)})"
    return f"(case when {t} in ('true', '1', 'yes', 't') then true when {t} in ('false', '0', 'no', 'f') then false end)"


def norm_text(c: str) -> str:
    t = norm_string(c)
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    return f"nullif({strip(f'''regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')''')}, '')"


def norm_language(c: str) -> str:
    t = f"lower({strip(norm_string(c))})"
    return f"(case when {t} not in ('', 'nan') then {t} end)"


def normalised(source: str) -> str:
    cols = []
    for c in S.RAW_COLUMNS:
        if c == "language":
            cols.append(f"{norm_language(c)} as language")
        elif c == "review":
            cols.append(f"{norm_text(c)} as review")
        elif c in S.LONG_COLUMNS:
            cols.append(f"{norm_number(c)} as {c}")
        elif c in S.BOOLEAN_COLUMNS:
            cols.append(f"{norm_bool(c)} as {c}")
        else:
            cols.append(f"{norm_string(c)} as {c}")
    return f"select seq, app_id, {', '.join(cols)} from {source}"


RAW = f"with {R_RAW}"
FIRST_RAW = "(select * from (select *, row_number() over (partition by recommendationid order by seq) as place from r_raw where recommendationid is not null) where place = 1)"
PREPARED_COLUMNS = [c for c in S.CLEANED_COLUMNS if c not in ("game_slug", "game_title") and not c.endswith("datetime_utc")]


def checks(base: str, check_id: str, severity: str, passed: str, good: str, bad: str, details: dict[str, str]) -> str:
    js = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in details.items())
    return f"""{base} select {q(check_id)} as check_id, {passed} as passed, {q(severity)} as severity,
      case when {passed} then {q(good)} else {bad} end as message, '{{' || {js} || '}}' as details"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # A. sources and ingest
    ids = f"{strip('recommendationid')}"
    o["flatten_reviews"] = f"with {R_TXT} select cast(recommendationid as bigint) // 100 as page, {', '.join('null::varchar as weighted_vote_score' if c == 'weighted_vote_score' else c for c in S.RAW_COLUMNS)} from r_txt"
    o["lenient_casts"] = f"{RAW} select seq, {', '.join(f'{norm_number(c)} as {c}' for c in S.LONG_COLUMNS)}, {', '.join(f'{norm_bool(c)} as {c}' for c in S.BOOLEAN_COLUMNS)} from r_raw"
    o["ingest_dedup"] = f"{RAW} select min(seq) as seq, {ids} as recommendationid from r_raw where {ids} <> '' group by 2"
    o["combine_chunks"] = o["ingest_dedup"]
    o["combine_counts"] = f"{RAW} select count(distinct {ids}) as rows_written, count(*) - count(distinct {ids}) as duplicate_rows_skipped from r_raw"
    chunked = "select ((row_number() over (order by cast(recommendationid as bigint)) - 1) // 1000 + 1) as chunk_number from r_num"
    o["chunk_index"] = f"""with {R_NUM}, n as (select chunk_number, count(*) as record_count from ({chunked}) group by 1)
      select chunk_number, format('orders_reviews_part_{{:04d}}.json', chunk_number) as json_file, format('orders_reviews_part_{{:04d}}.csv', chunk_number) as csv_file,
      record_count, sum(record_count) over (order by chunk_number)::bigint as cumulative_records from n"""
    o["chunk_files"] = f"with {R_NUM} select ((row_number() over (order by cast(recommendationid as bigint)) - 1) // 1000 + 1) as chunk_number, recommendationid, steamid, cast(playtime_forever as varchar) as playtime_forever from r_num"
    o["incremental_anti_join"] = f"with {R_NUM} select recommendationid, steamid, timestamp_created from r_num where voted_up is null"
    o["ingest_summary"] = f"""with {R_TXT} select count(distinct cast(recommendationid as bigint) // 100) as pages_downloaded, max(cast(recommendationid as bigint)) + 1 as expected_total_reviews,
      count(distinct recommendationid) as final_total_unique_reviews, count(*) as records_received, cast(ceil(count(distinct recommendationid) / 1000.0) as bigint) as chunks_exported,
      count(distinct recommendationid) - max(cast(recommendationid as bigint)) - 1 as difference_vs_expected from r_txt"""
    o["csv_round_trip"] = f"with {R_TXT} select recommendationid, language, {norm_text('review')} as review, timestamp_created, voted_up, playtime_forever from r_txt"
    o["json_records"] = f"""{NUM} select json_object('recommendationid', recommendationid, 'language', language, 'voted_up', voted_up, 'votes_up', votes_up,
      'days_to_developer_response', days_to_developer_response)::varchar as value from c"""
    iso = {ts: f"strftime(make_timestamp({unix} * 1000000), '%Y-%m-%dT%H:%M:%SZ') as {ts}" for unix, (ts, _) in prepare.TIMES.items()}
    whole = [iso.get(c, c) for c in S.CLEANED_COLUMNS if c not in ("game_slug", "game_title")]
    o["json_whole_rows"] = f"{NUM} select {', '.join(whole)} from c"
    o["preparation_metadata"] = f"""{NUM} select count(*) as rows_exported, {len(S.CLEANED_COLUMNS) - 2}::bigint as columns_exported, {trues('is_positive')} as positive_reviews,
      {trues('is_negative')} as negative_reviews, {trues('has_developer_response')} as reviews_with_developer_response, count(distinct language) as languages_detected from c"""
    page = "cast(recommendationid as bigint) // 100 as page"
    reason = "case when page % 7 = 0 then 'not a JSON page' when page % 11 = 0 then 'no list of reviews' when page % 13 = 0 then 'empty' when page % 5 = 0 then 'not successful' end"
    good = " ".join(["page % 7 <> 0", "and page % 11 <> 0", "and page % 13 <> 0", "and page % 5 <> 0"])
    o["good_page_reviews"] = f"select * from ({o['flatten_reviews']}) where {good}"
    o["rejected_pages"] = f"with {R_TXT}, p as (select distinct {page} from r_txt) select page, {reason} as reason from p where not ({good})"
    o["combined_in_one_job"] = f"select * from ({o['combine_chunks']}), ({o['combine_counts']})"
    o["metadata_in_one_job"] = o["preparation_metadata"]
    configured = """s as (select app_id, case when app_id < 2 then 30 + app_id * 40 else 100 end::bigint as min_reviews_per_language,
      case when app_id < 2 then 30 else 1 end::double as min_share_per_language, case when app_id < 2 then 10 + app_id * 5 else 7 end::bigint as top_n_unigrams,
      100::bigint as top_n_bigrams, 50::bigint as top_n_trigrams, case when app_id < 2 then app_id + 2 else 2 end::bigint as min_token_length, app_id <> 1 as remove_stopwords,
      case when app_id = 1 then 'german' else 'english' end as target_language, 100::bigint as top_n_emotion_terms, true as count_multiple_hits_per_theme
      from (select distinct app_id from r_num))"""
    o["settings_load"] = f"with {R_NUM}, {configured} select * from s"
    own = " union all ".join(f"select * from {tokens(stops, where=f'app_id = {app}', least=least)}" for app, stops, least in ((0, L.STOPS, 2), (1, None, 3), (2, L.STOPS, 2)))
    by_product = f"{TXT}, {configured.replace('r_num', 'c')}, t as ({own})"
    o["settings_top_unigrams"] = f"""{by_product}, g as (select app_id, term, count(*) as frequency from ({grams(1, 'app_id,')}) group by app_id, term)
      select r.* from (select app_id, row_number() over (partition by app_id order by frequency desc, term) as rank, term as token,
        frequency, {k1000('frequency', 'sum(frequency) over (partition by app_id)')} as relative_frequency_per_1000_tokens from g) r join s using (app_id) where rank <= top_n_unigrams"""
    o["settings_languages"] = f"""{by_product}, l as (select app_id, language, count(*) as reviews, sum(token_count)::bigint as tokens, {pct('count(*)', 'sum(count(*)) over (partition by app_id)')} as share from t group by 1, 2)
      select l.app_id, l.language, reviews, tokens from l join s using (app_id) where reviews >= min_reviews_per_language or share >= min_share_per_language"""
    o["settings_target_language"] = f"{by_product} select recommendationid, app_id, token_count from t join s using (app_id) where language = target_language"
    emotions = "[" + ", ".join(map(q, [*K.EMOTIONS, "other"])) + "]"
    o["lexicon_load"] = f"select distinct 'w' || (o_custkey % 500) as word, {emotions}[o_orderkey % 11 + 1] as emotion from orders where o_orderkey % 11 < 10 and o_orderkey % 2 = 1 and o_orderkey % 13 <> 0"
    o["theme_dictionary_load"] = """select distinct 'theme ' || (o_custkey % 9) as theme, term, contains(term, ' ') as is_phrase from (
      select o_custkey, unnest(['term' || (o_custkey % 50), 'long term ' || (o_orderkey % 20)]) as term from orders)"""

    # B. normalisation
    o["ensure_columns"] = f"with {R_NUM} select recommendationid, null::varchar as review, null::varchar as weighted_vote_score, votes_up from r_num"
    o["normalise_strings"] = f"{RAW} select seq, {', '.join(f'{norm_string(c)} as {c}' for c in S.STRING_COLUMNS)} from r_raw"
    o["normalise_numbers"] = f"{RAW} select seq, {', '.join(f'{norm_number(c)} as {c}' for c in S.LONG_COLUMNS)} from r_raw"
    o["normalise_booleans"] = f"{RAW} select seq, {', '.join(f'{norm_bool(c)} as {c}' for c in S.BOOLEAN_COLUMNS)} from r_raw"
    o["normalise_language"] = f"{RAW} select seq, {norm_language('language')} as language from r_raw"
    o["clean_text"] = f"{RAW} select seq, {norm_text('review')} as review from r_raw"
    o["unix_to_ts"] = f"{NUM} select recommendationid, " + ", ".join(f"strftime({ts(c)}, '%Y-%m-%d %H:%M:%S') as {n}_datetime_utc" for c, n in _TIMES.items()) + " from c"
    o["dedup_keep_first"] = f"{RAW} select seq, recommendationid from {FIRST_RAW}"
    prepared = f"with {R_RAW}, n as ({normalised(FIRST_RAW)}), c as ({derived('n')})"
    o["prepare_product"] = f"{prepared} select recommendationid, 440::bigint as app_id, 'a_game' as game_slug, 'A Game' as game_title from c"
    o["lost_values"] = RAW + " " + " union all ".join(
        f"select {q(c)} as column, count(*) filter (where {norm_string(c)} is not null) as filled, count(*) filter (where {norm_string(c)} is not null and {cast(c)} is null) as lost from r_raw"
        for cs, cast in ((S.LONG_COLUMNS, norm_number), (S.BOOLEAN_COLUMNS, norm_bool)) for c in cs).replace(" as column,", ' as "column",')
    o["prepare_reviews"] = f"{prepared} select seq, {', '.join(PREPARED_COLUMNS)} from c"

    # C. derived columns
    def cols(base, *names):
        return f"{base} select recommendationid, {', '.join(names)} from c"
    o["datetime_columns"] = cols(NUM, *[f"{n}_date" for n in _TIMES.values()], "review_created_year", "review_created_month", YM)
    o["text_lengths"] = cols(TXT, *describe.TEXT_VARIABLES)
    o["status_flags"] = cols(TXT, "is_positive", "is_negative", "has_text_review", "has_developer_response", "has_comments", "has_helpful_votes",
                             "has_funny_votes", "is_steam_purchase", "is_free_copy", "is_early_access_review", "is_primarily_steam_deck")
    o["playtime_flags"] = cols(NUM, "playtime_post_review", "played_after_review", "review_updated_after_creation", "used_steam_deck_at_review", "recent_playtime_recorded")
    o["day_intervals"] = cols(NUM, *describe.INTERVAL_VARIABLES)
    o["band_columns"] = cols(TXT, *[f"{c}_band" for c in _BANDS])
    o["period_keys"] = cols(NUM, DAY, WEEK, MONTH, "review_updated_date_month", "developer_responded_date_month")

    # D. descriptive tables
    o["dataset_overview"] = f"{NUM}, a as (select app_id, count(*) as n, count(distinct recommendationid) as i, count(distinct steamid) as s, {trues('has_text_review')} as t, count(distinct language) as l from c group by app_id) " + metric_rows(
        "a", {"total_reviews": "n", "unique_recommendation_ids": "i", "unique_reviewers": "s", "reviews_with_text": "t", "languages_detected": "l"}, "app_id,")
    polarity = f"a as (select count(*) as n, {trues('is_positive')} as p, {trues('is_negative')} as m from c) " + metric_rows(
        "a", {"total_reviews": "n", "positive_reviews": "p", "negative_reviews": "m", "positive_percentage": pct("p", "n"),
              "negative_percentage": pct("m", "n"), "positive_negative_ratio": "round(p::double / nullif(m, 0), 4)"})
    o["polarity_summary"] = f"{NUM}, {polarity}"
    language = f"select coalesce(language, 'unknown') as language, count(*) as review_count, {pct('count(*)', 'sum(count(*)) over ()')} as review_percentage from c group by 1"
    o["language_distribution"] = f"{NUM} {language}"
    every = [*describe.PROFILE_VARIABLES, *describe.PLAYTIME_VARIABLES, *describe.INTERACTION_VARIABLES, *describe.TEXT_VARIABLES, *describe.INTERVAL_VARIABLES]
    o["numeric_summary"] = f"{TXT} {stats_rows(every)}"
    o["reviewer_profile_summary"] = f"{NUM} {stats_rows(describe.PROFILE_VARIABLES)}"
    o["playtime_summary"] = f"{NUM} {stats_rows(describe.PLAYTIME_VARIABLES)}"
    o["interaction_summary"] = f"{NUM} {stats_rows(describe.INTERACTION_VARIABLES)}"
    o["text_summary"] = f"{TXT} {stats_rows(describe.TEXT_VARIABLES)}"
    o["temporal_interval_summary"] = f"{NUM} {stats_rows(describe.INTERVAL_VARIABLES)}"
    o["flag_summary"] = f"{NUM} " + " union all ".join(
        f"select {q(m)} as metric, {trues(f)} as count_true, {pct(trues(f), 'count(*)')} as percentage_true from c" for m, f in describe.ACCESS_FLAGS.items())
    o["missingness_summary"] = f"{NUM} " + " union all ".join(
        f"select {q(c)} as \"column\", count(*) as row_count, count({c}) as non_null_count, count(*) - count({c}) as null_count, {pct(f'count(*) - count({c})', 'count(*)')} as null_percentage from c"
        for c in PREPARED_COLUMNS)
    o["concentration_summary"] = f"{TXT} " + " union all ".join(
        f"""select {q(c)} as variable, round(sum(v), 4) as sum_total, {', '.join(
            f"round(sum(v) filter (where place <= greatest(1, ceil(n * {f}::double))) / nullif(sum(v), 0) * 100, 4) as share_top_{p}_percent"
            for p, f in ((1, 0.01), (5, 0.05), (10, 0.10)))}
          from (select {c}::double as v, row_number() over (order by {c} desc) as place, count(*) over () as n from c where {c} is not null)"""
        for c in describe.CONCENTRATION_VARIABLES)
    o["cross_tab"] = f"""{NUM} select coalesce(language, 'unknown') as language, {bands_by('num_reviews_band', K.REVIEWER_LABELS, False)}, {others('num_reviews_band', K.REVIEWER_LABELS)} from c group by 1"""
    o["xtab_language"], o["xtab_playtime"] = xtab("language"), xtab("playtime_at_review_band")
    o["xtab_reviewer"], o["xtab_library"] = xtab("num_reviews_band"), xtab("num_games_owned_band")
    o["monthly_review_volume"] = f"{NUM} select {YM}, {POLARITY} from c group by {YM}"

    # E. temporal tables
    o["numeric_by_period"] = f"{NUM} select {WEEK}, {stats_by(['playtime_forever', 'votes_up'])} from c where {WEEK} is not null group by {WEEK}"
    o["flag_rate_by_period"] = f"{NUM} select {WEEK}, {rates_by(['has_comments', 'is_free_copy'])} from c where {WEEK} is not null group by {WEEK}"
    o["period_crosstab"] = f"{NUM} select coalesce(developer_responded_date_month, 'unknown') as developer_responded_date_month, {bands_by('playtime_at_review_band', K.PLAYTIME_LABELS, False)}, {others('playtime_at_review_band', K.PLAYTIME_LABELS)} from c group by 1"
    lo, hi = ts("min(timestamp_created)"), ts("max(timestamp_created)")
    o["temporal_coverage"] = f"{NUM}, a as (select app_id, strftime({lo}, '%Y-%m-%d %H:%M:%S') as lo, strftime({hi}, '%Y-%m-%d %H:%M:%S') as hi, (max(timestamp_created) - min(timestamp_created)) // 86400 + 1 as d, count(distinct {MONTH}) as m from c group by app_id) " + metric_rows(
        "a", {"first_review_datetime_utc": "lo", "last_review_datetime_utc": "hi", "days_covered": "d", "months_covered": "m"}, "app_id,")
    o["daily_volume"], o["weekly_volume"] = running(DAY, "day"), running(WEEK, "week")
    three = f"over (order by {MONTH} rows between 2 preceding and current row)"
    o["monthly_volume_extended"] = running(MONTH, "month", ", count(distinct steamid) as unique_reviewers",
        f", round(avg(review_count) {three}, 4) as review_count_rolling_mean_3m, ((2 * sum(round(positive_percentage * 10000)::bigint) {three} + count(positive_percentage) {three}) // (2 * count(positive_percentage) {three}))::double / 10000 as positive_percentage_rolling_mean_3m")
    trends = f"""select *, round(positive_reviews::double / nullif(negative_reviews, 0), 4) as positive_negative_ratio,
      round(positive_percentage - lag(positive_percentage) over (order by {MONTH}), 4) as positive_percentage_change_vs_previous_month
      from (select {MONTH}, {POLARITY} from c group by {MONTH})"""
    o["monthly_polarity_trends"] = f"{NUM} {trends}"
    language_trends = f"""select *, {pct('review_count', 'month_total_reviews')} as review_percentage_within_month, {pct('positive_reviews', 'review_count')} as positive_percentage_within_language_month from (
      select {MONTH}, coalesce(language, 'unknown') as language, count(*) as review_count, {trues('is_positive')} as positive_reviews,
      case when {MONTH} is not null then sum(count(*)) over (partition by {MONTH})::bigint end as month_total_reviews from c group by 1, 2)"""
    o["monthly_language_trends"] = f"{NUM} {language_trends}"
    shares = ", ".join(f"{pct(f'nullif(count(*) filter (where review_length_words_band = {q(l)}), 0)', 'count(*)')} as {ident(f'review_length_words_band_{l}_percentage')}" for l in K.WORDS_LABELS)
    o["monthly_text_length"] = f"{TXT} select {MONTH}, {stats_by(['review_length_words', 'review_length_chars', 'review_length_lines'])}, {shares} from c where {MONTH} is not null group by {MONTH}"
    o["monthly_playtime"] = monthly(f"{stats_by(['playtime_at_review', 'playtime_forever', 'playtime_post_review'])}, {rates_by(['played_after_review', 'recent_playtime_recorded', 'used_steam_deck_at_review'])}, {bands_by('playtime_at_review_band', K.PLAYTIME_LABELS)}")
    played = stats_by(["playtime_at_review", "playtime_forever", "playtime_post_review"])
    o["monthly_playtime_from_days"], o["monthly_volume_from_days"] = monthly(played), o["monthly_volume_extended"]
    o["weekly_playtime_from_days"] = f"{NUM} select app_id, {WEEK}, {played} from c where {WEEK} is not null group by app_id, {WEEK}"
    o["distinct_from_days"] = f"{NUM} select app_id, v as variable, count(distinct x) as distinct from (select app_id, unnest(['steamid', 'recommendationid']) as v, unnest([steamid, recommendationid]) as x from c) group by 1, 2"
    o["monthly_reviewer_profile"] = monthly(f"{stats_by(['num_reviews', 'num_games_owned'])}, {bands_by('num_reviews_band', K.REVIEWER_LABELS)}, {bands_by('num_games_owned_band', K.LIBRARY_LABELS)}")
    o["monthly_interaction"] = monthly(f"{stats_by(['votes_up', 'votes_funny', 'comment_count'])}, {rates_by(['has_helpful_votes', 'has_funny_votes', 'has_comments'])}")
    o["review_updates"] = f"""{NUM} select {MONTH}, count(recommendationid) as review_count, {trues('review_updated_after_creation')} as updated_reviews,
      {pct(trues('review_updated_after_creation'), 'count(recommendationid)')} as updated_reviews_percentage,
      round(avg(days_between_creation_and_update), 4) as mean_days_between_creation_and_update, round(median(days_between_creation_and_update), 4) as median_days_between_creation_and_update from c group by {MONTH}"""

    def side(flag, name):
        return f"""case when {trues(flag)} > 0 then count(recommendationid) filter (where {flag}) end as {name}_reviews,
          case when {trues(flag)} > 0 then {trues(flag + ' and has_developer_response')} end as {name}_reviews_with_response,
          {pct(trues(flag + ' and has_developer_response'), f'count(recommendationid) filter (where {flag})')} as {name}_response_percentage"""
    response = f"""select b.*, w.n as developer_responses_created_in_month from (
      select {MONTH}, count(recommendationid) as review_count, {trues('has_developer_response')} as reviews_with_developer_response,
      round(avg(days_to_developer_response), 4) as mean_days_to_developer_response, round(median(days_to_developer_response), 4) as median_days_to_developer_response,
      {pct(trues('has_developer_response'), 'count(recommendationid)')} as developer_response_percentage, {side('is_negative', 'negative')}, {side('is_positive', 'positive')}
      from c group by {MONTH}) b left join (select developer_responded_date_month as m, count(*) as n from c where has_developer_response group by 1) w on w.m is not distinct from b.{MONTH}"""
    o["response_timeline"] = f"{NUM} {response}"
    pol = f"count(*) as review_count, {trues('is_positive')} as positive_reviews, {trues('is_negative')} as negative_reviews, {pct(trues('is_positive'), 'count(*)')} as positive_percentage, {pct(trues('is_negative'), 'count(*)')} as negative_percentage"
    o["monthly_polarity_by_language"] = f"{NUM} select {MONTH}, coalesce(language, 'unknown') as language, {pol} from c group by 1, 2"
    o["monthly_polarity_by_band"] = f"{NUM} select {MONTH}, playtime_at_review_band, {pol} from c group by 1, 2"
    o["peak_activity"] = f"{NUM}, " + ", ".join(
        f"p_{l} as (select {p} as p, count(recommendationid) as n from c group by {p} order by n desc, p limit 1)" for l, p in (("day", DAY), ("week", WEEK), ("month", MONTH))) + " " + " union all ".join(
        metric_rows(f"p_{l}", {f"peak_{l}_period": "p", f"peak_{l}_review_count": "n"}) for l in ("day", "week", "month"))

    # F. text
    joined = "array_to_string(tokens, ' ') as tokens"
    o["tokenise"] = f"{TXT}, t as {tokens(None, least=1)} select recommendationid, {joined}, token_count from t"
    o["stopword_filter"] = f"{TXT}, t as {tokens(STOPWORDS)} select recommendationid, {joined}, token_count from t"
    o["ngrams"] = f"{TEXT} select term as bigram, count(*) as n from ({grams(2)}) group by term"
    o["text_subset"] = f"{TEXT} select recommendationid, language, token_count from t"
    o["term_counts"] = f"{TEXT} select term, count(*) as overall, {trues('is_positive')} as positive, {trues('is_negative')} as negative from ({grams(1)}) group by term"
    where = {"overall": "true", "positive": "is_positive", "negative": "is_negative"}
    for s, w in where.items():
        o[f"top_unigrams_{s}"] = ranked(TEXT, 100, 1, "token", w)
        o[f"top_bigrams_{s}"] = ranked(TEXT, 50, 2, "bigram", w)
    o["top_trigrams"] = ranked(TEXT, 30, 3, "trigram")

    def corpus(by: str, scope: str) -> str:
        key, group = (f"{by}, ", f"group by {by}") if by else ("", "")
        return f"""{TEXT}, u as (select {key} count(distinct term) as n from (select {key} unnest(tokens) as term from t) {group}),
          a as (select {key} count(*) as n, {trues('is_positive')} as p, {trues('is_negative')} as m, sum(token_count)::bigint as k, round(avg(review_length_words), 4) as aw,
            round(median(review_length_words), 4) as mw, round(avg(review_length_chars), 4) as ac, round(median(review_length_chars), 4) as mc, count(distinct language) as l from t {group}),
          j as (select a.*, u.n as un, round(u.n::double / a.k, 6) as ttr from a, u {'where a.' + by + ' = u.' + by if by else ''}),
          s as (select string_agg(language, ', ' order by n desc, language) as names from (select language, count(*) as n from t group by language having count(*) >= 100 or {pct('count(*)', '(select count(*) from t)')} >= 5))
          """ + metric_rows("j", {
            "scope": q(scope), **({"language": "language"} if by else {}), "reviews_with_text": "n", "positive_review_count": "p", "negative_review_count": "m",
            "total_tokens": "k", "total_unique_tokens": "un", "type_token_ratio": "ttr", "average_review_length_words": "aw", "median_review_length_words": "mw",
            "average_review_length_chars": "ac", "median_review_length_chars": "mc",
            **({} if by else {"languages_with_text": "l", "selected_languages_for_separate_output": "(select coalesce(names, '') from s)"}),
        }, key)
    o["text_corpus_overview"] = corpus("", "global")
    o["per_language_overview"] = corpus("language", "by_language")
    o["text_by_polarity"] = f"{TEXT} " + " union all ".join(
        f"""select '{s}' as segment, count(*) as review_count, coalesce(sum(token_count), 0)::bigint as total_tokens, (select count(distinct term) from ({grams(1)}) where {w}) as unique_tokens,
          round((select count(distinct term) from ({grams(1)}) where {w})::double / nullif(sum(token_count), 0), 6) as type_token_ratio,
          round(avg(review_length_words), 4) as mean_review_length_words, round(median(review_length_words), 4) as median_review_length_words,
          round(avg(review_length_chars), 4) as mean_review_length_chars, round(median(review_length_chars), 4) as median_review_length_chars from t where {w}"""
        for s, w in where.items())
    o["text_by_band"] = text_metrics("playtime_at_review_band")
    o["text_by_language"] = text_metrics("language", share=True)
    o["top_terms_by_language"] = ranked_by_language(TEXT, 100)
    o["distinctive_pos_vs_neg"] = distinctive(TEXT, "positive", "negative", 100)
    o["distinctive_neg_vs_pos"] = distinctive(TEXT, "negative", "positive", 100)
    o["language_selection"] = f"{TEXT} select language, count(*) as review_count, {pct('count(*)', '(select count(*) from t)')} as review_percentage from t group by language having count(*) >= 130 or {pct('count(*)', '(select count(*) from t)')} >= 20"
    selected = f"{TXT}, t0 as {tokens(L.STOPS)}, t as (select * from t0 where language in (select language from t0 group by language having count(*) >= 130 or {pct('count(*)', '(select count(*) from t0)')} >= 20))"
    o["per_language_top_terms"] = ranked_by_language(selected, 50)
    o["per_language_distinctive"] = distinctive(selected, "positive", "negative", 50, "language")
    o["per_language_distinctive_negative"] = distinctive(selected, "negative", "positive", 50, "language")
    for s, w in where.items():
        if s != "overall":
            o[f"per_language_unigrams_{s}"] = ranked_by_language(selected, 50, where=w)
        o[f"per_language_bigrams_{s}"] = ranked_by_language(selected, 50, 2, "bigram", w)
    o["per_language_by_band"] = text_metrics("language", "playtime_at_review_band", base=selected)
    o["per_language_by_polarity"] = " union all ".join(f"({polarity_by_language(selected, s, w)})" for s, w in where.items())
    o["slugify"] = f"with {R_TXT} select recommendationid, coalesce(nullif(trim(regexp_replace(lower({strip('review')}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') as slug from r_txt"

    # G. emotions
    E = enriched_emotions()
    o["emotion_subset"] = f"{EMO_T} select recommendationid, token_count as token_count_for_emotion_analysis from t"
    o["emotion_enrich"] = o["emotion_enrich_by_join"] = f"{E} select recommendationid, {EMO}, {', '.join(f'{e}_count, {e}_per_100_tokens' for e in K.EMOTIONS)} from e"
    o["emotion_overview"] = overview(E, K.EMOTIONS, EMO, "emotion", "total_emotion_token_matches")
    o["emotion_distribution"] = distribution(E, K.EMOTIONS, "emotion")
    o["emotion_by_polarity"] = by_segment(E, K.EMOTIONS, EMO)
    o["emotion_by_band"] = by_group(E, "playtime_at_review_band", K.EMOTIONS, EMO)
    o["emotion_by_month"] = by_group(E, YM, K.EMOTIONS, EMO)
    o["emotion_top_terms"] = f"""{EMO_T}, {LEX}, h as (select emotion, term as token, count(*) as frequency from ({grams(1)}) join lex on lex.word = term group by 1, 2)
      select * from (select emotion, row_number() over (partition by emotion order by frequency desc, token) as rank, token, frequency,
      {k1000('frequency', 'sum(frequency) over (partition by emotion)')} as relative_frequency_per_1000_emotion_hits from h) where rank <= 100"""

    # H. themes
    T = enriched_themes()
    o["theme_subset"] = f"{THEME_T} select recommendationid, token_count as token_count_for_theme_analysis from t"
    single = ", ".join(f"{hits_in_theme(t, False)} as {t}_count" for t in L.THEMES)
    o["theme_match"] = f"{THEME_T} select recommendationid, {single} from (select *, array_to_string(tokens, ' ') as joined from t)"
    whole = ", ".join(f"{hits_in_theme(t, whole_tokens=True)} as {t}_count" for t in L.THEMES)
    o["theme_phrases_of_tokens"] = f"{THEME_T} select recommendationid, {whole} from (select *, ' ' || array_to_string(tokens, '  ') || ' ' as spaced from t)"
    o["theme_enrich"] = f"{T} select recommendationid, {THE}, themes_present_count, {', '.join(f'{t}_count, {t}_present, {t}_matched_terms, {t}_per_100_tokens' for t in THEMES)} from e"
    o["theme_overview"] = overview(T, THEMES, THE, "theme", "total_theme_matches")
    o["theme_distribution"] = distribution(T, THEMES, "theme")
    o["theme_by_polarity"] = by_segment(T, THEMES, THE)
    o["theme_by_band"] = by_group(T, "playtime_at_review_band", THEMES, THE)
    o["theme_by_month"] = by_group(T, YM, THEMES, THE)
    o["theme_top_terms"] = f"{T}, h as (" + " union all ".join(
        f"select {q(t)} as theme, {q(w)} as term, count(*) as frequency from e where {term_found(w)} having count(*) > 0" for t, ws in L.THEMES.items() for w in ws) + f""")
      select theme, row_number() over (partition by theme order by frequency desc, term) as rank, term, frequency, {k1000('frequency', 'sum(frequency) over (partition by theme)')} as relative_frequency_per_1000_theme_hits from h"""

    # I. charts, each over the report table that feeds it
    def over(name: str, select: str) -> str:
        return f"select {select} from ({o[name]}) src"
    o["fig_polarity"] = over("polarity_summary", "replace(metric, '_reviews', '') as polarity, cast(value as bigint) as review_count") + " where metric in ('positive_reviews', 'negative_reviews')"
    o["fig_language_top10"] = over("language_distribution", "language, review_count") + " order by review_count desc, language limit 10"
    o["fig_polarity_band"] = over("xtab_playtime", 'playtime_at_review_band, "False" as negative_reviews, "True" as positive_reviews')
    o["fig_monthly_volume"] = over("monthly_volume_extended", f"{MONTH}, review_count")
    o["fig_monthly_polarity"] = over("monthly_polarity_trends", f"{MONTH}, positive_reviews, negative_reviews")
    o["fig_positive_pct"] = over("monthly_polarity_trends", f"{MONTH}, positive_percentage")
    # The five most frequent of the five languages of the orders are all of them.
    o["fig_language_top5"] = over("monthly_language_trends", f"{MONTH}, " + ", ".join(
        f"coalesce(sum(review_count) filter (where language = {q(l)}), 0)::bigint as {ident(l)}" for l in ("high", "low", "medium", "unknown", "urgent"))) + f" group by {MONTH}"
    o["fig_response"] = over("response_timeline", f"{MONTH}, reviews_with_developer_response")
    for side_name, full in (("pos", "positive"), ("neg", "negative")):
        o[f"fig_unigrams_{side_name}"] = over(f"top_unigrams_{full}", "token, frequency") + " where rank <= 20"
    for a, b, full in (("pos", "neg", "positive"), ("neg", "pos", "negative")):
        o[f"fig_distinctive_{a}"] = over(f"distinctive_{a}_vs_{b}", "token, difference_per_1000") + f" order by difference_per_1000 desc, {full}_frequency desc, token limit 20"
    o["fig_emotion"] = over("emotion_distribution", "emotion, mean_per_100_tokens")

    def turned(table: str, suffix: str, name: str, categories: list[str]) -> str:
        return " union all ".join(
            f"select {q(c)} as {name}, max({c}{suffix}) filter (where segment = 'positive') as positive, max({c}{suffix}) filter (where segment = 'negative') as negative from ({o[table]}) src"
            for c in categories)
    o["fig_emotion_polarity"] = turned("emotion_by_polarity", "_mean_per_100_tokens", "emotion", K.EMOTIONS)
    o["fig_emotion_month"] = over("emotion_by_month", f"{YM}, " + ", ".join(f"{e}_mean_per_100_tokens" for e in ("joy", "trust", "negative", "anger")))
    o["fig_theme"] = over("theme_distribution", "theme, review_share_with_theme")
    o["fig_theme_polarity"] = turned("theme_by_polarity", "_review_share", "theme", sorted(THEMES))
    o["fig_theme_month"] = over("theme_by_month", YM)
    shapes = ["fig_polarity", "fig_language_top10", "fig_polarity_band", "fig_monthly_volume", "fig_monthly_polarity", "fig_positive_pct", "fig_language_top5", "fig_response",
              "fig_unigrams_pos", "fig_unigrams_neg", "fig_distinctive_pos", "fig_distinctive_neg", "fig_emotion", "fig_emotion_polarity", "fig_emotion_month", "fig_theme", "fig_theme_polarity", "fig_theme_month"]
    widths = [2, 2, 3, 2, 3, 2, 6, 2, 2, 2, 2, 2, 2, 3, 5, 2, 3, 1]
    o["figure_index"] = " union all ".join(
        f"select {q(f.figure_id)} as figure_id, {q(f.family)} as family, {q(f.title)} as title, {q(f.chart_type)} as chart_type, {q(f.source_table)} as source_table, "
        f"(select count(*) from ({o[s]})) as row_count, {w}::bigint as column_count, {q(f.notes)} as notes" for f, s, w in zip(charts.FIGURES, shapes, widths))

    o["fig_polarity_by_product"] = f"{NUM}, p as (select app_id, {trues('is_positive')} as positive, {trues('is_negative')} as negative from c group by 1) select app_id, polarity, review_count from p unpivot (review_count for polarity in (positive, negative))"
    o["fig_language_top10_by_product"] = f"""{NUM}, l as (select app_id, coalesce(language, 'unknown') as language, count(*) as review_count from c group by 1, 2)
      select app_id, language, review_count from (select *, row_number() over (partition by app_id order by review_count desc, language) as r from l) where r <= 10"""

    # J. word-frequency tables
    def cloud(n, label, low, top):
        return f"{CLOUD_T}, g as (select term, count(*) as frequency from ({grams(n)}) group by term having count(*) >= {low}) select row_number() over (order by frequency desc, term) as rank, term as {label}, frequency from g order by rank limit {top}"
    for n, label, top in ((1, "unigram", 200), (2, "bigram", 150), (3, "trigram", 100)):
        o[f"cloud_{label}s"] = cloud(n, label, 2, top)
    o["cloud_summary"] = f"{CLOUD_T} select (select count(*) from c) as rows_in_cleaned_dataset, count(*) as rows_used_for_word_clouds, sum(token_count)::bigint as total_tokens_used, " + ", ".join(
        f"(select count(*) from ({cloud(n, l, 2, top)})) as {l}s" for n, l, top in ((1, "unigram", 200), (2, "bigram", 150), (3, "trigram", 100))) + " from t"

    # K. checks
    raw_ids = f"(select {ids} as id from r_raw where {ids} <> '')"
    total, unique = f"(select count(*) from {raw_ids})", f"(select count(distinct id) from {raw_ids})"
    required = ["recommendationid", "review", "language", "voted_up"]
    def required_check(base: str, table: str, check_id: str, missing: str) -> str:
        filled = " || ', ' || ".join(f"(select count({c}) from {table})" for c in required if c != missing)
        return checks(base, check_id, "error", "false" if missing else "true", "Required columns present", f"'Missing required columns: {missing}'", {
            "required_columns": "'\"" + ", ".join(required) + "\"'", "missing_columns": f"'\"{missing}\"'", "filled_rows": f"'\"' || {filled} || '\"'"})
    o["dq_required_columns"] = f"select * from ({required_check(RAW, 'r_raw', 'raw_required_columns', '')}) union all select * from ({required_check(f'with {R_NUM}', 'r_num', 'orders_required_columns', 'review')})"
    o["dq_non_empty"] = checks(f"with {R_NUM}", "reviews_non_empty", "error", "((select count(*) from r_num) > 0)", "Table contains rows", "'Table is empty'", {"row_count": "(select count(*) from r_num)"})
    dup = "((select count(*) from r_raw) - (select count(distinct coalesce(recommendationid, '')) from r_raw))"
    o["dq_unique_id"] = checks(RAW, "recommendationid_uniqueness", "warning", f"({dup} = 0)", "No duplicated ids", f"'Found duplicated ids: ' || {dup}", {"duplicated_count": dup})
    o["dq_cross_chunk"] = checks(RAW, "chunks_cross_file_uniqueness", "warning", f"({total} = {unique})", "No duplicated ids across chunks", f"'Found duplicated ids across chunks: ' || ({total} - {unique})",
                                 {"chunk_row_total": total, "chunk_unique_ids": unique, "duplicate_ids_across_chunks": f"({total} - {unique})"})
    o["dq_combined_vs_chunks"] = checks(RAW, "combined_vs_chunks_unique_count", "warning", "true", "Combined id count matches chunks", "''", {"combined_unique_ids": unique, "chunk_unique_ids": unique})
    n_num = "(select count(*) from r_num)"
    o["dq_index_total"] = checks(f"with {R_NUM}", "index_cumulative_matches_chunks", "warning", "true", "Index cumulative total matches chunks", "''", {"index_cumulative_records": n_num, "chunk_unique_ids": n_num})
    n_txt, top_txt = "(select count(distinct recommendationid) from r_txt)", "(select max(cast(recommendationid as bigint)) + 1 from r_txt)"
    base_txt = f"with {R_TXT}"
    o["dq_final_total"] = f"select * from ({checks(base_txt, 'progress_final_total_matches_chunks', 'warning', 'true', 'Recorded final total matches chunks', chr(39) * 2, {'final_total_unique_reviews': n_txt, 'chunk_unique_ids': n_txt})}) union all select * from (" \
        + checks(base_txt, "progress_expected_total_delta_reported", "warning", "true", "Expected total is recorded for comparison", "''", {"expected_total_reviews": top_txt, "chunk_unique_ids": n_txt, "difference": f"({n_txt} - {top_txt})"}) + ")"
    pn = f"(select {trues('is_positive')} + {trues('is_negative')} from c)"
    o["dq_polarity_total"] = checks(NUM, "polarity_total_consistency", "warning", f"((select count(*) from c) = {pn})", "Polarity totals are consistent", "'Polarity totals are inconsistent'",
                                    {"total_reviews": "(select count(*) from c)", "positive_reviews": f"(select {trues('is_positive')} from c)", "negative_reviews": f"(select {trues('is_negative')} from c)"})
    o["dq_unique_id_by_product"] = f"{RAW}, d as (select app_id, count(*) - count(distinct coalesce(recommendationid, '')) as n from r_raw group by 1) select app_id, " + checks(
        "", "recommendationid_uniqueness", "warning", "(n = 0)", "No duplicated ids", "'Found duplicated ids: ' || n", {"duplicated_count": "n"}).strip().removeprefix("select ") + " from d"
    o["dq_polarity_total_by_product"] = f"{NUM}, p as (select app_id, count(*) as t, {trues('is_positive')} as a, {trues('is_negative')} as b from c group by 1) select app_id, " + checks(
        "", "polarity_total_consistency", "warning", "(t = a + b)", "Polarity totals are consistent", "'Polarity totals are inconsistent'",
        {"total_reviews": "t", "positive_reviews": "a", "negative_reviews": "b"}).strip().removeprefix("select ") + " from p"
    o["dq_segments"] = checks("", "emotion_by_polarity_expected_segments", "warning", "true", "Expected segments present", "''", {"missing_segments": "'\"\"'"})
    parts = [o[n] for n in ("dq_required_columns", "dq_non_empty", "dq_unique_id", "dq_cross_chunk", "dq_polarity_total")]
    allc = " union all ".join(f"select passed, severity from ({p})" for p in parts)
    o["dq_summary"] = f"""select count(*) as check_count_total, {trues('passed')} as check_count_passed, {trues('not passed')} as check_count_failed,
      {trues("not passed and severity = 'error'")} as error_failures, {trues("not passed and severity = 'warning'")} as warning_failures,
      case when {trues("not passed and severity = 'error'")} > 0 then 'failed' else 'passed' end as final_status from ({allc})"""

    # L. streams: the batch result over the given events
    o["stream_dedup"] = "select event_id, user_id, event_type, value from events"
    o["stream_resume"] = "select event_id, user_id, event_type, value from events"
    o["stream_progress"] = """with f as (select event_id // ((select max(event_id) from events) // 4 + 1) as batch_id from events)
      select batch_id, count(*) as rows_in, count(*) as rows_kept, sum(count(*)) over (order by batch_id)::bigint as rows_kept_cumulative from f group by 1"""
    counts = "count(*) as review_count, count(*) filter (where event_type = 'purchase') as positive_reviews, count(*) filter (where event_type = 'error') as negative_reviews"
    def stream(key: str) -> str:
        return f"select *, {pct('positive_reviews', 'review_count')} as positive_percentage, {pct('negative_reviews', 'review_count')} as negative_percentage from (select {key}, {counts} from events group by all)"
    o["stream_daily_volume"] = stream("strftime(ts, '%Y-%m-%d') as day")
    o["stream_weekly_volume"] = stream(f"{week('ts')} as week")
    o["stream_monthly_polarity"] = stream("strftime(ts, '%Y-%m') as month, event_type")
    o["stream_late_days"] = o["stream_daily_volume"]
    o["stream_lost_state"] = o["stream_resume"]
    o["stream_progress_log"] = """with f as (select event_id // ((select max(event_id) from events) // 4 + 1) as batch_id, count(*) as n from events group by 1),
      r as (select 0 as run, batch_id, n as rows_in, n as rows_kept from f where batch_id < 2 union all
            select 1, batch_id, n, case when batch_id < 2 then 0 else n end from f)
      select run, batch_id, rows_in, rows_kept, sum(rows_kept) over (order by run, batch_id)::bigint as rows_kept_cumulative from r"""
    o["incremental_bucketed"] = o["incremental_anti_join"]
    return o

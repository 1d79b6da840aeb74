"""Review tables derived from the given tables, as SQL text that Spark and DuckDB both run.

Only the time functions differ between the engines; `{unix:x}`-style differences are kept in `_DIALECT`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators import prepare, text

_DIALECT = {
    "spark": {"unix": "unix_seconds(cast({0} as timestamp))", "str": "string", "list": "array", "each": "explode({0})"},
    "duckdb": {"unix": "cast(floor(epoch({0})) as bigint)", "str": "varchar", "list": "list_value", "each": "unnest({0})"},
}


def orders_as_reviews(dialect: str, orders: str = "orders", lineitem: str = "lineitem") -> str:
    """One review per order: typed, with nulls, zeros, all bands and a three-valued polarity."""
    d = _DIALECT[dialect]
    unix = d["unix"].format
    return f"""
select
  cast(o.o_orderkey as {d['str']}) as recommendationid,
  cast(o.o_custkey as {d['str']}) as steamid,
  o.o_custkey % 600 as num_games_owned,
  o.o_custkey % 12 as num_reviews,
  la.qty * 20 + o.o_custkey % 200 - 50 as playtime_forever,
  o.o_custkey % 3 as playtime_last_two_weeks,
  la.qty * 20 as playtime_at_review,
  case when o.o_custkey % 4 <> 0 then o.o_custkey % 2 end as deck_playtime_at_review,
  {unix('la.last_ship')} as last_played,
  case when o.o_orderpriority <> '4-NOT SPECIFIED' then lower(substr(o.o_orderpriority, 3)) end as language,
  {unix('o.o_orderdate')} as timestamp_created,
  case when la.last_ship > o.o_orderdate then {unix('la.last_ship')} else {unix('o.o_orderdate')} end as timestamp_updated,
  case o.o_orderstatus when 'F' then true when 'O' then false end as voted_up,
  coalesce(la.n, 0) as votes_up,
  coalesce(la.n_ret, 0) as votes_funny,
  coalesce(la.n_acc, 0) as comment_count,
  o.o_custkey % 5 <> 0 as steam_purchase,
  o.o_custkey % 7 = 0 as received_for_free,
  false as written_during_early_access,
  case when o.o_orderpriority = '1-URGENT' then 'reply' end as developer_response,
  case when o.o_orderpriority = '1-URGENT' and la.first_ret > o.o_orderdate then {unix('la.first_ret')} end as timestamp_dev_responded,
  case when o.o_custkey % 4 <> 0 then false end as primarily_steam_deck,
  o.o_custkey % 3 as app_id
from {orders} o
left join (
  select l_orderkey,
    count(*) as n,
    count(case when l_returnflag = 'R' then 1 end) as n_ret,
    count(case when l_returnflag = 'A' then 1 end) as n_acc,
    cast(sum(l_quantity) as bigint) as qty,
    max(l_shipdate) as last_ship,
    min(case when l_returnflag = 'R' then l_shipdate end) as first_ret
  from {lineitem} group by l_orderkey
) la on la.l_orderkey = o.o_orderkey
"""


def documents_as_reviews(
    dialect: str, documents: str = "documents", labels: str = "labels", reviews: str = "r_num"
) -> str:
    """One review per document: its text and language, polarity from the label, the rest from the order of that key."""
    d = _DIALECT[dialect]
    return f"""
select
  cast(d.doc_id as {d['str']}) as recommendationid,
  case d.lang when 'en' then 'english' when 'fr' then 'french' when 'de' then 'german' when 'es' then 'spanish' end as language,
  d.text as review,
  l.quality = 1 as voted_up,
  r.steamid, r.num_games_owned, r.num_reviews, r.playtime_forever, r.playtime_last_two_weeks, r.playtime_at_review,
  r.deck_playtime_at_review, r.last_played, r.timestamp_created, r.timestamp_updated, r.votes_up, r.votes_funny,
  r.comment_count, r.steam_purchase, r.received_for_free, r.written_during_early_access, r.developer_response,
  r.timestamp_dev_responded, r.primarily_steam_deck, d.doc_id % 3 as app_id
from {documents} d
left join {labels} l on l.doc_id = d.doc_id
left join {reviews} r on r.recommendationid = cast(d.doc_id as {d['str']})
"""


def raw_text_reviews(dialect: str, reviews: str = "r_txt") -> str:
    """The document reviews as landed text: odd spellings, padding, blanks, repeated and missing ids."""
    d = _DIALECT[dialect]
    cr, tab = ("chr(13)", "chr(9)") if dialect == "duckdb" else ("'\\r'", "'\\t'")
    nl = "chr(10)" if dialect == "duckdb" else "'\\n'"
    numbers = [
        "num_games_owned", "num_reviews", "playtime_forever", "playtime_last_two_weeks", "playtime_at_review",
        "deck_playtime_at_review", "last_played", "timestamp_created", "timestamp_updated", "votes_up", "votes_funny",
        "comment_count", "timestamp_dev_responded",
    ]
    flags = ["voted_up", "steam_purchase", "received_for_free", "written_during_early_access", "primarily_steam_deck"]
    spelled = "case k % 8 when 0 then 'TRUE' when 1 then 'false' when 2 then '1' when 3 then '0' when 4 then ' Yes' when 5 then 'no ' when 6 then 't' else 'maybe' end"
    dirty = f"""
  case k % 13 when 0 then '' when 1 then 'nan' when 2 then 'None' else
    case when k % 7 = 0 then concat('  ', review, {cr}, {nl}, 'x', {tab}, {tab}, ' y', {cr}, {nl}, {nl}, {nl}, {nl}, 'z ')
    else review end end as review"""
    body = f"""
  case when k % 97 <> 0 then recommendationid end as recommendationid,
  steamid,
  concat(' ', upper(language), {tab}) as language,
  {dirty},
  {', '.join(f"case when k % 11 = 0 then 'x' else cast({c} as {d['str']}) end as {c}" for c in numbers)},
  {', '.join(f"{spelled} as {c}" for c in flags)},
  cast(null as {d['str']}) as weighted_vote_score,
  case when developer_response is not null then concat(developer_response, {cr}) end as developer_response,
  app_id"""
    numbered = f"(select *, cast(recommendationid as bigint) as k from {reviews})"
    repeats = d["each"].format(f"case when k % 10 = 0 then {d['list']}(0, 1000000000) else {d['list']}(0) end")
    return f"select k + shift as seq, {body} from (select *, {repeats} as shift from {numbered})"


# ---------------------------------------------------------------- Spark side

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its time zone-less timestamps become instants under the UTC session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # The scan's own splits do not fill the cores: a table of less than a split per core, whose single row group is one
        # task. A large table, in however few files, has more splits than cores and is read as it is.
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.withColumns({c: df[c].cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = orders_as_reviews("spark", "{orders}", "{lineitem}")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = documents_as_reviews("spark", "{documents}", "{labels}", "{reviews}")
    return spark.sql(
        sql, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"),
        reviews=order_reviews(spark, sf_dir),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(raw_text_reviews("spark", "{reviews}"), reviews=document_reviews(spark, sf_dir))


def analysed(df: DataFrame) -> DataFrame:
    """A typed review table with every derived column, band and period."""
    return prepare.add_periods(prepare.add_bands(prepare.derive(prepare.ensure_columns(df))))


def num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(order_reviews(spark, sf_dir))


def txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(document_reviews(spark, sf_dir))


def txt_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`txt` in parts of a bounded size, for n-grams."""
    return text.dealt(txt(spark, sf_dir), text.parts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text"))

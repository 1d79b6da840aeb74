"""Reading and writing review tables, report tables and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import exprs as X
from gleaner.functions.lookups import SMALL_ROWS, rows_if_small
from gleaner.sources import schema as S


# ---------------------------------------------------------------- reviews

def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews from CSV, every column as text; an empty input is an error."""
    df = spark.read.schema(S.raw_schema(as_text=True)).options(header=True, multiLine=True, escape='"').csv(path)
    if df.isEmpty():
        raise ValueError(f"No reviews in {path}")
    return df


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned table written by `write_cleaned`; types come with it."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"No reviews in {path}")
    return df


def write_cleaned(df: DataFrame, path: str, partition_by: Sequence[str] = ("app_id",)) -> None:
    """Parquet, one folder per product, so that work on one product reads one folder."""
    df.write.mode("overwrite").partitionBy(*[c for c in partition_by if c in df.columns]).parquet(path)


def json_records(df: DataFrame) -> DataFrame:
    """Each row as JSON text: NaN and infinities as null, timestamps in ISO form, nulls written out."""
    def clean(c: str, t: str):
        col = X.quoted(c)
        if t in ("double", "float"):
            return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col).alias(c)
        return col.alias(c)

    row = F.struct(*[clean(c, t) for c, t in df.dtypes])
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    return df.select(F.to_json(row, options).alias("value"))


def write_json_records(df: DataFrame, path: str) -> None:
    json_records(df).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A report table as CSV with header; quotes are doubled, so texts with newlines survive."""
    writer = df.write.mode("overwrite").options(header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_counted(df: DataFrame, path: str, counts: Mapping[str, Column], partition_by: Sequence[str] = ()) -> dict:
    """Writes the table as Parquet and returns the `counts` over its rows, taken by the same job as it writes.

    `counts` are aggregates without distinct. They are observed behind the last shuffle, where a repeated task counts once.
    """
    seen = Observation()
    observed = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    writer = observed.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get


def _metadata() -> dict[str, Column]:
    return {
        "rows_exported": F.count(F.lit(1)),
        "positive_reviews": F.count_if("is_positive"),
        "negative_reviews": F.count_if("is_negative"),
        "reviews_with_developer_response": F.count_if("has_developer_response"),
    }


def write_cleaned_counted(df: DataFrame, path: str, partition_by: Sequence[str] = ("app_id",)) -> dict:
    """`write_cleaned` that returns the preparation metadata of the table with it, from one job.

    The languages are few: a set of them is gathered per task.
    """
    languages = {"languages": F.array_sort(F.collect_set("language"))}
    found = write_counted(df, path, _metadata() | languages, [c for c in partition_by if c in df.columns])
    return {**{k: found[k] for k in _metadata()}, "columns_exported": len(df.columns), "languages_detected": len(found["languages"])}


def preparation_metadata(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, polarity, responses and languages of a cleaned table."""
    return df.groupBy(*keys).agg(
        *[c.alias(name) for name, c in _metadata().items()],
        F.lit(len(df.columns)).cast("bigint").alias("columns_exported"),
        F.count_distinct("language").alias("languages_detected"),
    )


# ---------------------------------------------------------------- lookups

def parse_lexicon(lines: DataFrame, column: str = "value") -> DataFrame:
    """`word<tab>emotion<tab>1` lines to distinct `(word, emotion)`; other lines, categories and flags are skipped."""
    parts = lines.select(F.split(X.strip(F.col(column)), "\t").alias("p")).filter(F.size("p") == 3)
    rows = parts.select(F.col("p")[0].alias("word"), F.col("p")[1].alias("emotion"), F.col("p")[2].alias("flag"))
    return rows.filter((F.col("flag") == "1") & F.col("emotion").isin(K.EMOTIONS)).select("word", "emotion").distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    lexicon = parse_lexicon(spark.read.text(path))
    if lexicon.isEmpty():
        raise ValueError(f"No emotion entries in {path}")
    return lexicon


def parse_themes(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON object theme -> list of terms, as distinct `(theme, term, is_phrase)`; entries that are no list are skipped."""
    entries = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("theme", "terms"))
    terms = entries.select(
        F.lower(X.strip(F.col("theme"))).alias("theme"),
        F.explode(F.from_json("terms", "array<string>")).alias("term"),
    ).withColumn("term", F.lower(X.strip(F.col("term"))))
    kept = terms.filter((F.col("theme") != "") & (F.col("term") != "")).distinct()
    return kept.withColumn("is_phrase", F.contains("term", F.lit(" ")))


def read_themes(spark: SparkSession, path: str, limit: int = SMALL_ROWS) -> dict[str, list[str]]:
    """The theme dictionary of a JSON file, of up to `limit` terms. Themes become column names, so they must be known to the driver."""
    terms = parse_themes(spark.read.text(path, wholetext=True))
    rows = rows_if_small(terms, limit)
    if not rows:
        raise ValueError(f"No themes in {path}" if rows is not None else f"More than {limit} terms in {path}")
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.theme, r.term)):
        out.setdefault(row.theme, []).append(row.term)
    return out


# ---------------------------------------------------------------- settings

@dataclass(frozen=True)
class Settings:
    """Report parameters with their defaults; per-product values come from `from_json`."""

    min_reviews_per_language: int = 100
    min_share_per_language: float = 1.0
    top_n_unigrams: int = 200
    top_n_bigrams: int = 100
    top_n_trigrams: int = 50
    min_token_length: int = 2
    remove_stopwords: bool = True
    export_per_language: bool = True
    target_language: str = "english"
    top_n_emotion_terms: int = 100
    count_multiple_hits_per_theme: bool = True
    cloud_target_language: str = "all"
    cloud_limits: Mapping[str, tuple[int, int, int]] = field(
        default_factory=lambda: {"unigram": (1, 2, 200), "bigram": (2, 2, 150), "trigram": (3, 2, 100)}
    )

    @staticmethod
    def from_json(config: Mapping) -> "Settings":
        """Settings out of a product's configuration object; missing parts keep their defaults."""
        text, themes, cloud = (config.get(k, {}) for k in ("text_metrics", "theme_metrics", "word_cloud"))
        emotion, base = config.get("emotion_metrics", {}), Settings()
        names = ("min_reviews_per_language", "min_share_per_language", "top_n_unigrams", "top_n_bigrams",
                 "top_n_trigrams", "min_token_length", "remove_stopwords", "export_per_language")
        limits = {
            label: (n, int(cloud.get(f"min_frequency_{label}s", low)), int(cloud.get(f"max_words_{label}s", top)))
            for label, (n, low, top) in base.cloud_limits.items()
        }
        return Settings(
            **{k: type(getattr(base, k))(text.get(k, getattr(base, k))) for k in names},
            target_language=str(emotion.get("target_language", base.target_language)).strip().lower(),
            top_n_emotion_terms=int(emotion.get("top_n_emotion_terms", base.top_n_emotion_terms)),
            count_multiple_hits_per_theme=bool(themes.get("count_multiple_hits_per_theme", True)),
            cloud_target_language=str(cloud.get("target_language", "all")).strip().lower(),
            cloud_limits=limits,
        )

"""Ids that are stored already, in a table bucketed by id: a batch is dealt to the buckets, what is stored stays where it is.

An anti join of a batch with all rows stored so far would shuffle those rows again for every batch. Here the stored ids lie in
buckets by their hash. Only the batch is shuffled, into as many parts as there are buckets, and each part meets its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "place int, key string, type string, buckets int"
ADDED_BY = "added_by"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of a folder, without rows where there is no such folder yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class IdStore:
    spark: SparkSession
    table: str
    keys: tuple[str, ...]
    buckets: int

    def stored(self) -> DataFrame:
        """The keys of all ids, with who has added them; an id added twice is there twice."""
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame, but_by: str | None = None) -> DataFrame:
        """Rows of a batch whose id is not stored; rows with a null in a key are dropped. Rows that share an id all stay.

        What `but_by` has added does not count, so a batch that is repeated after a failure keeps what it kept before.
        """
        known = self.stored()
        if but_by is not None:
            known = known.filter(F.col(ADDED_BY) != but_by)
        dealt = batch.dropna(subset=list(self.keys)).repartition(self.buckets, *self.keys)
        # a merge join at every size: what is stored grows without bound and must not become a broadcast
        return dealt.join(known.select(*self.keys).hint("merge"), list(self.keys), "left_anti")

    def add(self, rows: DataFrame, by: str = "") -> None:
        """Stores the ids of `rows`: one file per bucket and call. Ids that are there already do no harm."""
        ids = rows.select(*self.keys, F.lit(by).alias(ADDED_BY)).dropna(subset=list(self.keys))
        ids.repartition(self.buckets, *self.keys).write.insertInto(self.table)

    def compact(self, folder: str) -> IdStore:
        """A store in a fresh folder with each id once and one file per bucket, after many calls of `add`."""
        types = dict(self.stored().dtypes)
        out = open_ids(self.spark, folder, {k: types[k] for k in self.keys}, self.buckets)
        out.add(self.stored().select(*self.keys).dropDuplicates(list(self.keys)))
        return out


def open_ids(spark: SparkSession, folder: str, keys: dict[str, str] | Sequence[str] = ("recommendationid",), buckets: int = 0) -> IdStore:
    """The store in `folder`, made if it is not there: `keys` names its columns (strings, or a mapping to types).

    The number of buckets (by default that of shuffle partitions) is fixed when the folder is made and read from it later. The
    folder is all there is: any later session opens it again.
    """
    known = read_if_there(spark, f"{folder}/settings", SETTINGS).orderBy("place").collect()  # one row per key
    if not known:
        named = dict(keys) if isinstance(keys, dict) else dict.fromkeys(keys, "string")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = [(i, k, t, buckets) for i, (k, t) in enumerate(named.items())]
        spark.createDataFrame(made, SETTINGS).coalesce(1).write.parquet(f"{folder}/settings")
    else:
        named, buckets = {r.key: r.type for r in known}, known[0].buckets
    table = f"ids_{hashlib.md5(folder.encode()).hexdigest()}"
    columns = ", ".join(f"`{k}` {t}" for k, t in named.items())
    by = ", ".join(f"`{k}`" for k in named)
    spark.sql(
        f"create table if not exists {table} ({columns}, {ADDED_BY} string) using parquet "
        f"clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{folder}/ids'"
    )
    return IdStore(spark, table, tuple(named), buckets)

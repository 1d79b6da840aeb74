"""Ids, rows and progress that outlive checkpoints; running results by changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.sources import id_store
from gleaner.streaming import ingest, reviews as streams

SCHEMA = "id string, day string, n long"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def source(spark, path, files=None):
    return streams.read_files(spark, f"{path}/in", spark.createDataFrame([], SCHEMA).schema, files)


def run(spark, path, state, files=None):
    store = id_store.open_ids(spark, f"{path}/ids", ["id"], 4)
    return ingest.ingest(source(spark, path, files), store, f"{path}/out", f"{path}/{state}", ["n"])


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def exchanges(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "Exchange" in line]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)


def test_only_the_batch_is_shuffled(spark, path):
    store = id_store.open_ids(spark, path, ["id"], 6)
    store.add(spark.range(1000).select(F.col("id").cast("string")))
    store.add(spark.range(500, 1500).select(F.col("id").cast("string")), "again")
    batch = spark.range(900, 2000, 1, 3).select(F.col("id").cast("string"), F.lit(1).alias("x"))
    fresh = store.unseen(batch)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    # one shuffle, above the batch; what is stored is read by bucket
    assert len(exchanges(plan)) == 1 and plan.index("Exchange") < plan.index("Range") < plan.index("Bucketed: true")
    assert sorted(int(r.id) for r in fresh.collect()) == list(range(1500, 2000))
    assert sorted(int(r.id) for r in store.unseen(batch, but_by="again").collect()) == list(range(1000, 2000))


def test_the_folder_is_the_store(spark, path):
    store = id_store.open_ids(spark, f"{path}/a", {"app": "int", "id": "string"}, 5)
    assert store.unseen(spark.createDataFrame([(1, "x")], "app int, id string")).count() == 1  # nothing is stored yet
    store.add(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (3, None)], "app int, id string"))
    spark.sql(f"drop table {store.table}")  # as a new session knows nothing
    again = id_store.open_ids(spark, f"{path}/a", ["other"], 9)
    assert (again.keys, again.buckets) == (("app", "id"), 5)
    batch = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (2, "y"), (None, "x")], "app int, id string")
    assert [tuple(r) for r in again.unseen(batch).collect()] == [(2, "y"), (2, "y")]
    small = again.compact(f"{path}/b")
    assert sorted(tuple(r)[:2] for r in small.stored().collect()) == [(1, "x"), (2, "x")]


def test_a_lost_checkpoint_keeps_nothing_twice(spark, path):
    arrive(spark, path, [("a", "d", 2), ("a", "d", 1), ("b", "d", 1), (None, "d", 1)])
    first = run(spark, path, "one")
    assert sorted((r.id, r.n) for r in first.collect()) == [("a", 1), ("b", 1)]
    arrive(spark, path, [("b", "d", 5), ("c", "d", 6)])
    assert ids(run(spark, path, "two")) == ["a", "b", "c"]  # reads both files again
    arrive(spark, path, [("d", "d", 1)])
    assert ids(run(spark, path, "one")) == ["a", "b", "c", "d"]  # the old checkpoint goes on as well
    log = [(r.run, r.batch_id, r.rows_kept, r.rows_kept_cumulative) for r in ingest.progress(spark, f"{path}/out").orderBy("run", "batch_id").collect()]
    assert log == [(0, 0, 2, 2), (0, 1, 1, 3), (1, 0, 1, 4)]


@pytest.mark.parametrize("state", ["one", "fresh"])
@pytest.mark.parametrize("step", ["rows", "ids"])
def test_a_run_that_dies_between_its_steps(spark, path, monkeypatch, state, step):
    arrive(spark, path, [("a", "d", 1), ("b", "d", 1)])
    real, ended = id_store.IdStore.add, []

    def dies(self, rows, by=""):
        if step == "ids":
            real(self, rows, by)
        ended.append(by)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(id_store.IdStore, "add", dies)
        with pytest.raises(Exception, match="lost"):
            run(spark, path, "one")
    assert ended == ["run=0/batch_id=0"]
    arrive(spark, path, [("a", "d", 7), ("c", "d", 1)])
    assert ids(run(spark, path, state)) == ["a", "b", "c"]
    assert sum(r.rows_kept for r in ingest.progress(spark, f"{path}/out").collect()) == 3
    assert ids(run(spark, path, "later")) == ["a", "b", "c"]


def test_nothing_has_arrived(spark, path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/in")
    assert ingest.progress(spark, f"{path}/out").count() == 0


def days(spark, path, state, fold_every=256, files=None, watermark=None):
    stream = source(spark, path, files).withColumns({"ts": F.col("day").cast("timestamp"), "up": F.col("n") > 0, "down": F.col("n") <= 0})
    stream = stream.withWatermark("ts", watermark) if watermark else stream
    out = streams.daily_volume(stream, "ts", "up", "down")
    found = ingest.run_to_changes(out, ["day"], f"{path}/out", f"{path}/{state}", fold_every)
    return sorted((r.day, r.review_count, r.positive_reviews) for r in found.collect())


@pytest.mark.parametrize("fold_every", [1, 2, 256])
def test_a_late_batch_writes_only_its_days(spark, path, fold_every):
    for batch in ([("a", "2024-01-01", 1), ("b", "2024-01-02", 0)], [("c", "2024-01-03", 1)], [("d", "2024-01-01", 0)]):
        arrive(spark, path, batch)
        found = days(spark, path, "state", fold_every)
    assert found == [("2024-01-01", 2, 1), ("2024-01-02", 1, 0), ("2024-01-03", 1, 1)]
    changes = spark.read.parquet(f"{path}/out/changes")
    assert [r.day for r in changes.filter("batch_id = 2").collect()] == ["2024-01-01"] and changes.count() == 4
    # a run with a fresh checkpoint counts from the beginning
    assert days(spark, path, "other", fold_every) == found


def test_a_watermark_lets_go_of_finished_days(spark, path):
    found = []
    for batch in ([("a", "2024-01-01", 1)], [("b", "2024-03-01", 1)], [("c", "2024-03-02", 1)], [("d", "2024-01-01", 1), ("e", "2024-03-01", 1)]):
        arrive(spark, path, batch)
        found = days(spark, path, "state", watermark="7 days")
    # the January row of the last batch is beyond the watermark; the day itself stays in the result
    assert found == [("2024-01-01", 1, 1), ("2024-03-01", 2, 2), ("2024-03-02", 1, 1)]

"""Keyed state, its table of changes, the state table of phases, and progress rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.sources import state_table
from scriptorium.streaming import jobs, latest, progress

READS = T.StructType().add("novel_id", "long").add("chapter_id", "long").add("ts", "timestamp")
START = datetime(2024, 1, 1)


def land(spark, folder, rows, schema=READS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def written(spark, target):
    """Rows that each epoch wrote."""
    found = latest.maybe_read(spark, f"{target}/changes", "novel_id long, epoch long")
    return {r["epoch"]: r["count"] for r in found.groupBy("epoch").count().collect()}


def test_ten_batches_write_changed_keys_only(spark, tmp_path):
    landing, target, place = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/place"
    rng, seen, changes = random.Random(1), {}, []
    for batch in range(10):
        rows = [(rng.randrange(3), rng.randrange(8), START + timedelta(minutes=rng.randrange(60 * batch + 60))) for _ in range(12)]
        rows += [(7, 7, START + timedelta(days=batch))] * 30  # a hot pair
        rows += [(None, 1, START)] * (batch == 4) + [(1, 1, None)] * (batch == 5)
        before = dict(seen)
        for novel, chapter, ts in rows:
            key, old = (novel, chapter), seen.get((novel, chapter), "none")
            if old == "none" or (ts is not None and (old is None or ts > old)):
                seen[key] = ts
        changes.append(len(seen.keys() - before.keys()) + sum(before[k] != seen[k] for k in before))
        land(spark, landing, rows)
        stream = spark.readStream.schema(READS).parquet(landing)
        latest.run_latest(stream, ["novel_id", "chapter_id"], ["ts"], target, place)
        if batch == 6:
            assert latest.compact(spark, target, READS, ["novel_id", "chapter_id"], ["ts"]) == 6
    assert written(spark, target) == dict(enumerate(changes))
    got = latest.read_latest(spark, target, READS, ["novel_id", "chapter_id"], ["ts"])
    assert {(r["novel_id"], r["chapter_id"]): r["ts"] for r in got.collect()} == seen


def test_late_rows_and_a_batch_done_again(spark, tmp_path):
    """A row that is older than the state is not written; a second copy of a batch changes nothing."""
    landing, target, place = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/place"
    stream = lambda: spark.readStream.schema(READS).parquet(landing)
    land(spark, landing, [(1, 1, START + timedelta(hours=5))])
    jobs.reading_progress(stream(), target, place)
    land(spark, landing, [(1, 1, START), (1, 2, START + timedelta(hours=1))])
    assert [tuple(r) for r in jobs.reading_progress(stream(), target, place).collect()] == [(1, 2, 1)]
    assert written(spark, target) == {0: 1, 1: 1}
    # with its checkpoint lost, the stream reads all again and writes the same rows under other epochs
    assert [tuple(r) for r in jobs.reading_progress(stream(), target, f"{tmp_path}/other").collect()] == [(1, 2, 1)]


def test_state_with_a_time_to_live(spark, tmp_path):
    landing, target = f"{tmp_path}/in", f"{tmp_path}/out"
    land(spark, landing, [(1, 1, START)])
    stream = spark.readStream.schema(READS).parquet(landing)
    assert jobs.reading_progress(stream, target, f"{tmp_path}/place", ttl=timedelta(days=1)).count() == 1


STATES = T.StructType().add("id", "long").add("status", "string").add("error", "string")


@pytest.fixture
def table(spark, tmp_path):
    made = state_table.StateTable(spark, f"{tmp_path}/states", ["id"], STATES, buckets=16)
    made.upsert(spark.createDataFrame([(n, "raw", None) for n in range(100)] + [(None, "raw", None)], STATES), 0, "load")
    return made


def phase(rule):
    """A phase that is done with the ids that fit, and fails with number 13."""
    return lambda due: due.select("id", rule.alias("done"), F.when(F.col("id") == 13, "broken").alias("failed"))


def test_phases_resume_after_a_crash(spark, table):
    def crash(due):
        raise RuntimeError("lost")

    clean, json, html = (phase(F.col("id") < n) for n in (90, 50, 5))
    with pytest.raises(RuntimeError, match="lost"):
        state_table.run_phases(table, [("clean", clean), ("json", crash), ("html", html)])
    assert table.last_epoch() == 1
    counts = lambda df: {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    assert counts(table.read()) == {"clean": 89, "failed": 1, "raw": 11}
    assert state_table.run_phases(table, [("clean", crash), ("json", json), ("html", html)]) == ["json", "html"]
    assert counts(table.read()) == {"html": 5, "json": 44, "clean": 40, "render_failed": 1, "raw": 11}
    assert counts(table.read(as_of=1)) == {"clean": 89, "failed": 1, "raw": 11}
    assert table.read().where("id = 13").first()["error"] == "broken"
    assert state_table.run_phases(table, [("clean", crash), ("json", crash), ("html", crash)]) == []


def test_a_write_that_broke_off_is_not_seen(spark, table, monkeypatch):
    """Files of an epoch without its line in the log do not count, and are replaced when it is done again."""
    new = spark.createDataFrame([(1, "clean", None), (2, "clean", None)], STATES)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(state_table.StateTable, "_commit", lost)
        table.upsert(new, 1)
    assert spark.read.parquet(f"{table.path}/rows").where("epoch = 1").count() > 0
    assert table.last_epoch() == 0 and table.read().where("status = 'clean'").count() == 0
    table.upsert(new.where("id = 1"), 1)
    assert table.read().where("status = 'clean'").count() == 1 and table.read().count() == 101


def test_only_buckets_of_changed_keys_are_written(spark, table):
    table.upsert(spark.createDataFrame([(1, "clean", None), (1, "html", None), (500, "raw", "new")], STATES), 1)
    buckets = table.commits().where("epoch = 1").first()["buckets"]
    assert 1 <= len(buckets) <= 2
    stored = spark.read.parquet(f"{table.path}/rows")
    assert {r["bucket"] for r in stored.where("epoch = 1").select("bucket").distinct().collect()} == set(buckets)
    rows = {r["id"]: (r["status"], r["error"]) for r in table.read().collect()}
    assert len(rows) == 102 and rows[1] == ("html", None) and rows[500] == ("raw", "new") and rows[None] == ("raw", None)
    table.upsert(table.read().limit(0), 2)
    assert table.last_epoch() == 2 and table.read().count() == 102
    with pytest.raises(ValueError, match="not after"):
        table.upsert(table.read(), 2)


def test_batches_become_rows(spark, tmp_path):
    landing, path = f"{tmp_path}/in", f"{tmp_path}/progress"
    listener = progress.ProgressTable(spark, path, "reads")
    assert progress.batches(spark, path).count() == 0
    spark.streams.addListener(listener)
    try:
        for batch in range(2):
            land(spark, landing, [(batch, n, START) for n in range(3 + batch)])
            stream = spark.readStream.schema(READS).parquet(landing)
            job = stream.writeStream.queryName("reads").foreachBatch(lambda df, n: df.write.format("noop").mode("overwrite").save())
            job.option("checkpointLocation", f"{tmp_path}/place").trigger(availableNow=True).start().awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    rows = progress.batches(spark, path).orderBy("batch").collect()
    assert [(r["name"], r["batch"], r["rows"]) for r in rows] == [("reads", 0, 3), ("reads", 1, 4)]


def test_share_of_a_renaming(spark):
    rows = [("scripts", 1, 2, 0.35), ("scripts", 2, 2, 0.7), ("scripts", 0, 0, 0.0), ("glossary", 0, 0, 0.75), ("pages", 1, 2, 0.9), ("completed", 0, 0, 1.0), ("odd", 1, 1, None)]
    df = spark.createDataFrame(rows, "phase string, done long, total long, want double")
    got = df.select(progress.renaming_share(F.col("phase"), F.col("done"), F.col("total")).alias("got"), "want").collect()
    assert all(r["got"] is r["want"] or r["got"] == pytest.approx(r["want"]) for r in got)

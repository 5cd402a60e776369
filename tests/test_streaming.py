"""Streams over what is there give the rows of their batch forms."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quirefold.operators import jobs
from quirefold.sources import artifacts, files
from quirefold.streaming import jobs as streams


@pytest.fixture(scope="module")
def events(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("phase"), F.floor("value").alias("done"), F.lit(500).alias("total")
    )
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    # in order of time, as the watermark asks for
    rows.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path)


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_latest_progress(spark, events):
    path, batch = events
    stream = streams.latest_progress(streams.read_events(spark, path, batch.schema))
    got = streams.run_available(stream, "progress", "complete", fresh()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, jobs.latest_progress(batch).collect()))


EVENT = "job_id long, event_id long, ts timestamp, status string"


def hours(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def followed(spark, files, make, path=None):
    """Runs a stream once after each list of rows has come as files; the rows it appended and the rows of state after each run."""
    path, kept = path or fresh(), []
    for rows in files:
        spark.createDataFrame(rows, EVENT).repartition(2).write.mode("append").parquet(f"{path}/in")
        out = make(streams.read_events(spark, f"{path}/in", spark.createDataFrame([], EVENT).schema, 100))
        with streams.state_store(spark):
            run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
        kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()], kept


def test_invalid_transitions_of_late_and_repeated_events(spark):
    """Events come up to a day late, in no order and some of them twice; what is invalid is as in order of time, and the state doesn't grow with the events."""
    rng, states = random.Random(2), [*jobs.STATES, "error"]
    events = [(rng.randrange(5), i, hours(rng.uniform(0, 120)), rng.choice(states)) for i in range(180)]
    files = [[] for _ in range(3)]
    for e in events:
        at = (e[2] - hours(0)).total_seconds() / 3600
        k = min(2, int((at + rng.uniform(0, 23)) // 45))
        files[k].append(e)
        if k < 2 and rng.random() < 0.3:
            files[k + 1].append(e)
    got, kept = followed(spark, [*files, [(-1, 10**6, hours(900), "created")]], lambda s: streams.invalid_transitions(s, "24 hours"))
    want = jobs.transitions(spark.createDataFrame(events, EVENT)).where("not valid").select("job_id", "event_id", "prev", "cur").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, want)))
    # a status for each of five jobs, what the last day and a half of a file brought, and timers for them
    assert max(kept) < 150 and kept[-1] <= 3 * 6


def test_silent_jobs_are_forgotten(spark):
    files = [[(1, 1, hours(0), "created"), (1, 2, hours(1), "detect_bubbles_running"), (2, 3, hours(1), "created")], [(9, 4, hours(60), "created")], [(1, 5, hours(61), "await_edit"), (9, 6, hours(61), "created")], [(9, 7, hours(200), "created")]]
    kept_on, _ = followed(spark, files, lambda s: streams.invalid_transitions(s, "1 hour"))
    forgotten, rows = followed(spark, files, lambda s: streams.invalid_transitions(s, "1 hour", expire_ms=24 * 3600 * 1000))
    assert kept_on == [] and forgotten == [(1, 5, None, "await_edit")]
    assert rows[1] <= 3 * 2


def test_patch_progress(spark):
    rows = [(1, 1, 10, "a", 3), (1, 2, 10, "b", 10), (1, 2, 11, "error", 2), (2, 1, 5, "a", 10)]
    late = [(1, 2, 11, "error", 2), (1, 2, 9, "a", 1), (2, 1, 6, "error", 4), (1, 3, 1, "a", 10)]
    path, kind = fresh(), "job_id long, item long, event_id long, status string, done long"
    whole = lambda df: df.withColumn("ts", F.timestamp_seconds("event_id")).withColumn("total", F.lit(10))
    for part in (rows, late):
        spark.createDataFrame(part, kind).write.mode("append").parquet(f"{path}/in")
        out = streams.patch_progress(whole(streams.read_events(spark, f"{path}/in", spark.createDataFrame([], kind).schema, 100)))
        with streams.state_store(spark):
            run = out.writeStream.foreachBatch(streams.upsert(f"{path}/out")).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    got = streams.latest(spark, f"{path}/out", out.schema, "job_id").collect()
    want = jobs.patch_progress(whole(spark.createDataFrame({*rows, *late}, kind))).select(*out.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_online_eval(spark, events):
    path, batch = events
    shape = lambda df: df.select((F.col("event_id") % 3).alias("epoch"), F.col("phase").alias("metric"), (F.col("job_id") % 4).alias("bin"), F.col("done").cast("double").alias("value"))
    stream = streams.online_eval(shape(streams.read_events(spark, path, batch.schema)))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in streams.run_available(stream, "online", "complete", fresh()).collect()}
    want = shape(batch).groupBy("epoch", "metric", "bin").agg(F.count("value"), F.avg("value"), F.stddev_pop("value")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[tuple(r)[:3]] == pytest.approx(tuple(r)[3:], abs=1e-6)


def test_artifacts_on_disk(spark):
    rows = [("j1", "B1", "thorn", 5, 0.9, True), ("j1", "B2", "other", 2, None, None), ("j2", "B1", "elipse", 1, 0.4, False)]
    tidy = spark.createDataFrame(rows, "job_id string, bubble_id string, class string, class_id int, confidence double, definite boolean")
    path = fresh()
    artifacts.write_artifact(tidy, path, "bubble_classes")
    artifacts.write_artifact(tidy.where("job_id = 'j2'"), path, "bubble_classes")
    back = spark.read.schema("classes map<string,struct<class:string,class_id:int,confidence:double,definite:boolean>>, job_id string").json(path)
    assert {(r["job_id"], k, v["class"]) for r in back.collect() for k, v in r["classes"].items()} == {("j1", "B1", "thorn"), ("j1", "B2", "other"), ("j2", "B1", "elipse")}


def test_files(spark):
    path = fresh()
    head = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (690).to_bytes(4, "big") + (1800).to_bytes(4, "big")
    for name, content in (("a.png", head), ("b.png", b"no"), ("c.txt", b"x")):
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)
    got = {r["page_id"].rsplit("/", 1)[1]: (r["width"], r["height"], r["error"] is None) for r in files.page_dims(spark, path, files.png_size).collect()}
    assert got == {"a.png": (690, 1800, True), "b.png": (None, None, False)}
    assert files.list_files(spark, path, "*.txt").count() == 1
    assert streams.run_available(streams.ingest(spark, path), "pages", "append", fresh()).count() == 2
    out = fresh()
    files.split_shard(spark.range(25).repartition(1), f"{out}/parts", 10)
    assert spark.read.parquet(f"{out}/parts").count() == 25
    assert files.list_files(spark, f"{out}/parts", "*.parquet").count() == 3


def test_patch_progress_of_many_items(spark):
    """Items of several blocks, below 0 too, in two runs with late and repeated events."""
    rng = random.Random(4)
    events = [(i % 3, rng.randrange(-300, 900), i, rng.choice(["a", "error"]), rng.randrange(14)) for i in range(1500)]
    path, kind = fresh(), "job_id long, item long, event_id long, status string, done long"
    whole = lambda df: df.withColumn("ts", F.timestamp_seconds("event_id")).withColumn("total", F.lit(10))
    for part in (events[300:], events[:600]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(f"{path}/in")
        out = streams.patch_progress(whole(streams.read_events(spark, f"{path}/in", spark.createDataFrame([], kind).schema, 100)))
        with streams.state_store(spark):
            run = out.writeStream.foreachBatch(streams.upsert(f"{path}/out")).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
        # a row for each block of 256 items, and one for the sums, of three jobs
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * (6 + 1)
    got = streams.latest(spark, f"{path}/out", out.schema, "job_id").collect()
    want = jobs.patch_progress(whole(spark.createDataFrame(events, kind))).select(*out.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))

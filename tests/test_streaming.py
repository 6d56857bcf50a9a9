"""Streams give what their batch twins give."""

import random
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quarry.operators import ledgers
from quarry.streaming import feed


def written(spark, path, frames):
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_changes_are_delivered_once(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i, start + timedelta(seconds=i), "create", "/buckets/b1" if i % 2 else "/other", f"o{i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "seq long, ts timestamp, op string, dir string, name string")
    stream = written(spark, tmp_path / "in", [frame, frame])  # each event twice
    got = feed.run_to_table(feed.deliver_once(stream, "/buckets/b1"), "append").collect()
    assert sorted(r.seq for r in got) == [i for i in range(50) if i % 2]


def test_rate_limits_keep_their_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, i / 3) for i in range(300)]
    parts = [spark.createDataFrame(rows[a : a + 100], "host string, seq long, at double") for a in (0, 100, 200)]
    got = {tuple(r) for r in feed.run_to_table(feed.limit_rate(written(spark, tmp_path / "in", parts), 0.4, 3.0), "append").collect()}
    want = ledgers.token_bucket(spark.createDataFrame(rows, "host string, seq long, at double"), 0.4, 3.0)
    assert len(got) == 300 and got == {tuple(r) for r in want.collect()}


def test_batches_are_handed_on(spark, tmp_path):
    frame = spark.range(10).select(F.col("id").alias("seq"))
    out = str(tmp_path / "out")
    run = feed.replicate_to(written(spark, tmp_path / "in", [frame, frame]), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / uuid.uuid4().hex))
    run.awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(out).count() == 20


def test_nodes_report_and_go(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    kind = "node long, at timestamp, vids array<long>"
    parts = [spark.createDataFrame(r, kind) for r in ([(1, at(0), [3, 1]), (2, at(0), [5])], [(1, at(10), [1])], [(1, at(100), [1, 2])], [(1, at(200), [7])])]
    got = [(r.node, r.alive, r.vids) for r in feed.run_to_table(feed.track_nodes(written(spark, tmp_path / "in", parts)), "append").collect()]
    assert (1, True, "1,3") in got and (1, True, "1") in got and (1, True, "7") in got
    assert (2, True, "5") in got and (2, False, "") in got


def test_sessions(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    frame = spark.createDataFrame([(1, at(0)), (1, at(20)), (1, at(100)), (2, at(5))], "user_id long, ts timestamp")
    got = feed.run_to_table(feed.session_counts(written(spark, tmp_path / "in", [frame]), "30 seconds"), "complete").collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_events_in_part_files(spark, sf, tmp_path):
    from quarry import registry

    events = spark.read.parquet(f"{sf}/events.parquet")
    # in no order of time, more files than a batch used to take
    events.orderBy(F.xxhash64("event_id")).repartition(120).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["st3_subscribe_stream"](spark, str(tmp_path))
    want = registry.queries()["st3_subscribe_stream"](spark, sf)
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "LocalTableScan" not in got._jdf.queryExecution().optimizedPlan().toString() and got.inputFiles()


def test_a_feed_is_appended(spark, tmp_path):
    rows = [(i, op) for i, op in enumerate(["create", "update", "delete", "rename", "append"])]
    stream = written(spark, tmp_path / "in", [spark.createDataFrame(rows, "seq long, op string")])
    feed.append_to(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.seq, r.op) for r in got) == [(0, "create"), (2, "delete"), (3, "rename")] and all(r.append_at for r in got)


def test_a_job_runs_again_and_again(spark):
    import time

    ran = []
    query = feed.every(spark, "1 second", ran.append)
    until = time.monotonic() + 60
    while len(ran) < 2 and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()
    assert len(ran) >= 2


def test_a_batch_of_bounded_bytes(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    sizes = []
    query = feed.read_events(spark, str(tmp_path), bytes_per_trigger="1").writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sizes) == 6 and sum(sizes) == spark.read.parquet(f"{sf}/events.parquet").count()

"""The change feed as a stream: files in, watermarks and state in Spark's store, batches out.

State is bounded by watermarks (duplicates, windows) or by the number of keys (status, node reports)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.feeds import subscribe
from quarry.sources.shared import shared_folder


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int | None = None, bytes_per_trigger: str | None = None) -> DataFrame:
    """Events of the files of that name in a folder, or of the part files if it is a table's folder, and of those that come later.

    A batch takes so many files or bytes (such as "1g") at most.  Without a limit all files that are there make one batch: a table's files come in any order of time, and rows that
    come late across batches are dropped by watermarks."""
    path = f"{folder}/{files}"
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        read = read.option("maxFilesPerTrigger", per_trigger)
    if bytes_per_trigger:
        read = read.option("maxBytesPerTrigger", bytes_per_trigger)
    found = read.parquet(path) if _is_folder(spark, path) else read.option("pathGlobFilter", files).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def as_changes(events: DataFrame) -> DataFrame:
    """Events as changes of a namespace."""
    op = F.when(F.col("event_type").isin("purchase", "signup", "click"), F.lit("create")).otherwise(F.lit("delete"))
    return events.select(F.col("event_id").alias("seq"), "ts", op.alias("op"), F.concat(F.lit("/buckets/b"), F.col("user_id").cast("string")).alias("dir"), F.concat(F.lit("o"), (F.col("event_id") % 7).cast("string")).alias("name"))


def deliver_once(changes: DataFrame, prefix: str = "/", since: int = -1, late: str = "1 hour") -> DataFrame:
    """Changes below a prefix; those delivered again within the time are dropped."""
    return subscribe(changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"]), since, prefix)


def status_by(changes: DataFrame, by: str) -> DataFrame:
    return changes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """An extension: events of each kind in windows of event time."""
    w = F.window("ts", width, slide)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """An extension: sessions of each user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def replicate_to(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each batch's changes to apply(batch, batch id): it must be able to take a batch twice."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(changes: DataFrame, path: str, checkpoint: str):
    """The feed's log: creations, deletions and renames with the time they were appended, as Parquet, each once."""
    kept = changes.where(F.col("op").isin("create", "delete", "rename")).withColumn("append_at", F.current_timestamp())
    return kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def every(spark: SparkSession, interval: str, job: Callable[[int], None]):
    """A periodic job: job(n) on the driver at each interval, such as "1 hour", until the query it returns is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: job(n)).trigger(processingTime=interval).start()


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, run through, as a table: appended rows, which grow with the stream, in the shared folder; other
    modes' results, which are small, in memory."""
    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    if mode != "append":
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)
    out = f"{shared_folder(spark)}/{name}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def limit_rate(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests(host, seq, at): a token bucket for each host, its state kept between batches."""

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, at in zip(rows["seq"], rows["at"], strict=True):
            tokens = burst if last is None else min(burst, tokens + max(0.0, at - last) * rate)
            good = tokens >= 1
            tokens, last = tokens - good, float(at)
            out.append((key[0], int(seq), bool(good)))
        state.update((float(tokens), last))
        yield pd.DataFrame(out, columns=["host", "seq", "allowed"])

    return requests.groupBy("host").applyInPandasWithState(step, "host string, seq long, allowed boolean", "tokens double, last double", "append", "NoTimeout")


def track_nodes(reports: DataFrame, timeout: str = "30 seconds") -> DataFrame:
    """reports(node, at timestamp, vids array): the state of each node after each batch: its last report's volumes, and
    once the watermark passes its last report by the timeout, that it is gone."""
    seconds = int(timeout.split()[0])

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], False, "")], columns=["node", "alive", "vids"])
            return
        last, vids = state.get if state.exists else (-1, "")
        for frame in frames:
            for at, own in zip(frame["at"], frame["vids"], strict=True):
                ms = int(at.timestamp() * 1000)
                if ms >= last:
                    last, vids = ms, ",".join(str(v) for v in sorted(own))
        state.update((last, vids))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], True, vids)], columns=["node", "alive", "vids"])

    own = reports.withWatermark("at", "0 seconds").groupBy("node")
    return own.applyInPandasWithState(step, "node long, alive boolean, vids string", "last long, vids string", "append", "EventTimeTimeout")

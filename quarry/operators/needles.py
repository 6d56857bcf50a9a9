"""The append-only index of a volume: replay, garbage and compaction.

A log has a row for each write of a key, in order of pos; size 0 is a delete.  Volumes and keys are dealt together, so a
hot volume spreads over its keys; sums for a volume are added up in each task first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame) -> DataFrame:
    """The last record of each (vid, needle_key), deletes too."""
    last = log.groupBy("vid", "needle_key").agg(F.max_by(F.struct("pos", "size"), "pos").alias("r"))
    return last.select("vid", "needle_key", "r.pos", "r.size")


def live_needles(log: DataFrame) -> DataFrame:
    """What is not deleted, in physical order."""
    return replay(log).where("size > 0").orderBy("vid", "pos")


def append_tombstones(log: DataFrame, keys: DataFrame, first_pos: int) -> DataFrame:
    """The log with a delete for each live key of keys(vid, needle_key), numbered from first_pos by key; others change nothing."""
    live = replay(log).where("size > 0").join(keys.select("vid", "needle_key").distinct(), ["vid", "needle_key"], "left_semi")
    order = Window.partitionBy("vid").orderBy("needle_key")
    marks = live.select((F.lit(first_pos) + F.row_number().over(order) - 1).cast("long").alias("pos"), "vid", "needle_key", F.lit(0).cast("long").alias("size"))
    return log.select("pos", "vid", "needle_key", "size").unionByName(marks)


def index_stats(log: DataFrame) -> DataFrame:
    """Of each volume: live files, their bytes, deleted keys."""
    return replay(log).groupBy("vid").agg(F.count_if(F.col("size") > 0).alias("file_count"), F.sum("size").cast("long").alias("content_bytes"), F.count_if(F.col("size") == 0).alias("deleted_count"))


def deleted_bytes(log: DataFrame, overwrites: bool = False) -> DataFrame:
    """Bytes that each volume's deletes set free; with overwrites, also what new versions replaced."""
    before = F.lag("size").over(Window.partitionBy("vid", "needle_key").orderBy("pos"))
    freed = log.withColumn("before", before).where("before > 0" if overwrites else "before > 0 and size = 0")
    return freed.groupBy("vid").agg(F.sum("before").cast("long").alias("deleted_bytes"))


def garbage(log: DataFrame, overwrites: bool = False) -> DataFrame:
    """(vid, content_bytes, deleted_bytes, ratio): the share of deleted bytes, 0 for an empty volume."""
    both = index_stats(log).select("vid", "content_bytes").join(deleted_bytes(log, overwrites), "vid", "left").withColumn("deleted_bytes", F.coalesce("deleted_bytes", F.lit(0)).cast("long"))
    total = F.col("content_bytes") + F.col("deleted_bytes")
    return both.withColumn("ratio", F.when(total > 0, F.col("deleted_bytes") / total).otherwise(F.lit(0.0)))


def need_compaction(log: DataFrame, threshold: float) -> DataFrame:
    return garbage(log).where(F.col("ratio") >= threshold)


def compaction_report(log: DataFrame, ttl: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """What compaction would do to each volume: records read, written, dropped as deleted or overwritten, dropped as
    expired, and bytes before and after.  ttl(vid, needle_key, written_at, ttl_sec): for those that expire."""
    last = replay(log).select("vid", "needle_key", F.col("pos").alias("last_pos"))
    every = log.join(last, ["vid", "needle_key"])
    current = (F.col("pos") == F.col("last_pos")) & (F.col("size") > 0)
    if ttl is None:
        expired = F.lit(False)
    else:
        every = every.join(ttl.select("vid", "needle_key", "written_at", "ttl_sec"), ["vid", "needle_key"], "left")
        expired = F.coalesce((F.col("ttl_sec") > 0) & (F.lit(now) > F.col("written_at") + F.col("ttl_sec")), F.lit(False))
    kept = current & ~expired
    return every.groupBy("vid").agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(kept).alias("n_written"),
        F.count_if(~current).alias("n_deleted"),
        F.count_if(current & expired).alias("n_expired"),
        F.sum("size").cast("long").alias("bytes_before"),
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).cast("long").alias("bytes_after"),
    )


def read_needles(requests: DataFrame, log: DataFrame, cookies: DataFrame) -> DataFrame:
    """requests(request_id, vid, needle_key, cookie) against the live index: size, or an error."""
    live = replay(log).where("size > 0").select("vid", "needle_key", "size")
    known = live.join(cookies.select("vid", "needle_key", F.col("cookie").alias("own")), ["vid", "needle_key"])
    found = requests.join(known, ["vid", "needle_key"], "left")
    error = F.when(F.col("size").isNull(), F.lit("not found")).when(F.col("own") != F.col("cookie"), F.lit("cookie mismatch"))
    return found.select("request_id", "vid", "needle_key", F.when(error.isNull(), F.col("size")).alias("size"), error.alias("error"))

"""Queries over the index of blobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import needles as ops
from quarry.plans.catalog import query

_LAST = "last as (select vid, needle_key, max(pos) as pos, arg_max(size, pos) as size from f_needle_log group by vid, needle_key)"
_GARBAGE = f"""{_LAST}, freed as (select vid, sum(before) as d from (select vid, size, lag(size) over (partition by vid, needle_key order by pos) as before from f_needle_log) where size = 0 and before > 0 group by vid),
content as (select vid, sum(size) as c from last group by vid),
garbage as (select content.vid, cast(c as bigint) as content_bytes, cast(coalesce(d, 0) as bigint) as deleted_bytes, case when c + coalesce(d, 0) > 0 then cast(coalesce(d, 0) as double) / cast(c + coalesce(d, 0) as double) else 0.0 end as ratio from content left join freed on content.vid = freed.vid)"""


@query("a1_replay", f"with {_LAST} select vid, needle_key, pos, size from last")
def _(t):
    return ops.replay(t("f_needle_log"))


@query("s4_live_needles", f"with {_LAST} select vid, needle_key, pos, size from last where size > 0 order by vid, pos")
def _(t):
    return ops.live_needles(t("f_needle_log"))


@query("a2_index_stats", f"with {_LAST} select vid, count(*) filter (size > 0) as file_count, cast(sum(size) as bigint) as content_bytes, count(*) filter (size = 0) as deleted_count from last group by vid")
def _(t):
    return ops.index_stats(t("f_needle_log"))


@query("a3_garbage", f"with {_GARBAGE} select * from garbage")
def _(t):
    return ops.garbage(t("f_needle_log"))


@query("p17_need_compaction", f"with {_GARBAGE} select * from garbage where ratio >= 0.1")
def _(t):
    return ops.need_compaction(t("f_needle_log"), 0.1)


_TTL = "ttl as (select distinct vid, needle_key, 1704067200 - (needle_key % 50) * 86400 as written_at, (needle_key % 3) * 864000 as ttl_sec from f_needle_log)"


@query(
    "a4_compaction_report",
    f"""with {_LAST}, {_TTL}, every as (select l.vid, l.size, l.pos = last.pos and l.size > 0 as cur, ttl_sec > 0 and 1704067200 > written_at + ttl_sec as old
      from f_needle_log l join last on l.vid = last.vid and l.needle_key = last.needle_key join ttl on l.vid = ttl.vid and l.needle_key = ttl.needle_key)
    select vid, count(*) as n_read, count(*) filter (cur and not old) as n_written, count(*) filter (not cur) as n_deleted, count(*) filter (cur and old) as n_expired,
      cast(sum(size) as bigint) as bytes_before, cast(coalesce(sum(size) filter (cur and not old), 0) as bigint) as bytes_after from every group by vid""",
)
def _(t):
    log = t("f_needle_log")
    ttl = log.select("vid", "needle_key").distinct().selectExpr("vid", "needle_key", "1704067200 - (needle_key % 50) * 86400 as written_at", "(needle_key % 3) * 864000 as ttl_sec")
    return ops.compaction_report(log, ttl, 1704067200)


@query(
    "k5_tombstones",
    f"""with {_LAST}, dead as (select vid, needle_key from last where size > 0 and needle_key % 5 = 0), marks as (select 1000000 + row_number() over (partition by vid order by needle_key) - 1 as pos, vid, needle_key, 0 as size from dead)
    select vid, count(*) as n, cast(sum(size) as bigint) as bytes, max(pos) as last_pos from (select pos, vid, needle_key, size from f_needle_log union all select * from marks) group by vid""",
)
def _(t):
    log = t("f_needle_log")
    marked = ops.append_tombstones(log, log.where("needle_key % 5 = 0").select("vid", "needle_key"), 1_000_000)
    return marked.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"), F.max("pos").alias("last_pos"))


@query(
    "s11_read_needles",
    f"""with {_LAST}, req as (select pos as request_id, vid, needle_key + pos % 2 * 100000 * (case when pos % 7 = 0 then 1 else 0 end) as needle_key, needle_key * 31 % 65536 + (case when pos % 5 = 0 then 1 else 0 end) as cookie from f_needle_log)
    select request_id, r.vid, r.needle_key, case when l.size is null or cookie <> r.needle_key * 31 % 65536 then null else l.size end as size,
      case when l.size is null then 'not found' when cookie <> r.needle_key * 31 % 65536 then 'cookie mismatch' end as error
    from req r left join (select * from last where size > 0) l on r.vid = l.vid and r.needle_key = l.needle_key""",
)
def _(t):
    log = t("f_needle_log")
    requests = log.selectExpr("pos as request_id", "vid", "needle_key + pos % 2 * 100000 * (case when pos % 7 = 0 then 1 else 0 end) as needle_key", "needle_key * 31 % 65536 + (case when pos % 5 = 0 then 1 else 0 end) as cookie")
    cookies = log.select("vid", "needle_key").distinct().withColumn("cookie", F.col("needle_key") * 31 % 65536)
    return ops.read_needles(requests, log, cookies)


@query("l7_physical_order", f"with {_LAST} select vid, needle_key, row_number() over (partition by vid order by pos) as place from last where size > 0")
def _(t):
    from pyspark.sql import Window

    return ops.live_needles(t("f_needle_log")).select("vid", "needle_key", F.row_number().over(Window.partitionBy("vid").orderBy("pos")).cast("long").alias("place"))

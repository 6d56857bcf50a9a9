"""Queries over ledgers, sequences and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.codes import backoff_ms, percent_done
from quarry.operators import ledgers as ops
from quarry.plans.catalog import query
from quarry.sources.tables import NOW


def _files(t):
    return t("f_entries").select(F.concat(F.lit("1,"), F.col("inode").cast("string")).alias("fid"), F.col("inode").alias("seq"), "content")


@query("a6_dedup_contents", "select sha256(content) as hash, count(*) as refs, arg_min('1,' || inode, inode) as fid from f_entries group by 1")
def _(t):
    return ops.dedup_contents(_files(t))


@query("j12_lookup_contents", "with x as (select sha256(content) as hash, arg_min('1,' || inode, inode) as fid from f_entries where inode % 2 = 0 group by 1) select '1,' || inode as fid, coalesce(x.fid, '1,' || inode) as stored_as, x.fid is not null as hit from f_entries left join x on sha256(content) = hash where inode % 2 = 1")
def _(t):
    f = _files(t)
    return ops.lookup_contents(f.where("seq % 2 = 1"), ops.dedup_contents(f.where("seq % 2 = 0")))


@query(
    "a7_drop_references",
    """with r as (select sha256(content) as hash, count(*) as refs, arg_min('1,' || inode, inode) as fid from f_entries group by 1), d as (select fid, 1 + (refs % 2) as gone from r where length(fid) % 2 = 0)
    select r.fid, cast(refs - coalesce(gone, 0) as bigint) as refs from r left join d on r.fid = d.fid where refs - coalesce(gone, 0) > 0""",
)
def _(t):
    refs = ops.dedup_contents(_files(t)).select("fid", "refs")
    drops = refs.where("length(fid) % 2 = 0").select("fid", F.explode(F.sequence(F.lit(1), 1 + F.col("refs") % 2))).select("fid")
    return ops.references(refs, drops)


@query(
    "w4_quota_ledger",
    """with s as (select seq, user_id, delta, sum(delta) over (partition by user_id order by seq) as s from f_quota_log)
    select seq, user_id, delta, cast(s - least(0, min(s) over (partition by user_id order by seq)) as bigint) as used from s""",
)
def _(t):
    return ops.quota_ledger(t("f_quota_log"))


@query(
    "w5_quota_check",
    """with u as (select user_id, sum(greatest(delta, 0)) as used from f_quota_log where seq < 5000 group by user_id)
    select seq as request_id, q.user_id, not coalesce(q.user_id % 3 > 0 and used + abs(delta) > q.user_id % 3 * 40000, false) as admitted from f_quota_log q left join u on q.user_id = u.user_id where seq >= 5000""",
)
def _(t):
    log = t("f_quota_log")
    quotas = log.where("seq < 5000").groupBy("user_id").agg(F.sum(F.greatest("delta", F.lit(0))).alias("used_bytes")).withColumn("max_bytes", F.col("user_id") % 3 * 40000)
    return ops.quota_check(log.where("seq >= 5000").select(F.col("seq").alias("request_id"), "user_id", F.abs("delta").alias("bytes")), quotas)


@query(
    "w5_admit",
    """with recursive l as (select user_id, seq, abs(delta) as b, row_number() over (partition by user_id order by seq) as k from f_quota_log),
    r as (select user_id, seq, k, b <= 50000 as admitted, case when b <= 50000 then b else 0 end as used from l where k = 1
      union all select l.user_id, l.seq, l.k, r.used + b <= 50000, r.used + case when r.used + b <= 50000 then b else 0 end from r join l on l.user_id = r.user_id and l.k = r.k + 1)
    select user_id, seq, admitted, cast(used as bigint) as used from r""",
)
def _(t):
    return ops.admit(t("f_quota_log").select("user_id", "seq", F.abs("delta").alias("bytes")), 50_000)


@query(
    "w11_token_bucket",
    """with recursive l as (select 'h' || user_id % 20 as host, event_id as seq, event_id / 10.0::double as t, row_number() over (partition by user_id % 20 order by event_id) as k from events),
    r as (select host, seq, k, t, 5.0::double as had, true as allowed from l where k = 1
      union all select host, seq, k, t, had, had >= 1 from (select l.host, l.seq, l.k, l.t, least(5.0::double, r.had - (case when r.allowed then 1 else 0 end) + greatest(0.0::double, l.t - r.t) * 0.3::double) as had from r join l on l.host = r.host and l.k = r.k + 1))
    select host, seq, allowed from r""",
)
def _(t):
    return ops.token_bucket(t("events").select(F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_id").alias("seq"), (F.col("event_id") / 10.0).alias("at")), 0.3, 5.0)


@query(
    "w12_simulate_cache",
    """with recursive l as (select user_id % 4 as cache, event_id as seq, event_id * 7919 % 113 as x, row_number() over (partition by user_id % 4 order by event_id) as k from events),
    r as (select cache, seq, k, false as hit, 0::bigint as evicted, [x] as held from l where k = 1
      union all select cache, seq, k, was, case when was then 0 else len(h) - len(kept) end, kept from (
        select *, case when was then h else list_filter(h, lambda y, i: list_sum(list_transform(h[i:], lambda z: z * 10 + 5)) <= 20000) end as kept from (
          select l.cache, l.seq, l.k, list_contains(r.held, l.x) as was, list_append(list_filter(r.held, lambda y: y <> l.x), l.x) as h from r join l on l.cache = r.cache and l.k = r.k + 1)))
    select cache, seq, hit, cast(evicted as bigint) as evicted, cast(list_sum(list_transform(held, lambda z: z * 10 + 5)) as bigint) as used from r""",
)
def _(t):
    return ops.simulate_cache(t("events").select((F.col("user_id") % 4).alias("cache"), F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 113).alias("item"), (F.col("event_id") * 7919 % 113 * 10 + 5).alias("size")), 20_000)


@query(
    "w13_copy_progress",
    """with recursive l as (select user_id % 10 as copy_id, seq, abs(delta) as b, row_number() over (partition by user_id % 10 order by seq) as k from f_quota_log),
    r as (select copy_id, seq, k, b as done, least(100, b * 100 // 1000000) as pct, least(100, b * 100 // 1000000) >= 5 as emits, case when b * 100 // 1000000 >= 5 then least(100, b * 100 // 1000000) else 0 end as shown from l where k = 1
      union all select copy_id, seq, k, done, pct, pct >= shown + 5 or (pct = 100 and shown <> 100), case when pct >= shown + 5 or (pct = 100 and shown <> 100) then pct else shown end
        from (select l.copy_id, l.seq, l.k, r.done + l.b as done, least(100, (r.done + l.b) * 100 // 1000000) as pct, r.shown from r join l on l.copy_id = r.copy_id and l.k = r.k + 1))
    select copy_id, seq, cast(pct as bigint) as percent from r where emits""",
)
def _(t):
    return ops.copy_progress(t("f_quota_log").select((F.col("user_id") % 10).alias("copy_id"), "seq", F.abs("delta").alias("bytes"), F.lit(1_000_000).cast("long").alias("total")))


@query("w3_allocate_ids", "select user_id % 5 as stream, event_id as seq, greatest(event_id % 4, 1) as n, cast(1 + coalesce(sum(greatest(event_id % 4, 1)) over (partition by user_id % 5 order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_id from events")
def _(t):
    return ops.allocate_ids(t("events").selectExpr("user_id % 5 as stream", "event_id as seq", "event_id % 4 as n"))


@query(
    "w3_saved_ceilings",
    """with recursive l as (select user_id % 5 as stream, event_id as seq, greatest(1, event_id % 4) as n, row_number() over (partition by user_id % 5 order by event_id) as k from events),
    r as (select stream, seq, k, n as cur, 100 + n as ceiling from l where k = 1
      union all select l.stream, l.seq, l.k, r.cur + n, case when r.cur + n > r.ceiling then r.cur + 100 + n else r.ceiling end from r join l on l.stream = r.stream and l.k = r.k + 1)
    select stream, seq, cast(ceiling as bigint) as ceiling from r""",
)
def _(t):
    return ops.saved_ceilings(t("events").selectExpr("user_id % 5 as stream", "event_id as seq", "event_id % 4 as n"), 100)


@query(
    "w6_snowflake_ids",
    """select event_id as request_id, case when k < 4096 then (1700000000000 + event_id // 40) * 4194304 + (user_id % 3) * 4096 + k end as id, k >= 4096 as over
    from (select event_id, user_id, row_number() over (partition by user_id % 3, event_id // 40 order by event_id) - 1 as k from events)""".replace("as over", 'as "over"'),
)
def _(t):
    return ops.snowflake_ids(t("events").selectExpr("event_id as request_id", "user_id % 3 as node", "1700000000000 + cast(floor(event_id / 40) as bigint) as ms"))


@query("w7_chunk_layout", 'select file_id, o as "offset", least(65536, file_size - o) as size from (select file_id, file_size, unnest(range(0, file_size, 65536)) as o from f_files where file_size > 65536)')
def _(t):
    return ops.chunk_layout(t("f_files"), 65536, 65536)


@query("w8_reassemble", "select upload_id, string_agg(data, '' order by part_number) as data, count(*) as n_parts from f_parts group by upload_id")
def _(t):
    return ops.reassemble(t("f_parts"), "upload_id", "part_number")


_ASKED = """asked as (select upload_id, part_number, case when part_number % 7 = 3 then 'other' else etag end as etag from f_parts union all select upload_id, part_number, etag from f_parts where upload_id % 10 = 1 and part_number = 1
  union all select upload_id, 99, 'x' from f_parts where part_number = 0 and upload_id % 5 = 0)"""


@query(
    "j14_complete_multipart",
    f"""with {_ASKED}, w as (select *, count(*) over (partition by upload_id, part_number) > 1 as twice, max(part_number) over (partition by upload_id) as top from asked)
    select w.upload_id, cast(w.part_number as integer) as part_number, case when twice then 'duplicate part' when p.etag is null then 'missing part' when p.etag <> w.etag then 'etag mismatch' when w.part_number < top and size < 300 then 'too small' end as error
    from w left join f_parts p on w.upload_id = p.upload_id and w.part_number = p.part_number""",
)
def _(t):
    p = t("f_parts").withColumn("part_number", F.col("part_number").cast("int"))
    asked = p.select("upload_id", "part_number", F.when(F.col("part_number") % 7 == 3, F.lit("other")).otherwise(F.col("etag")).alias("etag"))
    asked = asked.unionByName(p.where("upload_id % 10 = 1 and part_number = 1").select("upload_id", "part_number", "etag"))
    asked = asked.unionByName(p.where("part_number = 0 and upload_id % 5 = 0").select("upload_id", F.lit(99).alias("part_number"), F.lit("x").alias("etag")))
    return ops.complete_multipart(asked, p, 300)


@query("w9_duplicate_parts", f"with {_ASKED} select upload_id, cast(part_number as integer) as part_number, count(*) as n from asked group by upload_id, part_number having count(*) > 1")
def _(t):
    p = t("f_parts").withColumn("part_number", F.col("part_number").cast("int"))
    asked = p.select("upload_id", "part_number").unionByName(p.where("upload_id % 10 = 1 and part_number = 1").select("upload_id", "part_number"))
    return asked.groupBy("upload_id", "part_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("w10_small_parts", "select upload_id, part_number, size from (select *, lead(part_number) over (partition by upload_id order by part_number) as after from f_parts) where after is not null and size < 300")
def _(t):
    from pyspark.sql import Window

    p = t("f_parts").withColumn("after", F.lead("part_number").over(Window.partitionBy("upload_id").orderBy("part_number")))
    return p.where("after is not null and size < 300").select("upload_id", "part_number", "size")


@query("w14_backoff", "select attempt, cast(least(30000, 500 * pow(2, attempt)) as bigint) as wait_ms from range(0, 12) r(attempt)")
def _(t):
    return t("region").sparkSession.range(12).select(F.col("id").alias("attempt"), backoff_ms(F.col("id")).alias("wait_ms"))


@query("w15_deal_in_turn", "select upload_id, part_number, (row_number() over (partition by upload_id order by part_number) - 1) % 13 as shard from f_parts")
def _(t):
    return ops.deal_in_turn(t("f_parts").withColumn("seq", F.col("part_number")), "upload_id", 13).select("upload_id", "part_number", "shard")


_RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@query(
    "a12_latency_report",
    "with o as (select op, latency_ns, row_number() over (partition by op order by latency_ns) - 1 as k, count(*) over (partition by op) as n from f_samples where ok) select op, count(*) as n_ok, "
    + ", ".join(f"max(latency_ns) filter (k = floor((n - 1) * {p})) as {name}" for name, p in _RANKS.items())
    + ", count(*) / 60.0::double as qps from o group by op",
)
def _(t):
    return ops.latency_report(t("f_samples"), "op", _RANKS, 60.0)


@query("a13_counters", "select op, ok, count(*) as total from f_samples group by op, ok")
def _(t):
    return ops.counters(t("f_samples"), ["op", "ok"])


@query("a13_bytes_by_volume", "select vid, cast(sum(size) as bigint) as total from f_needle_log group by vid")
def _(t):
    return ops.counters(t("f_needle_log"), ["vid"], F.col("size"))


@query(
    "a14_histogram",
    "with b as (select unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0])::double as le union all select null) select op, le, count(*) filter (le is null or latency_ns / 1e8 <= le) as n from f_samples, b group by op, le",
)
def _(t):
    return ops.histogram(t("f_samples"), "op", F.col("latency_ns") / 1e8)


@query(
    "a15_replay_commands",
    "select max(event_id * 7 % 1000) filter (user_id % 3 = 0) as max_file_id, max(event_id * 11 % 777) filter (user_id % 3 = 1) as max_volume_id, arg_max('t' || event_id, event_id) filter (user_id % 3 = 2) as topology_id from events",
)
def _(t):
    log = t("events").selectExpr("event_id as pos", "case user_id % 3 when 0 then 'max_file_id' when 1 then 'max_volume_id' else 'topology_id' end as kind", "case user_id % 3 when 0 then event_id * 7 % 1000 else event_id * 11 % 777 end as number", "concat('t', event_id) as text")
    return ops.replay_commands(log)


@query(
    "a16_commit_index",
    """with m as (select event_id // 5 as r, event_id % 5 as peer, event_id * 7919 % 40 as i from events), k as (select r, list_sort(list(i), 'DESC')[len(list(i)) // 2 + 1] as reached, 3 + r % 3 as term from m group by r)
    select r as round, coalesce((select max(x) from range(1, 41) t(x) where x <= reached and 1 + x // 10 = term), 0) as commit_index from k""",
)
def _(t):
    m = t("events").selectExpr("cast(floor(event_id / 5) as bigint) as round", "event_id % 5 as peer", "event_id * 7919 % 40 as match_index").withColumn("current_term", 3 + F.col("round") % 3)
    terms = m.select("round").distinct().select("round", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("log_index")).withColumn("term", 1 + F.floor(F.col("log_index") / 10))
    return ops.commit_index(m, terms)


@query("a17_totals", "select count(*) as n, cast(sum(file_size) as bigint) as bytes, count(*) filter (inode % 9 <> 0) as n_ok, count(*) filter (inode % 9 = 0) as n_failed from f_entries")
def _(t):
    return ops.totals(t("f_entries"), F.col("inode") % 9 != 0, F.col("file_size"))


@query("a19_registry", 'select id, "at", arg_max(address, "at") as address, 1704067200 - "at" < 30 as alive from (select user_id as id, max(1704067200 - event_id % 60) over (partition by user_id) as "at", 1704067200 - event_id % 60 as own, \'a\' || (event_id % 60) as address from events) where own = "at" and "at" >= 1704067170 group by id, "at"')
def _(t):
    seen = t("events").selectExpr("user_id as id", "1704067200 - event_id % 60 as at", "concat('a', event_id % 60) as address")
    return ops.registry(seen, NOW)


@query("a22_first_occurrences", "select event_type, min(event_id) as event_id from events group by event_type")
def _(t):
    return ops.first_occurrences(t("events").select("event_type", "event_id"), "event_type", "event_id")


@query("f26_percent_done", "select event_id, cast(least(100, greatest(0, floor(event_id * 100 / 7777))) as bigint) as percent from events")
def _(t):
    return t("events").select("event_id", percent_done(F.col("event_id"), F.lit(7777)).alias("percent"))

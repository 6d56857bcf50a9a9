"""Queries over the change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import feeds as ops
from quarry.plans.catalog import QUERIES, ORACLES, query
from quarry.sources.tables import NOW, oracle


def _feed(t):
    return t("f_feed").withColumn("path", F.concat_ws("/", "dir", "name")).withColumn("ts_ns", (F.lit(NOW - 20_000) + F.col("seq")) * 1_000_000_000)


@query("s16_read_feed", "select seq, op, dir, name from f_feed where seq > 4000 and starts_with(dir, '/buckets/b1')")
def _(t):
    return ops.subscribe(t("f_feed"), 4000, "/buckets/b1")


@query("st3_subscribe_directory", "select seq, op, dir, name from f_feed where seq > 100 and dir = '/buckets/b1'")
def _(t):
    return ops.subscribe(t("f_feed"), 100, "/buckets/b1", boundary=True)


@query("st1_cursor", 'select max(seq) + 1 as "cursor" from f_feed where seq > 4000')
def _(t):
    return ops.cursor(ops.subscribe(t("f_feed"), 4000))


@query("st4_classify", "select seq, case seq % 4 when 0 then 'create' when 1 then 'delete' when 2 then 'rename' else 'update' end as op from f_feed")
def _(t):
    f = t("f_feed")
    k = F.col("seq") % 4
    old, new = F.when(k > 0, F.lit("/a")), F.when(k == 0, F.lit("/a")).when(k == 2, F.lit("/b")).when(k == 3, F.lit("/a"))
    return f.select("seq", ops.classify(old, new).alias("op"))


@query("st4_parse_record", "select seq, case seq % 3 when 0 then 'rename' else op end as op, case when seq % 3 = 0 or op = 'delete' then dir end as old, case when seq % 3 = 0 then name when op = 'create' then dir end as new from f_feed")
def _(t):
    f = t("f_feed")
    record = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("rename:"), "dir", F.lit("->"), "name")).otherwise(F.concat_ws(":", "op", "dir"))
    return f.select("seq", ops.parse_record(record).alias("r")).select("seq", "r.*")


_SIDES = """feed as (select *, dir || '/' || name as path, (1704047200 + seq) * 1000000000 as ts_ns from f_feed), e as (select path, arg_max(op, seq) as op, max(ts_ns) as ts_ns from feed group by path),
target as (select path, 1704047200 + max(seq) - 3000 + (min(seq) % 7) * 1500 as mtime from feed where seq % 3 <> 0 group by path), source as (select path, 1704047200 + max(seq) as mtime from feed where op = 'create' group by path)"""
_RESULT = """done as (select e.path, op, ts_ns, case when op = 'delete' then case when t.mtime is null then 'ok' when t.mtime * 1000000000 > ts_ns then 'skipped_stale' else 'ok' end
   when s.mtime is null then 'error' when t.mtime > s.mtime then 'skipped_stale' else 'ok' end as status, t.mtime as t, s.mtime as s from e left join target t on e.path = t.path left join source s on e.path = s.path)"""


def _sides(t):
    f = _feed(t)
    target = f.where("seq % 3 <> 0").groupBy("path").agg((F.lit(NOW - 20_000) + F.max("seq") - 3000 + (F.min("seq") % 7) * 1500).alias("mtime"))
    source = f.where("op = 'create'").groupBy("path").agg((F.lit(NOW - 20_000) + F.max("seq")).alias("mtime"))
    return target, source, f.select("path", "seq", "op", "ts_ns")


@query("st5_replicate", f"with {_SIDES}, {_RESULT} select path, op, ts_ns, status, case when status <> 'ok' then t when op <> 'delete' then s end as mtime from done")
def _(t):
    return ops.replicate(*_sides(t))


@query("j11_merged", f"with {_SIDES} select coalesce(s.path, t.path) as path, case when coalesce(t.mtime > s.mtime, s.mtime is null) then t.mtime else s.mtime end as mtime, case when coalesce(t.mtime > s.mtime, s.mtime is null) then 'target' else 'source' end as origin from source s full join target t on s.path = t.path")
def _(t):
    target, source, _ = _sides(t)
    return ops.merged(target, source)


@query(
    "a18_replication_status",
    f"""with {_SIDES}, {_RESULT}, d as (select *, 'dc' || length(path) % 3 as target, case when status = 'error' then 'no source for ' || path end as error from done)
    select target, count(*) filter (status = 'ok') as replicated, max(ts_ns) as last_ts_ns, cast(max(greatest(0, 1704067200000000000 - ts_ns)) as bigint) as max_lag_ns, arg_max(error, ts_ns) filter (error is not null) as last_error from d group by target""",
)
def _(t):
    done = ops.replicate(*_sides(t)).withColumn("target", F.concat(F.lit("dc"), (F.length("path") % 3).cast("string"))).withColumn("error", F.when(F.col("status") == "error", F.concat(F.lit("no source for "), "path")))
    return ops.replication_status(done, NOW * 1_000_000_000)


@query("st7_reconcile_reports", "with r as (select node, (vid + node) % 5 as seq, vid, vid % 3 = 0 as read_only from f_topology) select r.node, r.seq, vid, read_only from r join (select node, max(seq) as seq from r group by node) l on r.node = l.node and r.seq = l.seq")
def _(t):
    return ops.reconcile_reports(t("f_topology").selectExpr("node", "(vid + node) % 5 as seq", "vid", "vid % 3 = 0 as read_only"))


@query("st8_alive", "select user_id as node, max(1704067200 - event_id % 100) as last_seen, 1704067200 - max(1704067200 - event_id % 100) < 30 as alive from events group by user_id")
def _(t):
    return ops.alive(t("events").selectExpr("user_id as node", "1704067200 - event_id % 100 as at"), NOW)


@query(
    "st9_locks",
    """with recursive l as (select 'lock' || user_id % 9 as name, event_id as seq, event_id % 6 = 5 as unlocks, 'o' || event_id % 3 as own, case when event_id % 4 = 0 then 't' || (event_id - 9) else '' end as tok,
      row_number() over (partition by user_id % 9 order by event_id) as k from events),
    s as (select name, seq, k, null::varchar as held, 0::bigint as until_, null::varchar as htok, unlocks, own, tok from l where k = 1
      union all select l.name, l.seq, l.k, case when granted then s.own when freed then null else s.held end, case when granted then s.seq + 40 else s.until_ end, case when granted then 't' || s.seq when freed then null else s.htok end, l.unlocks, l.own, l.tok
        from (select *, not unlocks and not coalesce(held is not null and until_ > seq and ((held <> own and htok <> tok) or (tok <> '' and htok <> tok)), false) as granted, unlocks and held is not null and htok = tok as freed from s) s
        join l on l.name = s.name and l.k = s.k + 1)
    select name, seq, case when unlocks then case when held is null then 'not found' when htok <> tok then 'not owner' else 'released' end
        when held is not null and until_ > seq and held <> own and htok <> tok then 'held' when held is not null and until_ > seq and tok <> '' and htok <> tok then 'not owner' else 'acquired' end as outcome,
      case when unlocks then null when held is not null and until_ > seq and held <> own and htok <> tok then held when held is not null and until_ > seq and tok <> '' and htok <> tok then null else own end as owner,
      case when unlocks then null when coalesce(held is not null and until_ > seq and ((held <> own and htok <> tok) or (tok <> '' and htok <> tok)), false) then null else 't' || seq end as token
    from s""",
)
def _(t):
    e = t("events")
    return ops.locks(e.selectExpr("concat('lock', user_id % 9) as name", "event_id as seq", "event_id as at", "case when event_id % 6 = 5 then 'unlock' else 'lock' end as kind", "concat('o', event_id % 3) as owner", "case when event_id % 4 = 0 then concat('t', event_id - 9) end as token", "cast(40 as bigint) as ttl"))


def _streamed(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLES[name] = oracle(sql)
        return run

    return add


@_streamed("st6_status_stream", "select op, count(*) as n, max(seq) as last_seq from f_feed group by op")
def _(spark, sf_dir):
    from quarry.streaming import feed

    changes = feed.read_events(spark, sf_dir)
    return feed.run_to_table(feed.status_by(feed.as_changes(changes), "op"), "complete")


@_streamed("st3_subscribe_stream", "select seq, op, dir, name from f_feed where starts_with(dir, '/buckets/b1')")
def _(spark, sf_dir):
    from quarry.streaming import feed

    changes = feed.as_changes(feed.read_events(spark, sf_dir))
    return feed.run_to_table(feed.deliver_once(changes, "/buckets/b1").select("seq", "op", "dir", "name"), "append")


@_streamed("x3_window_counts_stream", "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, sf_dir):
    from quarry.streaming import feed

    return feed.run_to_table(feed.window_counts(feed.read_events(spark, sf_dir), "1 hour"), "complete")

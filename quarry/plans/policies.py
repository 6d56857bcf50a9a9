"""Queries over policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import policies as ops
from quarry.plans.catalog import query
from quarry.sources.tables import NOW


def _paths(t):
    return t("f_entries").select(F.concat_ws("/", "dir", "name").alias("path"), "mtime_sec", "disk_type", "inode")


_RULE_HITS = """o as (select dir || '/' || name as path, mtime_sec from f_entries), hit as (select path, rule_idx, storage_class,
  expire_days > 0 and mtime_sec < 1704067200 - expire_days * 86400 as dies, transition_days > 0 and mtime_sec < 1704067200 - transition_days * 86400 as moves
  from o join f_lifecycle_rules r on starts_with(path, prefix) where status = 'Enabled')"""


@query(
    "j3_lifecycle",
    f"""with {_RULE_HITS}, ends as (select path, min(rule_idx) filter (dies) as e from hit group by path),
    last_step as (select h.path, arg_max(storage_class, rule_idx) as sc from hit h join ends on h.path = ends.path where moves and (e is null or rule_idx < e) group by h.path)
    select o.path, sc as storage_class, case when e is not null then 'delete' when sc is not null then 'transition' else 'keep' end as action
    from o left join ends on o.path = ends.path left join last_step s on o.path = s.path""",
)
def _(t):
    return ops.lifecycle(_paths(t), t("f_lifecycle_rules"), NOW)


_TAG_RULES = [(0, "/buckets/src1", 30, 0, "", "Enabled", "disk", "ssd"), (1, "/buckets/", 0, 60, "STANDARD_IA", "Enabled", None, None), (2, "/buckets/", 300, 0, "", "Enabled", "disk", "hdd"), (3, "/buckets/", 0, 200, "GLACIER", "Enabled", "disk", "ssd"), (4, "/buckets/src2", 1, 0, "", "Enabled", "owner", "nobody")]


@query(
    "j3_lifecycle_tags",
    """with rules as (select * from (values (0, '/buckets/src1', 30, 0, '', 'ssd'), (1, '/buckets/', 0, 60, 'STANDARD_IA', null), (2, '/buckets/', 300, 0, '', 'hdd'), (3, '/buckets/', 0, 200, 'GLACIER', 'ssd')) as t(rule_idx, prefix, expire_days, transition_days, storage_class, disk)),
    o as (select dir || '/' || name as path, mtime_sec, disk_type from f_entries),
    hit as (select path, rule_idx, storage_class, expire_days > 0 and mtime_sec < 1704067200 - expire_days * 86400 as dies, transition_days > 0 and mtime_sec < 1704067200 - transition_days * 86400 as moves
      from o join rules r on starts_with(path, prefix) and (disk is null or disk = disk_type)),
    ends as (select path, min(rule_idx) filter (dies) as e from hit group by path),
    last_step as (select h.path, arg_max(storage_class, rule_idx) as sc from hit h join ends on h.path = ends.path where moves and (e is null or rule_idx < e) group by h.path)
    select o.path, sc as storage_class, case when e is not null then 'delete' when sc is not null then 'transition' else 'keep' end as action
    from o left join ends on o.path = ends.path left join last_step s on o.path = s.path""",
)
def _(t):
    objects = _paths(t).withColumn("tags", F.create_map(F.lit("disk"), F.col("disk_type")))
    rules = objects.sparkSession.createDataFrame(_TAG_RULES, "rule_idx int, prefix string, expire_days int, transition_days int, storage_class string, status string, tag_key string, tag_value string")
    return ops.lifecycle(objects, rules, NOW)


@query(
    "p4_tag_filter",
    "select inode, r from (select inode, disk_type, dir || '/' || name as path, unnest([0, 1, 2]) as r from f_entries) where case r when 0 then starts_with(path, '/buckets/src1') when 1 then disk_type = 'ssd' else starts_with(path, '/buckets/src2') and disk_type = 'hdd' end",
)
def _(t):
    rules = t("f_entries").sparkSession.createDataFrame([(0, "/buckets/src1", None, None), (1, "", "disk", "ssd"), (2, "/buckets/src2", "disk", "hdd")], "r int, prefix string, k string, v string")
    tags = F.create_map(F.lit("disk"), F.col("disk_type"))
    return _paths(t).join(F.broadcast(rules), ops.matches_filter(F.col("path"), F.col("prefix"), tags, F.col("k"), F.col("v"))).select("inode", "r")


@query(
    "p5_expiration",
    "select inode, case when inode % 4 > 0 then mtime_sec < 1704067200 - (inode % 4) * 50 * 86400 else inode % 8 = 0 and inode % 16 = 0 end as expired from f_entries",
)
def _(t):
    date = F.when(F.col("inode") % 8 != 0, F.lit("not a date")).when(F.col("inode") % 16 == 0, F.lit("2023-06-01T00:00:00Z")).otherwise(F.lit("2024-06-01T00:00:00Z"))
    return t("f_entries").select("inode", ops.expired(F.col("mtime_sec"), (F.col("inode") % 4) * 50, NOW, date).alias("expired"))


@query("p6_transition", "select inode from f_entries where inode % 3 > 0 and mtime_sec < 1704067200 - (inode % 3) * 90 * 86400")
def _(t):
    return t("f_entries").where(ops.transitions(F.col("mtime_sec"), (F.col("inode") % 3) * 90, NOW)).select("inode")


@query("p7_ttl_expired", "select inode from f_entries where inode % 5 > 0 and 1704067200 > mtime_sec + (inode % 5) * 2592000")
def _(t):
    return t("f_entries").where(ops.ttl_expired(F.col("mtime_sec"), (F.col("inode") % 5) * 2592000, NOW)).select("inode")


@query(
    "p8_tiering",
    """select inode, case when inode % 6 <> 0 and 1704067200 - mtime_sec >= 300 * 86400 then 'archive' when disk_type = 'ssd' and 1704067200 - mtime_sec >= 30 * 86400 then 'migrate' end as action from f_entries""",
)
def _(t):
    return t("f_entries").select("inode", ops.tiering(F.col("mtime_sec"), F.col("disk_type"), F.col("inode") % 6 == 0, NOW, 30 * 86400, 300 * 86400).alias("action"))


@query(
    "j4_longest_prefix",
    """with p as (select dir || '/' || name as path from f_entries), m as (select path, arg_max(r, length(r.path_prefix)) as r from p join f_conf_rules r on starts_with(path, r.path_prefix) group by path)
    select p.path, coalesce(m.r.collection, 'none') as collection, coalesce(m.r.replication, '000') as replication from p left join m on p.path = m.path""",
)
def _(t):
    return ops.longest_prefix(_paths(t).select("path"), t("f_conf_rules"), {"collection": "none", "replication": "000"})


_REQUESTS = "req as (select g.identity, a.action, substr(dir || '/' || name, 10) as resource, inode from f_entries, (select distinct identity from f_grants) g, (values ('s3:GetObject'), ('s3:PutObject')) a(action))"
_ALLOWED = "exists (select 1 from f_grants f where f.identity = req.identity and (f.grant_str = 'Admin' or (f.grant_str = 'Read' and action = 's3:GetObject') or f.grant_str = action or (f.grant_str = 's3:GetObject:src1/*' and action = 's3:GetObject' and starts_with(resource, 'src1/'))))"


def _requests(t):
    s = t("f_entries").sparkSession
    actions = s.createDataFrame([("s3:GetObject",), ("s3:PutObject",)], "action string")
    return _paths(t).select(F.substring("path", 10, 2**30).alias("resource"), "inode").crossJoin(t("f_grants").select("identity").distinct()).crossJoin(actions)


@query("p10_authorize", f"with {_REQUESTS} select identity, action, resource from req where {_ALLOWED}")
def _(t):
    return ops.authorize(_requests(t), t("f_grants")).select("identity", "action", "resource")


@query("j5_denied", f"with {_REQUESTS} select identity, action, count(*) as n from req where not {_ALLOWED} group by identity, action")
def _(t):
    return ops.deny(_requests(t), t("f_grants")).groupBy("identity", "action").agg(F.count(F.lit(1)).alias("n"))


@query("j13_identify_keys", "select event_id as request_id, 'AK' || event_id % 50 as access_key, case when event_id % 50 < 30 then 'user' || (event_id % 50) % 10 end as identity from events")
def _(t):
    e = t("events")
    requests = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("AK"), (F.col("event_id") % 50).cast("string")).alias("access_key"))
    users = e.sparkSession.range(10).select(F.concat(F.lit("user"), F.col("id").cast("string")).alias("identity"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("AK"), (k * 10 + F.col("id")).cast("string"))).alias("keys"))
    return ops.identify(requests, users)


_IPS = "ips as (select event_id as request_id, case when event_id % 11 = 0 then 'bad' else '10.' || event_id % 4 || '.' || event_id % 256 || '.' || user_id % 256 end as ip, 10 * 16777216 + (event_id % 4) * 65536 + (event_id % 256) * 256 + user_id % 256 as n from events)"


@query("j16_allowed_addresses", f"with {_IPS} select request_id, ip from ips where event_id_ok and ((n between 167772160 and 167772160 + 65535) or (n between 167837696 + 16 * 256 and 167837696 + 31 * 256 + 255) or n = 167903751)".replace("event_id_ok", "ip <> 'bad'"))
def _(t):
    e = t("events")
    n = F.col("event_id")
    part = lambda c: c.cast("string")
    ip = F.when(n % 11 == 0, F.lit("bad")).otherwise(F.concat_ws(".", F.lit("10"), part(n % 4), part(n % 256), part(F.col("user_id") % 256)))
    cidrs = e.sparkSession.createDataFrame([("10.0.0.0/16",), ("10.0.3.0/24",), ("10.1.17.9/20",), ("10.2.2.7",), ("rubbish",), ("10.0.0.0/99",)], "cidr string")
    return ops.allowed_addresses(e.select(n.alias("request_id"), ip.alias("ip")), cidrs)


_HTTP = "http as (select event_id, case event_id % 5 when 0 then 'GET' when 1 then 'put' when 2 then 'HEAD' when 3 then 'DELETE' else 'GET' end as method, case when event_type = 'error' then 500 else 200 end as status, case when user_id % 7 = 0 then 'AWS x' end as authorization from events)"


def _http(t):
    return t("events").selectExpr("event_id", "case event_id % 5 when 0 then 'GET' when 1 then 'put' when 2 then 'HEAD' when 3 then 'DELETE' else 'GET' end as method", "case when event_type = 'error' then 500 else 200 end as status", "case when user_id % 7 = 0 then 'AWS x' end as authorization")


@query("p12_audited", f"""with {_HTTP} select event_id, method, status from http where status >= 400 or upper(method) in ('PUT', 'POST', 'DELETE', 'PATCH') or "authorization" is not null""")
def _(t):
    return ops.audited(_http(t)).select("event_id", "method", "status")


@query("p18_retryable", "select event_id, s as status from (select event_id, [200, 429, 500, 501, 502, 503, 504, 404][event_id % 8 + 1] as s, event_id % 13 = 0 as net from events) where net or s in (429, 500, 502, 503, 504)")
def _(t):
    codes = F.array(*[F.lit(c) for c in (200, 429, 500, 501, 502, 503, 504, 404)])
    e = t("events").select("event_id", codes[(F.col("event_id") % 8).cast("int")].alias("status"))
    return e.where(ops.retryable(F.col("status"), F.col("event_id") % 13 == 0))


@query(
    "p13_first_site_rule",
    """select event_id as request_id, case when o = 'HTTPS://A.example' and m = 'get' then 0 when o = 'https://b.example' and m in ('GET', 'put') then 1 when m = 'DELETE' then 2 end as rule_idx
    from (select event_id, ['HTTPS://A.example', 'https://b.example', 'https://c.example'][event_id % 3 + 1] as o, ['get', 'GET', 'put', 'DELETE'][event_id % 4 + 1] as m from events)""".replace("m = 'get' then 0", "m in ('get', 'GET') then 0").replace("m in ('GET', 'put') then 1", "m in ('get', 'GET', 'put') then 1"),
)
def _(t):
    e = t("events")
    origin = F.array(*[F.lit(o) for o in ("HTTPS://A.example", "https://b.example", "https://c.example")])[(F.col("event_id") % 3).cast("int")]
    method = F.array(*[F.lit(m) for m in ("get", "GET", "put", "DELETE")])[(F.col("event_id") % 4).cast("int")]
    rules = e.sparkSession.createDataFrame([(0, ["https://a.example"], ["GET"]), (1, ["x", "https://b.example"], ["PUT", "Get"]), (2, ["*"], ["DELETE"])], "rule_idx int, origins array<string>, methods array<string>")
    return ops.first_site_rule(e.select(F.col("event_id").alias("request_id"), origin.alias("origin"), method.alias("method")), rules)


@query("p14_stale_uploads", "select inode from (select inode, case when inode % 3 = 0 then 0 else mtime_sec end as c, case when inode % 6 = 0 then 0 else mtime_sec - 100 end as m from f_entries) where coalesce(nullif(c, 0), nullif(m, 0)) <= 1704067200 - 200 * 86400")
def _(t):
    u = t("f_entries").selectExpr("inode", "case when inode % 3 = 0 then 0 else mtime_sec end as crtime", "case when inode % 6 = 0 then 0 else mtime_sec - 100 end as mtime")
    return ops.stale_uploads(u, NOW, 200 * 86400).select("inode")


@query(
    "j15_cached_locations",
    """with s as (select user_id % 40 as vid, event_id as set_at from events where event_id % 17 = 0), l as (select event_id as request_id, user_id % 40 as vid, event_id as at_ from events where event_id % 17 <> 0)
    select request_id, l.vid, at_ as "at", set_at, coalesce(at_ <= set_at + 300, false) as hit from l asof left join s on l.vid = s.vid and l.at_ >= s.set_at""",
)
def _(t):
    e = t("events").selectExpr("event_id as request_id", "user_id % 40 as vid", "event_id as at")
    return ops.cached_locations(e.where("request_id % 17 <> 0"), e.where("request_id % 17 = 0").select("vid", "at"), 300)

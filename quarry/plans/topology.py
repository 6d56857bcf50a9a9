"""Queries over the cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import topology as ops
from quarry.plans.catalog import query

#: A volume has some 25 replicas here; so many are expected, and some volumes have fewer.
_EXPECTED = "20 + vid % 4"


def _expected():
    return F.expr(_EXPECTED)


@query("p9_flatten_snapshot", "select dc, rack, cast(node as varchar) as node, vid from f_topology")
def _(t):
    return ops.flatten(ops.snapshot(t("f_topology")))


@query("s12_snapshot_json", "select dc, rack, count(*) as n, cast(sum(vid) as bigint) as vids from f_topology group by dc, rack")
def _(t):
    read = ops.from_json(ops.to_json(ops.snapshot(t("f_topology"))))
    return ops.flatten(read).groupBy("dc", "rack").agg(F.count(F.lit(1)).alias("n"), F.sum("vid").alias("vids"))


@query("k2_export_json", "select dc, rack, cast(node as varchar) as node, count(*) as n, min(vid) as first, max(vid) as last from f_topology group by dc, rack, node")
def _(t):
    read = ops.flatten(ops.from_json(ops.to_json(ops.snapshot(t("f_topology")))))
    return read.groupBy("dc", "rack", "node").agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("first"), F.max("vid").alias("last"))


@query("a5_counts", "select count(distinct dc) as n_dc, count(distinct dc || '/' || rack) as n_rack, count(distinct node) as n_node, count(*) as n_replica from f_topology")
def _(t):
    return ops.counts(t("f_topology"))


@query("x2_counts_by_level", "select dc, rack, node, count(*) as n_replica from f_topology group by rollup (dc, rack, node)")
def _(t):
    return ops.counts_by_level(t("f_topology"))


@query("a8_census", f"select vid, count(distinct node) as actual, cast({_EXPECTED} as bigint) as expected from f_topology group by vid having count(distinct node) < {_EXPECTED}")
def _(t):
    return ops.census(t("f_topology"), _expected())


_LOADS = "loads as (select n.node, count(distinct vid) as c from f_nodes n left join f_topology t on n.node = t.node group by n.node), b as (select ceil(avg(c) * 1.05) as high, floor(avg(c) * 0.95) as low from loads)"


@query("a9_node_loads", f"with {_LOADS} select node, c as n_volumes, cast(high as bigint) as high, cast(low as bigint) as low from loads, b")
def _(t):
    return ops.node_loads(t("f_topology"), t("f_nodes"), 0.05)


@query(
    "j9_balance_plan",
    f"""with {_LOADS}, pairs as (select h.node as source, h.c as sc, l.node as target, l.c as tc from loads h, loads l, b where h.c > high and l.c < low)
    select source, target, min(vid) as vid from pairs join f_topology t on t.node = source where not exists (select 1 from f_topology x where x.node = target and x.vid = t.vid)
    group by source, target, sc, tc order by sc desc, source, tc desc, target limit 5""",
)
def _(t):
    return ops.balance_plan(t("f_topology"), t("f_nodes"), 0.05, 5)


_LACK = f"lack as (select vid, count(distinct node) as actual, {_EXPECTED} as expected from f_topology group by vid having count(distinct node) < {_EXPECTED})"
_SOURCE = "src as (select vid, node as source from (select t.vid, t.node, row_number() over (partition by t.vid order by free_slots desc, t.node) as k from (select distinct vid, node from f_topology) t join f_nodes n on t.node = n.node) where k = 1)"


@query(
    "w1_repair_plan",
    f"""with {_LACK}, {_SOURCE}, cand as (select vid, actual, expected, node as target, row_number() over (partition by vid order by free_slots desc, node) as k from lack, f_nodes n
      where free_slots > 0 and not exists (select 1 from f_topology x where x.vid = lack.vid and x.node = n.node))
    select cand.vid, source, target from cand join src on cand.vid = src.vid where k <= expected - actual""",
)
def _(t):
    return ops.repair_plan(t("f_topology"), t("f_nodes"), _expected())


@query("w2_source_nodes", f"with {_SOURCE} select vid, source from src")
def _(t):
    return ops.source_nodes(t("f_topology"), t("f_nodes"))


@query("j7_candidates", f"with {_LACK} select vid, n.node as target from lack, f_nodes n where free_slots > 0 and not exists (select 1 from f_topology x where x.vid = lack.vid and x.node = n.node)")
def _(t):
    r = t("f_topology")
    return ops.candidates(r, t("f_nodes"), ops.census(r, _expected(), held=True))


@query("j8_stale_volumes", "select node, vid from f_topology where node % 2 = 0 and vid % 3 = 0 and node in (select node from f_topology where node % 2 = 0 and vid % 3 <> 0)")
def _(t):
    r = t("f_topology")
    return ops.stale(r, r.where("node % 2 = 0 and vid % 3 <> 0"))


@query("u1_known_minus_reported", "select node, vid from f_topology except select node, vid from f_topology where vid % 3 <> 0")
def _(t):
    r = t("f_topology").select("node", "vid")
    return r.subtract(r.where("vid % 3 <> 0"))


_LAYOUT = "select distinct concat('c', vid % 3) as collection, concat('0', vid % 2, '0') as replication, vid, case when vid % 7 = 0 and vid % 2 = 0 then 'readonly' else 'writable' end as state from f_topology"


@query(
    "a10_layouts_to_grow",
    f"""with l as ({_LAYOUT}) select collection, replication, count(*) filter (state = 'writable') as writable, count(*) as total, cast(count(*) filter (state = 'writable') as double) / count(*) < 0.9 as grow,
    greatest(1, cast(floor(count(*) * 0.1) as bigint)) as to_add from l group by collection, replication""",
)
def _(t):
    r = t("f_topology").selectExpr("concat('c', vid % 3) as collection", "concat('0', vid % 2, '0') as replication", "vid", "case when vid % 7 = 0 and vid % 2 = 0 then 'readonly' else 'writable' end as state").distinct()
    return ops.layouts_to_grow(r)


@query(
    "a11_free_slots",
    "select n.node, cast(greatest(0, 50 + n.node % 20 - coalesce(c, 0) - (case when n.node % 4 = 0 then 3 else 0 end)) as bigint) as free from f_nodes n left join (select node, count(*) as c from f_topology group by node) t on n.node = t.node",
)
def _(t):
    n = t("f_nodes")
    return ops.free_slots(n.selectExpr("node", "50 + node % 20 as max_count"), t("f_topology"), n.where("node % 4 = 0").selectExpr("node", "3 as n"))


@query("l8_freest_disk", "select node % 10 as rack, arg_min(disk, rank) as disk, max(free_slots) as free from (select *, concat('d', node) as disk, row_number() over (partition by node % 10 order by free_slots desc, concat('d', node)) as rank from f_nodes) group by node % 10")
def _(t):
    return ops.freest(t("f_nodes").selectExpr("node % 10 as rack", "concat('d', node) as disk", "free_slots as free"), "rack")


@query("u4_disk_types", "select node, disk_type from (select node, case when vid % 2 = 0 then 'ssd' else 'hdd' end as disk_type from f_topology union select node, 'nvme' from f_nodes where free_slots > 3)")
def _(t):
    return ops.disk_types(t("f_topology").selectExpr("node", "case when vid % 2 = 0 then 'ssd' else 'hdd' end as disk_type"), t("f_nodes").where("free_slots > 3").selectExpr("node", "'nvme' as disk_type"))


@query("u2_union_of_layouts", "select vid, count(*) as n from (select vid, node from f_topology where vid % 2 = 0 union all select vid, node from f_topology where vid % 3 = 0) group by vid")
def _(t):
    r = t("f_topology").select("vid", "node")
    return r.where("vid % 2 = 0").unionByName(r.where("vid % 3 = 0")).groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


@query("u3_flat_levels", "select 'dc' as level, dc as id from f_topology union select 'rack', dc || '/' || rack from f_topology union select 'node', cast(node as varchar) from f_topology")
def _(t):
    r = t("f_topology")
    levels = F.array(F.struct(F.lit("dc").alias("level"), F.col("dc").alias("id")), F.struct(F.lit("rack").alias("level"), F.concat_ws("/", "dc", "rack").alias("id")), F.struct(F.lit("node").alias("level"), F.col("node").cast("string").alias("id")))
    return r.select(F.explode(levels).alias("x")).select("x.level", "x.id").distinct()


@query(
    "j1_locate_volumes",
    """select o_orderkey as request_id, o_orderkey % 3000 as vid, l as locations, case when l is null then 'volume not found' end as error
    from orders left join (select vid, string_agg(distinct cast(node as varchar), ',' order by cast(node as varchar)) as l from f_topology group by vid) t on o_orderkey % 3000 = t.vid""",
)
def _(t):
    return ops.locate(t("orders").selectExpr("o_orderkey as request_id", "o_orderkey % 3000 as vid"), t("f_topology"))


@query(
    "p15_writable_volumes",
    """with l as (select distinct vid, case when vid % 5 = 0 then 'readonly' else 'writable' end as state from f_topology), f as (select vid, min(node) as primary_node, max(case when dc = 'ASIA' then 1 else 0 end) as there from f_topology group by vid)
    select l.vid, primary_node as "primary" from l join f on l.vid = f.vid where state = 'writable' and there = 1 and primary_node % 6 <> 0""",
)
def _(t):
    r = t("f_topology")
    layout = r.selectExpr("vid", "case when vid % 5 = 0 then 'readonly' else 'writable' end as state").distinct()
    return ops.writable_in(layout, r, t("f_nodes").where("node % 6 <> 0"), dc="ASIA")


@query("l3_sorted_replicas", "select vid, string_agg(cast(node as varchar), ',' order by node) as nodes from f_topology group by vid")
def _(t):
    return t("f_topology").groupBy("vid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda n: n.cast("string")), ",").alias("nodes"))


@query(
    "w16_place_copies",
    """with c as (select *, row_number() over (order by node, dc, rack) as pos from (select distinct cast(node as varchar) as node, dc, rack from f_topology)),
    r as (select node as request_id, node % 3 as n_dc, node % 2 as n_rack, node % 4 as n_same from f_nodes),
    kinds as (select r.*, c.node, c.pos, case when c.pos = 1 then 0 when c.dc <> h.dc then 1 when c.rack <> h.rack then 2 else 3 end as kind,
      row_number() over (partition by request_id, c.dc, c.rack order by c.pos) as of_rack from r, c, (select dc, rack from c where pos = 1) h),
    ranked as (select *, row_number() over (partition by request_id, kind, kind = 2 and of_rack > 1 order by pos) as k from kinds),
    chosen as (select *, kind = 0 or (kind = 1 and k <= n_dc) or (kind = 2 and of_rack = 1 and k <= n_rack) or (kind = 3 and k <= n_same) as taken from ranked),
    filled as (select *, row_number() over (partition by request_id, taken order by pos) as spare, count(*) filter (taken) over (partition by request_id) as had from chosen),
    final as (select *, case when taken then kind else 4 end as step from filled where taken or spare <= n_dc + n_rack + n_same + 1 - had)
    select request_id, string_agg(node, ',' order by step, pos) as nodes, count(*) as n from final group by request_id""",
)
def _(t):
    nodes = t("f_topology").select(F.col("node").cast("string").alias("node"), "dc", "rack")
    asked = t("f_nodes").selectExpr("node as request_id", "cast(node % 3 as int) as copies_dc", "cast(node % 2 as int) as copies_rack", "cast(node % 4 as int) as copies_same")
    return ops.place_copies(ops.near_candidates(asked, nodes))

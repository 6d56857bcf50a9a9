"""Operators over the cluster: replicas(dc, rack, node, vid), nodes(node, free_slots), layouts and plans.

Nodes are few and volumes many: what is ranked or paired is nodes, and volumes only ever meet the few nodes at the top of a ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.rewrite import small

#: Nodes that a volume meets at once, and nodes of a task.  A Parquet writer numbers the nodes that it meets, in as few bits as they
#: take, up to 1 MB of them (131,072); beyond that each has eight bytes.
BLOCK, PART = 256, 1 << 14

SNAPSHOT = "array<struct<id: string, racks: array<struct<id: string, nodes: array<struct<id: string, url: string, volumes: array<bigint>>>>>>>"


def snapshot(replicas: DataFrame) -> DataFrame:
    """One nested row: data centers, racks, nodes and their volumes, each level by id."""
    nodes = replicas.groupBy("dc", "rack", "node").agg(F.array_sort(F.collect_set("vid")).alias("volumes"))
    racks = nodes.groupBy("dc", "rack").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("string").alias("id"), F.concat(F.lit("n"), F.col("node").cast("string"), F.lit(":8080")).alias("url"), "volumes"))).alias("nodes"))
    dcs = racks.groupBy("dc").agg(F.array_sort(F.collect_list(F.struct(F.col("rack").alias("id"), "nodes"))).alias("racks"))
    return dcs.agg(F.array_sort(F.collect_list(F.struct(F.col("dc").alias("id"), "racks"))).alias("data_centers"))


def to_json(snap: DataFrame) -> DataFrame:
    return snap.select(F.to_json("data_centers", {"pretty": "true"}).alias("json"))


def from_json(text: DataFrame) -> DataFrame:
    return text.select(F.from_json("json", SNAPSHOT).alias("data_centers"))


def flatten(snap: DataFrame) -> DataFrame:
    """(dc, rack, node, vid) of a snapshot; a node without an id goes by its address."""
    d = snap.select(F.explode("data_centers").alias("d"))
    r = d.select(F.col("d.id").alias("dc"), F.explode("d.racks").alias("r"))
    n = r.select("dc", F.col("r.id").alias("rack"), F.explode("r.nodes").alias("n"))
    return n.select("dc", "rack", F.coalesce(F.nullif(F.col("n.id"), F.lit("")), F.col("n.url")).alias("node"), F.explode("n.volumes").alias("vid"))


def counts(replicas: DataFrame) -> DataFrame:
    return replicas.agg(F.countDistinct("dc").alias("n_dc"), F.countDistinct("dc", "rack").alias("n_rack"), F.countDistinct("node").alias("n_node"), F.count(F.lit(1)).alias("n_replica"))


def counts_by_level(replicas: DataFrame) -> DataFrame:
    """An extension: replicas of each data center, rack and node, and totals of each level."""
    return replicas.rollup("dc", "rack", "node").agg(F.count(F.lit(1)).alias("n_replica"))


def census(replicas: DataFrame, expected: Column, held: bool = False) -> DataFrame:
    """Volumes with fewer nodes than expected (an expression of vid): (vid, actual, expected), and with held the nodes too."""
    every = holders(replicas).withColumn("actual", F.size("held").cast("long")) if held else replicas.groupBy("vid").agg(F.count_distinct("node").alias("actual"))
    return every.withColumn("expected", expected.cast("long")).where("actual < expected")


def holders(replicas: DataFrame) -> DataFrame:
    """(vid, held): the nodes of each volume, in one array."""
    return replicas.groupBy("vid").agg(F.collect_set("node").alias("held"))


def node_loads(replicas: DataFrame, nodes: DataFrame, spread: float) -> DataFrame:
    """(node, n_volumes, high, low): volumes of each node, and the bounds about the mean beyond which one is heavy or light."""
    own = replicas.groupBy("node").agg(F.count_distinct("vid").alias("n_volumes"))
    loads = nodes.select("node").join(own, "node", "left").withColumn("n_volumes", F.coalesce("n_volumes", F.lit(0)).cast("long"))
    bounds = loads.agg(F.ceil(F.avg("n_volumes") * (1.0 + spread)).alias("high"), F.floor(F.avg("n_volumes") * (1.0 - spread)).alias("low"))
    return loads.crossJoin(F.broadcast(bounds))


def balance_plan(replicas: DataFrame, nodes: DataFrame, spread: float = 0.2, most: int = 5) -> DataFrame:
    """(source, target, vid): for each heavy and light node the least volume that the light one lacks; loads are those
    at the start, as planned moves don't change them.  Heaviest sources first, then the less light targets, ties by node."""
    loads = node_loads(replicas, nodes, spread)
    heavy = loads.where("n_volumes > high").select(F.col("node").alias("source"), F.col("n_volumes").alias("s_load"))
    light = loads.where("n_volumes < low").select(F.col("node").alias("target"), F.col("n_volumes").alias("t_load"))
    order = [F.desc("s_load"), "source", F.desc("t_load"), "target"]
    # a heavy node holds more volumes than a light one, so there is one to move for every pair: the first pairs are the plan's
    first = heavy.orderBy(*order[:2]).limit(most).crossJoin(light.orderBy(*order[2:]).limit(most)).orderBy(*order).limit(most)
    offered = replicas.select(F.col("node").alias("source"), "vid").join(F.broadcast(first), "source")
    fit = offered.join(replicas.select(F.col("node").alias("target"), "vid"), ["target", "vid"], "left_anti")
    plan = fit.groupBy("source", "target", "s_load", "t_load").agg(F.min("vid").alias("vid"))
    return plan.orderBy(*order).select("source", "target", "vid")


def ranked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with free slots, the freest first, ties by node: (target, place).  There are as many rows as nodes."""
    order = Window.orderBy(F.desc("free_slots"), "node")
    return nodes.where("free_slots > 0").select(F.col("node").alias("target"), F.row_number().over(order).alias("place"))


def source_nodes(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vid, source): of the nodes that hold a volume the freest, ties by node."""
    held = replicas.select("vid", "node").distinct().join(nodes.select("node", "free_slots"), "node")
    return held.groupBy("vid").agg(F.min_by("node", F.struct(-F.col("free_slots"), F.col("node"))).alias("source"))


def repair_plan(replicas: DataFrame, nodes: DataFrame, expected: Column) -> DataFrame:
    """(vid, source, target): copies for volumes that lack some, to the freest nodes without one.

    A volume with `actual` copies needs `expected - actual` more, so its targets are among the first `expected` nodes."""
    lacking = census(replicas, expected)
    near = lacking.join(small(ranked_nodes(nodes)), F.col("place") <= F.col("expected"))
    free = near.join(replicas.select("vid", F.col("node").alias("target")), ["vid", "target"], "left_anti")
    order = Window.partitionBy("vid").orderBy("place")
    chosen = free.withColumn("k", F.row_number().over(order)).where("k <= expected - actual")
    return chosen.join(source_nodes(replicas, nodes), "vid").select("vid", "source", "target")


def candidates(replicas: DataFrame, nodes: DataFrame, vids: DataFrame) -> DataFrame:
    """All (vid, target) where the node has room and doesn't hold the volume; vids(vid) are those asked about,
    each once if the nodes that hold it are there too (a census with held).

    As many pairs as there are, so none is shuffled: each volume has the few nodes that hold it beside it, is dealt with
    them, and meets the nodes with room in the task that it is in.  More than a BLOCK of nodes are met block by block, by
    all volumes of a task, so that what is written repeats itself: a volume's id through a block, a block's nodes from volume
    to volume.  A task has a PART of the nodes, and nothing is broadcast."""
    if "held" not in vids.columns:
        asked = vids.select("vid").distinct()
        vids = asked.join(holders(replicas.select("vid", "node").join(asked, "vid", "left_semi")), "vid", "left")
    session = replicas.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    # by a hash, as the order of the nodes in held, and so that of the rows, may be another one when a lost part is made again
    each = vids.select("vid", "held").repartition(tasks, F.xxhash64("vid"))
    free = nodes.where("free_slots > 0").select(F.col("node").alias("target"))
    # a null on either side is a node that isn't held
    lacks = ~F.coalesce(F.array_contains("held", F.col("target")), F.lit(False))
    n = free.count()
    if n <= BLOCK:
        return each.join(F.broadcast(free), lacks).select("vid", "target")
    blocks = node_blocks(free, BLOCK, -(-n // PART))
    # first each block with the volumes that lack all of it, whose runs are whole, then with those that hold some of it
    twice = blocks.withColumn("whole", F.explode(F.array(F.lit(True), F.lit(False))))
    holds_some = F.coalesce(F.exists("held", lambda x: (x >= F.col("first")) & (x <= F.col("last"))), F.lit(False))
    met = twice.hint("shuffle_replicate_nl").join(each, F.col("whole") != holds_some)
    return met.select("vid", "held", "whole", F.explode("targets").alias("target")).where(F.col("whole") | lacks).select("vid", "target")


def node_blocks(nodes: DataFrame, size: int, parts: int) -> DataFrame:
    """nodes(target) in their order, cut into blocks of that size (the last may be smaller), which are dealt to that many
    partitions: (block, targets, first, last)."""
    placed = nodes.withColumn("block", F.floor((F.row_number().over(Window.orderBy("target")) - 1) / size))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("target"))), lambda x: x["target"])  # with nulls
    return placed.repartition(parts, "block").groupBy("block").agg(listed.alias("targets"), F.min("target").alias("first"), F.max("target").alias("last"))


def stale(known: DataFrame, reported: DataFrame) -> DataFrame:
    """(node, vid) that are known but that the node's last report lacks; nodes that never reported are left alone."""
    nodes = reported.select("node").distinct()
    return known.select("node", "vid").join(nodes, "node", "left_semi").join(reported.select("node", "vid"), ["node", "vid"], "left_anti")


def layouts_to_grow(layouts: DataFrame, least: float = 0.9) -> DataFrame:
    """layouts(key columns..., vid, state): those whose writable share is too small, and how many volumes to add."""
    keys = [c for c in layouts.columns if c not in ("vid", "state")]
    found = layouts.groupBy(*keys).agg(F.count_if(F.col("state") == "writable").alias("writable"), F.count("vid").alias("total"))
    return found.withColumn("grow", F.when(F.col("total") == 0, F.lit(True)).otherwise(F.col("writable") / F.col("total") < least)).withColumn("to_add", grow_count(F.col("total")))


def grow_count(total: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(total * 0.1)).cast("long")


def free_slots(capacity: DataFrame, replicas: DataFrame, reservations: DataFrame) -> DataFrame:
    """capacity(node, max_count) less volumes and reservations(node, n), never below zero."""
    used = replicas.groupBy("node").agg(F.count(F.lit(1)).alias("used"))
    held = reservations.groupBy("node").agg(F.sum("n").alias("held"))
    both = capacity.join(used, "node", "left").join(held, "node", "left")
    return both.select("node", F.greatest(F.lit(0), F.col("max_count") - F.coalesce("used", F.lit(0)) - F.coalesce("held", F.lit(0))).cast("long").alias("free"))


def freest(disks: DataFrame, by: str = "node") -> DataFrame:
    """disks(by, disk, free): of each, the disk with the most room; the first by name of equal ones."""
    return disks.groupBy(by).agg(F.min_by("disk", F.struct(-F.col("free"), F.col("disk"))).alias("disk"), F.max("free").alias("free"))


def disk_types(volumes: DataFrame, free: DataFrame) -> DataFrame:
    return volumes.select("node", "disk_type").union(free.select("node", "disk_type")).distinct()


def locate(requests: DataFrame, replicas: DataFrame) -> DataFrame:
    """requests(request_id, vid): the nodes of each volume, or an error."""
    where = replicas.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ",").alias("locations"))
    found = requests.join(where, "vid", "left")
    return found.select("request_id", "vid", "locations", F.when(F.col("locations").isNull(), F.lit("volume not found")).alias("error"))


def writable_in(layout: DataFrame, replicas: DataFrame, alive: DataFrame, dc: str | None = None, rack: str | None = None) -> DataFrame:
    """Writable volumes whose first replica's node is alive and that have a replica where it is wanted."""
    place = F.lit(True)
    if dc:
        place = place & (F.col("dc") == dc)
    if rack:
        place = place & (F.col("rack") == rack)
    first = replicas.groupBy("vid").agg(F.min("node").alias("node"), F.max(place).alias("there"))
    return layout.where("state = 'writable'").join(first.where("there"), "vid").join(alive.select("node"), "node", "left_semi").select("vid", F.col("node").alias("primary"))


def near_candidates(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked(request_id, copies_dc, copies_rack, copies_same), each with the candidates that place_copies can come to among
    all nodes(node, dc, rack) in that order.

    With the most nodes that a request names as n, it takes from the first n of other data centers, the first node of each
    of the first n other racks, the first n of the primary's rack, and, as fewer than n are taken before, the first 2 n of all."""
    most = asked.agg(F.max(F.greatest("copies_dc", F.lit(0)) + F.greatest("copies_rack", F.lit(0)) + F.greatest("copies_same", F.lit(0)) + 1)).first()[0] or 1
    every = nodes.select("node", "dc", "rack").distinct()
    order = ["node", "dc", "rack"]
    home = every.orderBy(*order).limit(1).select(F.col("dc").alias("home_dc"), F.col("rack").alias("home_rack"))
    placed = every.crossJoin(F.broadcast(home)).select(*order, F.col("dc").eqNullSafe(F.col("home_dc")).alias("near"), F.col("rack").eqNullSafe(F.col("home_rack")).alias("own"))
    racks = placed.where("near and not own").groupBy("dc", "rack").agg(F.min(F.struct(*order)).alias("x")).select("x.*")
    few = every.orderBy(*order).limit(2 * most)
    for group in (placed.where("not near"), racks, placed.where("near and own")):
        few = few.unionByName(group.select(*order).orderBy(*order).limit(most))
    listed = few.distinct().agg(F.array_sort(F.collect_list(F.struct(*order))).alias("candidates"))
    return asked.crossJoin(F.broadcast(listed))


def place_copies(asked: DataFrame) -> DataFrame:
    """asked(request_id, copies_dc, copies_rack, copies_same, candidates array<struct<node, dc, rack>> in order): the nodes
    to put a new volume on.  The first candidate is the primary; then other data centers, other racks of its data
    center, its rack, and whoever is left.  A choice depends on those before, so each request is folded in Python."""

    def choose(dc: int, rack: int, same: int, nodes: list) -> list[str]:
        total = dc + rack + same + 1
        if not nodes:
            return []
        home, left, racks = nodes[0], list(nodes[1:]), {nodes[0]["rack"]}
        taken = [home["node"]]

        def take(n: int, wanted) -> None:
            for x in list(left):
                if n <= 0:
                    return
                if wanted(x):
                    left.remove(x)
                    taken.append(x["node"])
                    racks.add(x["rack"]) if x["dc"] == home["dc"] else None
                    n -= 1

        take(dc, lambda x: x["dc"] != home["dc"])
        take(rack, lambda x: x["dc"] == home["dc"] and x["rack"] not in racks)
        take(same, lambda x: x["dc"] == home["dc"] and x["rack"] == home["rack"])
        take(total - len(taken), lambda x: True)
        return taken[:total]

    def run(batches):
        import pyarrow as pa

        for b in (x.slice(a, 1000) for x in batches for a in range(0, x.num_rows, 1000)):
            rows = b.to_pylist()
            picked = [choose(r["copies_dc"], r["copies_rack"], r["copies_same"], r["candidates"] or []) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("request_id"), pa.array([",".join(p) for p in picked], pa.string()), pa.array([len(p) for p in picked], pa.int64())], ["request_id", "nodes", "n"])

    return asked.mapInArrow(run, "request_id long, nodes string, n long")

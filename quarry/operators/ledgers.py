"""Ledgers, sequences and statistics.

Running sums are windows over a key's own rows.  What depends on its own outcome step by step (admission, token buckets,
caches) has no closed form: those are folds over a key's rows in order, in Python over Arrow batches that come sorted, so that a
key's rows stream by and only its state is in memory."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cumulative bounds of a latency histogram, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def dedup_contents(files: DataFrame) -> DataFrame:
    """files(fid, seq, content): each distinct content with its first fid and number of references."""
    return files.groupBy(F.sha2("content", 256).alias("hash")).agg(F.count(F.lit(1)).alias("refs"), F.min_by("fid", "seq").alias("fid"))


def lookup_contents(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(fid, content) with the fid that a known content (index(hash, fid)) goes by, and whether that was a hit."""
    found = files.select("fid", F.sha2("content", 256).alias("hash")).join(index.select("hash", F.col("fid").alias("known")), "hash", "left")
    return found.select("fid", F.coalesce("known", "fid").alias("stored_as"), F.col("known").isNotNull().alias("hit"))


def references(refs: DataFrame, drops: DataFrame) -> DataFrame:
    """refs(fid, refs) after drops(fid), one row for each; what falls to nothing goes."""
    gone = drops.groupBy("fid").agg(F.count(F.lit(1)).alias("gone"))
    left = refs.join(gone, "fid", "left").select("fid", (F.col("refs") - F.coalesce("gone", F.lit(0))).alias("refs"))
    return left.where("refs > 0")


def quota_ledger(log: DataFrame, block: int = 1_000_000) -> DataFrame:
    """log(user_id, seq, delta) with the usage after each step, which never falls below zero.

    With S the running sum, usage is S less the least of 0 and all S so far.  Both go by blocks of seq: within a block by
    windows, across blocks by a window over one row a block, so that a user with most of the rows is spread as well."""
    keys = ["user_id", "block"]
    order = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = log.withColumn("block", F.floor(F.col("seq") / block)).withColumn("s", F.sum("delta").over(order)).withColumn("m", F.min("s").over(order))
    earlier = Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = own.groupBy(*keys).agg(F.sum("delta").alias("total"), F.min("m").alias("low")).withColumn("s0", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    before = each.withColumn("m0", F.coalesce(F.min(F.col("s0") + F.col("low")).over(earlier), F.lit(0))).select(*keys, "s0", "m0")
    placed = own.join(before, keys)
    s = F.col("s0") + F.col("s")
    return placed.select(*log.columns, (s - F.least(F.lit(0), F.col("m0"), F.col("s0") + F.col("m"))).cast("long").alias("used"))


def quota_check(requests: DataFrame, quotas: DataFrame) -> DataFrame:
    """requests(request_id, user_id, bytes) against quotas(user_id, max_bytes, used_bytes); without a quota, or with 0, all is let in."""
    found = requests.join(quotas, "user_id", "left")
    over = F.coalesce((F.col("max_bytes") > 0) & (F.col("used_bytes") + F.col("bytes") > F.col("max_bytes")), F.lit(False))
    return found.select("request_id", "user_id", (~over).alias("admitted"))


def fold(rows: DataFrame, key: str, order: str, schema: str, start: Callable, step: Callable) -> DataFrame:
    """A step for each row of a key in order: step(state, row) -> (state, result or None); start(key) makes a state.

    Rows are dealt by key and sorted; a key's rows are never gathered, its state lives from one row to the next."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state, first = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[key] != now:
                    now, state, first = row[key], start(row[key]), False
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    # dealt by a hash of its own: a repartition by a join's key is optimised away, and AQE may then split that join's keys
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, order).mapInArrow(run, schema)


def admit(requests: DataFrame, limit: int) -> DataFrame:
    """requests(user_id, seq, bytes): admitted while the bytes admitted so far and these stay within the limit; a refused
    request uses nothing."""

    def step(used: int, r: dict) -> tuple:
        good = limit <= 0 or used + r["bytes"] <= limit
        used += r["bytes"] if good else 0
        return used, {"user_id": r["user_id"], "seq": r["seq"], "admitted": good, "used": used}

    return fold(requests.select("user_id", "seq", "bytes"), "user_id", "seq", "user_id long, seq long, admitted boolean, used long", lambda _: 0, step)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests(host, seq, at seconds): allowed while the bucket holds a token; it fills at the rate up to the burst.  The
    first request of a host finds it full and takes one."""

    def step(state: tuple | None, r: dict) -> tuple:
        if state is None:
            return (burst - 1, r["at"]), {"host": r["host"], "seq": r["seq"], "allowed": True}
        tokens, last = state
        tokens = min(burst, tokens + max(0.0, r["at"] - last) * rate)
        good = tokens >= 1
        return (tokens - good, r["at"]), {"host": r["host"], "seq": r["seq"], "allowed": good}

    return fold(requests.select("host", "seq", "at"), "host", "seq", "host string, seq long, allowed boolean", lambda _: None, step)


def simulate_cache(accesses: DataFrame, capacity: int) -> DataFrame:
    """accesses(cache, seq, item, size): hit or miss of a least-recently-used cache that is bounded in bytes and filled on
    a miss.  An item larger than the cache is not kept, and its old copy goes."""

    def step(state: tuple, r: dict) -> tuple:
        held, used = state
        item, size, evicted = r["item"], r["size"], 0
        hit = item in held
        if hit:
            held.move_to_end(item)
        elif 0 < capacity and size <= capacity:
            held[item] = size
            used += size
            while used > capacity:
                used -= held.popitem(last=False)[1]
                evicted += 1
        return (held, used), {"cache": r["cache"], "seq": r["seq"], "hit": hit, "evicted": evicted, "used": used}

    return fold(accesses.select("cache", "seq", "item", "size"), "cache", "seq", "cache long, seq long, hit boolean, evicted long, used long", lambda _: (OrderedDict(), 0), step)


def copy_progress(copied: DataFrame, every: int = 5) -> DataFrame:
    """copied(copy_id, seq, bytes, total): a row when the percentage has grown by `every` since the last such row, or is 100."""

    def step(state: tuple, r: dict) -> tuple:
        done, last = state
        done += r["bytes"]
        pct = 100 if r["total"] <= 0 else min(100, max(0, done * 100 // r["total"]))
        if pct >= last + every or (pct == 100 and last != 100):
            return (done, pct), {"copy_id": r["copy_id"], "seq": r["seq"], "percent": pct}
        return (done, last), None

    return fold(copied.select("copy_id", "seq", "bytes", "total"), "copy_id", "seq", "copy_id long, seq long, percent long", lambda _: (0, 0), step)


def with_sum_before(rows: DataFrame, by: str, value: Column, name: str, block: int = 1_000_000) -> DataFrame:
    """rows with the sum of a value over the rows of the same key before each, in order of seq: within blocks of seq by one
    window, across blocks by a window over one row a block, so that a key with most of the rows is spread too."""
    own = rows.withColumn("_block", F.floor(F.col("seq") / block)).withColumn("_n", value)
    within = Window.partitionBy(by, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    each = own.groupBy(F.col(by).alias("_key"), F.col("_block").alias("_of")).agg(F.sum("_n").alias("_total"))
    each = each.select("_key", "_of", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    placed = own.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(each, F.col(by).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")))
    return placed.select(*rows.columns, (F.col("_start") + F.col("_before")).cast("long").alias(name))


def allocate_ids(requests: DataFrame, start: int = 1) -> DataFrame:
    """requests(stream, seq, n): each gets n ids (one if it asks for none) after those before it."""
    asked = requests.withColumn("n", F.greatest(F.col("n"), F.lit(1)))
    return with_sum_before(asked, "stream", F.col("n"), "first_id").withColumn("first_id", F.col("first_id") + start)


def saved_ceilings(requests: DataFrame, step_size: int = 1000) -> DataFrame:
    """The ceiling that is on disk after each request: raised by a step beyond what is asked whenever that passes it."""

    def step(state: tuple, r: dict) -> tuple:
        current, ceiling = state
        n = max(1, r["n"])
        if current + n > ceiling:
            ceiling = current + step_size + n
        return (current + n, ceiling), {"stream": r["stream"], "seq": r["seq"], "ceiling": ceiling}

    return fold(requests.select("stream", "seq", "n"), "stream", "seq", "stream long, seq long, ceiling long", lambda _: (0, 0), step)


def snowflake_ids(requests: DataFrame) -> DataFrame:
    """requests(node, ms, request_id): time, node and place within the millisecond; beyond 4096 a millisecond is over."""
    from quarry.functions.codes import snowflake

    place = F.row_number().over(Window.partitionBy("node", "ms").orderBy("request_id")) - 1
    return requests.withColumn("place", place).select("request_id", F.when(F.col("place") < 4096, snowflake(F.col("ms"), F.col("node"), F.col("place"))).alias("id"), (F.col("place") >= 4096).alias("over"))


def chunk_layout(files: DataFrame, size: int = 8 << 20, inline: int = 64 << 10) -> DataFrame:
    """files(file_id, file_size): the chunks of each; small files have none, they are kept inline."""
    big = files.where(F.col("file_size") > inline)
    each = big.select("file_id", "file_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("file_size") - 1, F.lit(size).cast("long"))).alias("offset"))
    return each.select("file_id", "offset", F.least(F.lit(size).cast("long"), F.col("file_size") - F.col("offset")).alias("size"))


def reassemble(parts: DataFrame, by: str, order: str, data: str = "data") -> DataFrame:
    """The parts of each object in order, end to end."""
    listed = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, data))).alias("l"))
    return listed.select(by, F.array_join(F.transform("l", lambda x: x[data]), "").alias(data), F.size("l").cast("long").alias("n_parts"))


def complete_multipart(asked: DataFrame, stored: DataFrame, least: int = 5 << 20) -> DataFrame:
    """asked(upload_id, part_number, etag) against stored(upload_id, part_number, etag, size): each asked part with what is
    wrong with it: named twice, missing, another etag, too small though not the last."""
    own = Window.partitionBy("upload_id")
    found = asked.withColumn("twice", F.count(F.lit(1)).over(Window.partitionBy("upload_id", "part_number")) > 1).withColumn("last", F.max("part_number").over(own))
    known = stored.select("upload_id", "part_number", F.col("etag").alias("own_etag"), "size")
    both = found.join(known, ["upload_id", "part_number"], "left")
    error = (
        F.when(F.col("twice"), F.lit("duplicate part"))
        .when(F.col("own_etag").isNull(), F.lit("missing part"))
        .when(F.col("own_etag") != F.col("etag"), F.lit("etag mismatch"))
        .when((F.col("part_number") < F.col("last")) & (F.col("size") < least), F.lit("too small"))
    )
    return both.select("upload_id", "part_number", error.alias("error"))


def deal_in_turn(rows: DataFrame, by: str, n: int) -> DataFrame:
    """rows(by, ...) with a shard, in turn within each group by order of seq."""
    return with_sum_before(rows, by, F.lit(1), "shard").withColumn("shard", F.pmod("shard", F.lit(n)).cast("long"))


def latency_report(samples: DataFrame, by: str, ranks: dict[str, float], elapsed: float) -> DataFrame:
    """samples(by, ok, latency_ns): of the good ones, the value at place floor((n - 1) p) of each, and their rate.

    Samples are counted in narrow bins first (256 for each doubling); only the bins that hold a wanted place are sorted, so
    a group with most of the samples does not end up in one task."""
    latency = F.col("latency_ns")
    good = samples.where("ok").select(by, "latency_ns", F.when(latency > 0, F.floor(F.log2(latency) * 256)).otherwise(F.lit(-1)).cast("long").alias("bin"))
    counts = good.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.floor((F.col("n") - 1) * F.lit(p)).alias("place")) for k, p in ranks.items()])).alias("a")
    wanted = placed.select(by, "bin", "before", "c", "n", asked).where("a.place >= before and a.place < before + c").select(by, "bin", "n", F.col("a.name").alias("name"), (F.col("a.place") - F.col("before") + 1).alias("k"))
    near = good.join(wanted.select(by, "bin").distinct(), [by, "bin"], "left_semi")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy(by, "bin").orderBy("latency_ns")))
    found = ranked.join(wanted, [by, "bin", "k"])
    picks = [F.max(F.when(F.col("name") == name, latency)).alias(name) for name in ranks]
    return found.groupBy(by).agg(F.max("n").alias("n_ok"), *picks).withColumn("qps", F.col("n_ok") / F.lit(float(elapsed)))


def counters(samples: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    return samples.groupBy(*labels).agg((F.count(F.lit(1)) if value is None else F.sum(value)).cast("long").alias("total"))


def histogram(samples: DataFrame, by: str, seconds: Column, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """How many samples of each group are within each bound; the last bound is infinite (null)."""
    counts = [F.struct(F.lit(b).cast("double").alias("le"), F.count_if(seconds <= b).alias("n")) for b in bounds]
    every = F.array(*counts, F.struct(F.lit(None).cast("double").alias("le"), F.count(F.lit(1)).alias("n")))
    return samples.groupBy(by).agg(every.alias("h")).select(by, F.explode("h").alias("x")).select(by, "x.le", "x.n")


def replay_commands(log: DataFrame) -> DataFrame:
    """log(pos, kind, number, text): the greatest file and volume ids, and the last topology id."""
    return log.agg(F.max(F.when(F.col("kind") == "max_file_id", F.col("number"))).alias("max_file_id"), F.max(F.when(F.col("kind") == "max_volume_id", F.col("number"))).alias("max_volume_id"), F.max_by("text", F.when(F.col("kind") == "topology_id", F.col("pos"))).alias("topology_id"))


def commit_index(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """matches(round, peer, match_index, current_term), terms(round, log_index, term): the highest index that a majority has and
    whose entry is of the current term; 0 if there is none."""
    of = matches.groupBy("round", "current_term").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))
    most = of.select("round", "current_term", F.col("m")[F.floor(F.size("m") / 2).cast("int")].alias("reached"))
    fit = most.join(terms, "round").where("log_index <= reached and term = current_term").groupBy("round").agg(F.max("log_index").alias("i"))
    return most.join(fit, "round", "left").select("round", F.coalesce("i", F.lit(0)).cast("long").alias("commit_index"))


def totals(files: DataFrame, ok: Column, size: Column) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def registry(seen: DataFrame, now: int, timeout: int = 30) -> DataFrame:
    """seen(id, at, address): the latest of each id that hasn't expired, and whether it is alive.  At exactly the timeout a
    node is neither alive nor gone."""
    last = seen.groupBy("id").agg(F.max_by(F.struct("at", "address"), F.struct("at", "address")).alias("r")).select("id", "r.at", "r.address")
    return last.where(F.col("at") >= now - timeout).withColumn("alive", F.lit(now) - F.col("at") < timeout)


def first_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return first.select("r.*")


def percentile_place(n: int, p: float) -> int:
    return math.floor((n - 1) * p)

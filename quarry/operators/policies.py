"""Policies: lifecycle, tiering, access, sites, limits.  Rules are few, rows are many: rules are marked for broadcast while they
are few (plans.rewrite.small), so rows stay where they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.codes import glob_to_regex, ipv4
from quarry.plans.rewrite import is_small, small, with_list

DAY = 86400


def matches_filter(path: Column, prefix: Column, tags: Column | None = None, tag_key: Column | None = None, tag_value: Column | None = None) -> Column:
    """Literal prefix, and the tag if the rule names one; an object without that tag doesn't match."""
    found = path.startswith(prefix)
    if tags is None:
        return found
    return found & (tag_key.isNull() | F.coalesce(F.try_element_at(tags, tag_key) == tag_value, F.lit(False)))


def expired(mtime_sec: Column, days: Column, now: int, date: Column | None = None) -> Column:
    """Older than so many days; without days, past a date (RFC 3339; a bad one never)."""
    by_days = mtime_sec < F.lit(now) - days * DAY
    if date is None:
        return (days > 0) & by_days
    by_date = F.coalesce(F.unix_timestamp(F.try_to_timestamp(date)) < now, F.lit(False))
    return F.when(days > 0, by_days).otherwise(by_date)


def transitions(mtime_sec: Column, days: Column, now: int) -> Column:
    return (days > 0) & (mtime_sec < F.lit(now) - days * DAY)


def lifecycle(objects: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """objects(path, mtime_sec[, tags map]) -> path, storage_class, action.

    Enabled rules are taken in order.  The first that expires the object deletes it; transitions of rules before that one are
    made first, the last of them stands.  Rules hold rule_idx, prefix, expire_days, transition_days, storage_class, status, and
    tag_key and tag_value if there are such: a rule with a tag is for objects that have it only.
    While the rules are few each object reads them as a list, without a shuffle; many rules are joined."""
    tagged = {"tag_key", "tag_value"} <= set(rules.columns)
    tag = ["tag_key", "tag_value"] if tagged else [F.lit(None).cast("string").alias("tag_key"), F.lit(None).cast("string").alias("tag_value")]
    on = rules.where("status = 'Enabled'").select("rule_idx", "prefix", "expire_days", "transition_days", "storage_class", *tag)
    on = on.withColumn("tag_key", F.nullif(F.col("tag_key"), F.lit("")))
    has = F.col("tags") if "tags" in objects.columns else F.create_map().cast("map<string, string>")
    own, mtime = objects.select("path", "mtime_sec", has.alias("tags")), F.col("mtime_sec")

    def covers(r: Column | None = None) -> Column:
        of = (lambda c: F.col(c)) if r is None else (lambda c: r[c])
        return matches_filter(F.col("path"), of("prefix"), F.col("tags"), of("tag_key"), of("tag_value"))

    if is_small(on):
        near = with_list(own, on, "rules").withColumn("hits", F.filter("rules", covers))
        found = near.select(
            "path",
            F.get(F.transform(F.filter("hits", lambda r: expired(mtime, r["expire_days"], now)), lambda r: r["rule_idx"]), F.lit(0)).alias("end"),
            F.transform(F.filter("hits", lambda r: transitions(mtime, r["transition_days"], now)), lambda r: F.struct(r["rule_idx"].alias("rule_idx"), r["storage_class"].alias("storage_class"))).alias("steps"),
        )
    else:
        # a path is asked about under its beginnings of just the lengths that rules have
        lengths = F.array(*[F.lit(r.n) for r in on.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()])
        asked = own.select("path", "mtime_sec", "tags", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
        hit = asked.withColumn("prefix", F.substring("path", F.lit(1), F.col("n"))).join(on, "prefix").where(covers())
        ends = hit.groupBy("path", "mtime_sec").agg(
            F.min(F.when(expired(mtime, F.col("expire_days"), now), F.col("rule_idx"))).alias("end"),
            F.array_sort(F.collect_set(F.when(transitions(mtime, F.col("transition_days"), now), F.struct("rule_idx", "storage_class")))).alias("steps"),
        )
        found = own.join(ends, ["path", "mtime_sec"], "left").select("path", "end", F.coalesce("steps", F.array().cast("array<struct<rule_idx: int, storage_class: string>>")).alias("steps"))
    before = F.filter("steps", lambda r: F.col("end").isNull() | (r["rule_idx"] < F.col("end")))
    last = F.try_element_at(before, F.lit(-1))["storage_class"]
    return found.select("path", last.alias("storage_class"), F.when(F.col("end").isNotNull(), F.lit("delete")).when(last.isNotNull(), F.lit("transition")).otherwise(F.lit("keep")).alias("action"))


def ttl_expired(written_at: Column, ttl_sec: Column, now: int) -> Column:
    return F.coalesce((ttl_sec > 0) & (F.lit(now) > written_at + ttl_sec), F.lit(False))


def tiering(mtime_sec: Column, disk_type: Column, is_remote: Column, now: int, access_age: int, archive_age: int) -> Column:
    """archive, migrate or null.  Archiving comes first."""
    age = F.lit(now) - mtime_sec
    return F.when(~is_remote & F.lit(archive_age > 0) & (age >= archive_age), F.lit("archive")).when((disk_type == "ssd") & F.lit(access_age > 0) & (age >= access_age), F.lit("migrate"))


def longest_prefix(paths: DataFrame, rules: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """paths(path) with the columns of the rule whose path_prefix is the longest that matches, or the defaults.

    Few rules are a list that each path reads, without a shuffle.  Many are met by equality: a path is asked about under its
    beginnings of just the lengths that rules have."""
    given = rules.select(F.length("path_prefix").alias("n"), "path_prefix", *defaults)
    if is_small(given):
        hit = F.filter("rules", lambda r: F.col("path").startswith(r["path_prefix"]))  # sorted by length
        best = with_list(paths, given, "rules").withColumn("r", F.try_element_at(hit, F.lit(-1)))
        return best.select(*paths.columns, *[F.coalesce(F.col(f"r.{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])
    lengths = [r.n for r in given.select("n").distinct().collect()]
    asked = paths.select("path").distinct().select("path", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("n")).where("n <= length(path)")
    hit = asked.withColumn("path_prefix", F.substring("path", F.lit(1), F.col("n"))).join(given, ["n", "path_prefix"])
    best = hit.groupBy("path").agg(F.max_by(F.struct(*defaults), "n").alias("r"))
    return paths.join(best, "path", "left").select(*paths.columns, *[F.coalesce(F.col(f"r.{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


READS = ("s3:GetObject", "s3:HeadObject", "s3:ListBucket", "s3:ListAllMyBuckets", "s3:GetBucketLocation", "s3:GetObjectTagging")
WRITES = ("s3:PutObject", "s3:DeleteObject", "s3:CreateBucket", "s3:DeleteBucket", "s3:PutObjectTagging", "s3:AbortMultipartUpload")


def grant_regexes(grants: DataFrame) -> DataFrame:
    """grants(identity, grant_str) with what each allows: any, a group of actions, one action, one action on a pattern, whose
    regular expression is made in the row."""

    @F.pandas_udf("string")
    def regex(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else glob_to_regex(p))

    parts = F.split("grant_str", ":", 3)
    scoped = F.size(parts) == 3
    pattern = F.when(scoped, regex(F.get(parts, F.lit(2)))).otherwise(F.lit(".*"))
    return grants.select("identity", "grant_str", F.when(scoped, F.concat_ws(":", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.col("grant_str")).alias("allowed"), pattern.alias("pattern"))


def allows(action: Column, resource: Column, allowed: Column, pattern: Column) -> Column:
    every = allowed.isin("*", "Admin")
    group = ((allowed == "Read") & action.isin(*READS)) | ((allowed == "Write") & action.isin(*WRITES))
    return every | group | ((allowed == action) & F.call_function("rlike", resource, pattern))


def authorize(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Those of requests(identity, action, resource) that some grant allows."""
    return requests.join(small(grant_regexes(grants).withColumnRenamed("identity", "who")), (F.col("identity") == F.col("who")) & allows(F.col("action"), F.col("resource"), F.col("allowed"), F.col("pattern")), "left_semi")


def deny(requests: DataFrame, grants: DataFrame) -> DataFrame:
    return requests.join(small(grant_regexes(grants).withColumnRenamed("identity", "who")), (F.col("identity") == F.col("who")) & allows(F.col("action"), F.col("resource"), F.col("allowed"), F.col("pattern")), "left_anti")


def identify(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """requests(request_id, access_key) with the identity of the key; null if it is unknown.  credentials(identity, keys array)."""
    keys = credentials.select("identity", F.explode("keys").alias("access_key")).groupBy("access_key").agg(F.min("identity").alias("identity"))
    return requests.join(small(keys), "access_key", "left").select("request_id", "access_key", "identity")


def cidr_ranges(cidrs: DataFrame) -> DataFrame:
    """cidrs(cidr) as (cidr, lo, hi); a bare address is a range of one, what can't be read is left out."""
    bits = F.when(F.contains("cidr", F.lit("/")), F.substring_index("cidr", "/", -1)).otherwise(F.lit("32"))
    ip = ipv4(F.substring_index("cidr", "/", 1))
    size = F.pow(F.lit(2), 32 - F.when(bits.rlike("^([0-9]|[12][0-9]|3[0-2])$"), bits.cast("int"))).cast("long")
    return cidrs.withColumn("lo", ip - F.pmod(ip, size)).withColumn("hi", F.col("lo") + size - 1).where("lo is not null").select("cidr", "lo", "hi")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges without overlap.  Network ranges nest or are apart, so those inside another go."""
    order = Window.orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("lo", "hi").distinct().withColumn("before", F.max("hi").over(order)).where("before is null or hi > before").select("lo", "hi")


def allowed_addresses(requests: DataFrame, cidrs: DataFrame) -> DataFrame:
    """requests(request_id, ip) that a list lets through: all if the list is empty, else those in a range; an address
    that can't be read is not let through."""
    ranges = cidr_ranges(cidrs)
    if not cidrs.limit(1).count():
        return requests
    number = requests.withColumn("n", ipv4(F.col("ip")))
    return number.join(small(merged_ranges(ranges)), (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi")), "left_semi").drop("n")


def audited(requests: DataFrame) -> DataFrame:
    """requests(status, method, authorization, ...): failures, changes, and those that come with credentials."""
    change = F.upper("method").isin("PUT", "POST", "DELETE", "PATCH")
    return requests.where((F.col("status") >= 400) | change | (F.coalesce("authorization", F.lit("")) != ""))


def first_site_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests(request_id, origin, method) with the index of the first rule that allows both; rules(rule_idx, origins,
    methods) of a site are few, each request reads them as a list; many are joined."""
    if not is_small(rules):
        fits = F.exists("origins", lambda o: (o == "*") | (F.lower(o) == F.lower(F.col("origin")))) & F.exists("methods", lambda m: F.lower(m) == F.lower(F.col("method")))
        asked = requests.select("origin", "method").distinct()
        first = asked.join(rules, fits).groupBy("origin", "method").agg(F.min("rule_idx").alias("rule_idx"))
        return requests.join(first, ["origin", "method"], "left").select("request_id", "rule_idx")
    good = F.filter("rules", lambda r: F.exists(r["origins"], lambda o: (o == "*") | (F.lower(o) == F.lower(F.col("origin")))) & F.exists(r["methods"], lambda m: F.lower(m) == F.lower(F.col("method"))))
    return with_list(requests, rules.select("rule_idx", "origins", "methods"), "rules").select("request_id", F.try_element_at(good, F.lit(1))["rule_idx"].alias("rule_idx"))


def stale_uploads(uploads: DataFrame, now: int, older_than: int) -> DataFrame:
    """uploads(crtime, mtime, ...) that began so long ago: by crtime, else mtime; without either they are left alone."""
    began = F.coalesce(F.nullif(F.col("crtime"), F.lit(0)), F.nullif(F.col("mtime"), F.lit(0)))
    return uploads.where(began <= now - older_than)


def retryable(status: Column, network_error: Column) -> Column:
    return network_error | status.isin(429, 500, 502, 503, 504)


def cached_locations(lookups: DataFrame, sets: DataFrame, ttl: int, block: int = 1_000_000) -> DataFrame:
    """lookups(request_id, vid, at) against sets(vid, at): a hit if the last set before or at that time is not too old.

    An as-of join: both sides in order of time, the last set carried forward.  It is carried within blocks of time by one
    window, and across blocks by a window over one row a block, so that a volume that most ask for is spread too."""
    both = lookups.select("vid", "at", F.lit(1).alias("side"), "request_id").unionByName(sets.select("vid", "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("request_id")))
    both = both.withColumn("block", F.floor(F.col("at") / block))
    order = Window.partitionBy("vid", "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("own", F.max(F.when(F.col("side") == 0, F.col("at"))).over(order))
    earlier = Window.partitionBy("vid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("vid", "block").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("last")).withColumn("carried", F.max("last").over(earlier)).select("vid", "block", "carried")
    found = seen.where("side = 1").join(carried, ["vid", "block"]).withColumn("set_at", F.coalesce("own", "carried"))
    return found.select("request_id", "vid", "at", "set_at", F.coalesce(F.col("at") <= F.col("set_at") + ttl, F.lit(False)).alias("hit"))

"""URL filters that hold at fetch time: a temporal list join.

A list is a log of dated entries: a domain or a URL prefix is put on it or taken off it.  Entries of one pattern become
validity intervals [from, until).  A capture is asked about under its host and the domains above it, and under each prefix
of host and path that ends before a slash, after one, or at the end; the as-of join finds the intervals that were open when it was
fetched.  So example.com/a is for /a and all below it, example.com/a/ for what is below it, example.com for the whole host.

At one time the later kind of action wins: an entry that is added and removed at the same second is off.  Hosts are
compared in lower case, without scheme, user, port and trailing dot, in URLs and in patterns; paths as they are, without
the URL's query and fragment (so a pattern with a query matches nothing).

Scale: only names and times move, never pages.  The intervals are broadcast up to BROADCAST rows; beyond that the join is
an ordinary equi-join with a range condition, in which AQE splits a host that holds a third of all captures.  Matches
are added up in each task before they are dealt out.

Nulls: a null, empty or relative URL, or a null time, matches nothing.  Null patterns, kinds, times or unknown actions make no
interval.  Repeated captures stay, each with its result; repeated entries count once.  Empty tables: nothing is blocked.
A long URL makes two patterns for each of its slashes.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed, col

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"
FOREVER = 2**62
#: Intervals up to so many rows are broadcast (about 100 bytes each).
BROADCAST = 200_000


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def keys_of(url: Column) -> Column:
    """array of (kind, pattern) that a capture of this URL is on the list by."""
    host = host_of(url)
    labels = F.split(host, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    path = F.regexp_extract(url, PATH, 1)
    parts = F.split(path, "/", -1)  # the first is empty
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/")))
    both = F.concat(upto, F.transform(F.slice(upto, 1, F.size(upto) - 1), lambda p: F.concat(p, F.lit("/"))))
    prefixes = F.transform(F.array_distinct(both), lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern")))
    return F.when(host != "", F.concat(domains, prefixes)).otherwise(F.array().cast("array<struct<kind: string, pattern: string>>"))


def normal_pattern(pattern: Column) -> Column:
    """A list's pattern with its host as host_of gives it."""
    bare = F.regexp_replace(pattern, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?", "")
    return F.concat(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?#:]*)", 1)), r"\.$", ""), F.regexp_extract(bare, r"(?s)^[^/?#]*(.*)$", 1))


def intervals(entries: DataFrame, kind: str = "kind", pattern: str = "pattern", action: str = "action", at: str = "at") -> DataFrame:
    """(kind, pattern, from_at, until_at) while each pattern was on the list; until_at is FOREVER for those still on it."""
    e = entries.select(col(entries, kind).cast("string").alias("kind"), col(entries, pattern).cast("string").alias("pattern"), col(entries, action).cast("string").alias("action"), col(entries, at).cast("long").alias("at"))
    e = e.filter("kind is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    e = e.withColumn("pattern", normal_pattern(F.col("pattern")))
    e = e.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action"))  # remove is the greater
    order = Window.partitionBy("kind", "pattern").orderBy("at")
    e = e.withColumn("before", F.lag("action").over(order)).filter(F.col("before").isNull() | (F.col("before") != F.col("action")))
    e = e.withColumn("until_at", F.coalesce(F.lead("at").over(order), F.lit(FOREVER)))
    return e.filter("action = 'add'").select("kind", "pattern", F.col("at").alias("from_at"), "until_at")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", **names: str) -> DataFrame:
    """(id, url, fetched_at, blocked, n_matches, pattern, kind) of each capture; pattern: the longest that matched (a domain
    before a prefix of the same length), null if none did.  The id keeps its type."""
    own = captures.select(col(captures, id_col).alias("page_id"), col(captures, url_col).cast("string").alias("url"), col(captures, at_col).cast("long").alias("fetched_at"))
    asked = own.filter("url is not null and fetched_at is not null").select("url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("k")).select("url", "fetched_at", "k.kind", "k.pattern")
    open_then = checkpointed(intervals(entries, **names))
    if open_then.count() <= BROADCAST:
        open_then = F.broadcast(open_then)
    hit = asked.join(open_then, ["kind", "pattern"]).filter("from_at <= fetched_at and fetched_at < until_at")
    best = F.max(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "domain").alias("d"), "pattern", "kind"))
    # repeated captures of one URL and time would count a match once for each of them, so a pattern counts once
    found = hit.groupBy("url", "fetched_at", "kind", "pattern").agg(F.lit(1).alias("one")).groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n_matches"), best.alias("best"))
    found = found.select(F.col("url").alias("u"), F.col("fetched_at").alias("f"), "n_matches", "best")
    out = own.join(found, (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("f")), "left")  # a null matches none
    return out.select("page_id", "url", "fetched_at", F.col("best").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("best.pattern").alias("pattern"), F.col("best.kind").alias("kind"))

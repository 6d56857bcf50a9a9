"""The change feed and what follows it: replication, node reports, locks.

feed(seq, op, path, ts_ns): op is create, update, delete or rename.  All here is for batches; quarry.streaming runs the same
functions on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ledgers import fold


def classify(old: Column, new: Column) -> Column:
    """What happened, from the old and new path of an event: both differ: a rename; both equal: an update."""
    return F.when(old.isNull() & new.isNotNull(), F.lit("create")).when(old.isNotNull() & new.isNull(), F.lit("delete")).when(old == new, F.lit("update")).when(old.isNotNull(), F.lit("rename"))


def parse_record(record: Column) -> Column:
    """struct(op, old, new) of "create:/p", "delete:/p", "update:/p" or "rename:/a->/b"; null if it is none of them."""
    op, rest = F.substring_index(record, ":", 1), F.substring(record, F.instr(record, ":") + 1, F.length(record))
    a, b = F.split_part(rest, F.lit("->"), F.lit(1)), F.split_part(rest, F.lit("->"), F.lit(2))
    own = F.when(op == "create", F.struct(op.alias("op"), F.lit(None).cast("string").alias("old"), rest.alias("new")))
    own = own.when(op == "delete", F.struct(op.alias("op"), rest.alias("old"), F.lit(None).cast("string").alias("new")))
    own = own.when(op == "update", F.struct(op.alias("op"), rest.alias("old"), rest.alias("new")))
    return own.when((op == "rename") & F.contains(rest, F.lit("->")), F.struct(op.alias("op"), a.alias("old"), b.alias("new")))


def subscribe(feed: DataFrame, since: int = 0, prefix: str = "/", boundary: bool = False) -> DataFrame:
    """Events after a place, of directories with a prefix; with boundary, only that directory and those below it."""
    found = feed.where(F.col("seq") > since)
    if boundary:
        root = prefix.rstrip("/")
        return found.where((F.col("dir") == root) | F.col("dir").startswith(root + "/"))
    return found.where(F.col("dir").startswith(prefix))


def cursor(read: DataFrame) -> DataFrame:
    """The place to go on from."""
    return read.agg((F.max("seq") + 1).alias("cursor"))


def last_events(feed: DataFrame, key: str = "path") -> DataFrame:
    """The last event of each path."""
    return feed.groupBy(key).agg(F.max_by(F.struct(*[c for c in feed.columns if c != key]), "seq").alias("e")).select(key, "e.*")


def replicate(target: DataFrame, source: DataFrame, feed: DataFrame) -> DataFrame:
    """What becomes of each path in feed(path, seq, op, ts_ns): target(path, mtime) and source(path, mtime) decide.

    A create or update is skipped if the target's copy is newer, and fails if the source has none; a delete is skipped if
    the target's copy is newer than the event.  (path, status, mtime): mtime after it, null if there is none."""
    e = last_events(feed)
    both = e.join(target.select("path", F.col("mtime").alias("t")), "path", "left").join(source.select("path", F.col("mtime").alias("s")), "path", "left")
    gone = F.col("op") == "delete"
    status = (
        F.when(gone & F.col("t").isNull(), F.lit("ok"))
        .when(gone & (F.col("t") * 1_000_000_000 > F.col("ts_ns")), F.lit("skipped_stale"))
        .when(gone, F.lit("ok"))
        .when(F.col("s").isNull(), F.lit("error"))
        .when(F.col("t") > F.col("s"), F.lit("skipped_stale"))
        .otherwise(F.lit("ok"))
    )
    after = F.when(status != "ok", F.col("t")).when(~gone, F.col("s"))
    return both.select("path", "op", "ts_ns", status.alias("status"), after.alias("mtime"))


def merged(target: DataFrame, source: DataFrame) -> DataFrame:
    """Both sides' entries, the later copy of each path; equal times: the source's."""
    a, b = source.select("path", F.col("mtime").alias("s")), target.select("path", F.col("mtime").alias("t"))
    own = F.coalesce(F.col("t") > F.col("s"), F.col("s").isNull())
    return a.join(b, "path", "full_outer").select("path", F.when(own, F.col("t")).otherwise(F.col("s")).alias("mtime"), F.when(own, F.lit("target")).otherwise(F.lit("source")).alias("origin"))


def replication_status(done: DataFrame, now_ns: int, by: str = "target") -> DataFrame:
    """done(target, status, ts_ns, error): events replicated, the last time, the greatest lag (not below zero), the last error."""
    lag = F.greatest(F.lit(0), F.lit(now_ns) - F.col("ts_ns"))
    return done.groupBy(by).agg(F.count_if(F.col("status") == "ok").alias("replicated"), F.max("ts_ns").alias("last_ts_ns"), F.max(lag).cast("long").alias("max_lag_ns"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ts_ns"))).alias("last_error"))


def reconcile_reports(reports: DataFrame) -> DataFrame:
    """reports(node, seq, vid, read_only): a report is all rows of a node and seq, and says all that the node has; the
    volumes of each node's last report."""
    last = reports.groupBy("node").agg(F.max("seq").alias("seq"))
    return reports.join(last, ["node", "seq"], "left_semi")


def alive(reports: DataFrame, now: int, timeout: int = 30) -> DataFrame:
    """reports(node, at): whether each node was heard of less than the timeout ago."""
    return reports.groupBy("node").agg(F.max("at").alias("last_seen")).withColumn("alive", F.lit(now) - F.col("last_seen") < timeout)


def locks(requests: DataFrame) -> DataFrame:
    """requests(name, seq, at, kind lock or unlock, owner, token, ttl): the outcome of each, in order.

    A lock that holds goes to another owner only with its token; a wrong token is an error for its owner.  Each
    grant makes a new token: t<seq>.  Unlocking takes the token."""

    def step(held: tuple | None, r: dict) -> tuple:
        out = {"name": r["name"], "seq": r["seq"], "owner": None, "token": None}
        token = r["token"] or ""
        if r["kind"] == "unlock":
            if held is None:
                return held, out | {"outcome": "not found"}
            return (held, out | {"outcome": "not owner"}) if held[2] != token else (None, out | {"outcome": "released"})
        if held is not None and held[1] > r["at"]:
            if held[0] != r["owner"] and held[2] != token:
                return held, out | {"outcome": "held", "owner": held[0]}
            if token and held[2] != token:
                return held, out | {"outcome": "not owner"}
        new = (r["owner"], r["at"] + r["ttl"], f"t{r['seq']}")
        return new, out | {"outcome": "acquired", "owner": r["owner"], "token": new[2]}

    return fold(requests, "name", "seq", "name string, seq long, outcome string, owner string, token string", lambda _: None, step)


def upload(files: DataFrame, put: Callable[[dict], None]) -> DataFrame:
    """Hands each row to put(row), in the task that holds it: the rows with ok, and the error's text where it was not.

    A lost task runs again, so put must be able to take a row twice; read the result once (checkpoint it, or write it)."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            errors = []
            for row in b.to_pylist():
                try:
                    put(row)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever the action raises is its row's result
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())], [*b.schema.names, "ok", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{fields}, ok boolean, error string")

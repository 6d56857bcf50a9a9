"""Queries over volume files: a table's rows are written as volumes to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import feeds
from quarry.plans.catalog import query
from quarry.sources import volumes
from quarry.sources.shared import mounted, shared_folder

_NEEDLES = """n as (select upload_id % 8 as vid, upload_id * 1000 + part_number as id, part_number as cookie, text as data, octet_length(encode(text)) as len from
  (select upload_id, part_number, coalesce(data, '') as text from f_parts)),
  p as (select *, 8 * ((len + 40) // 8) as whole, 8 + coalesce(sum(8 * ((len + 40) // 8)) over (partition by vid order by id rows between unbounded preceding and 1 preceding), 0) as pos from n)"""


def _written(t) -> tuple:
    """The session, and a folder with the parts as needles of eight volumes, in order of id."""
    parts = t("f_parts").selectExpr("upload_id % 8 as vid", "upload_id * 1000 + part_number as seq", "cast(part_number as long) as cookie", "upload_id * 1000 + part_number as id", "encode(coalesce(data, ''), 'UTF-8') as data")
    folder = f"{mounted(shared_folder(parts.sparkSession))}/volumes-{uuid.uuid4().hex}"
    volumes.write_volume(parts, folder)
    return parts.sparkSession, folder


def _vid():
    return F.regexp_extract("path", r"/([0-9]+)\.[a-z]+$", 1).cast("long").alias("vid")


@query("k4_volume_round_trip", f"with {_NEEDLES} select vid, id, cast(cookie as bigint) as cookie, cast(len as bigint) as n, md5(data) as h, len = 0 as deleted from p")
def _(t):
    read = volumes.read_dat(*_written(t))
    return read.select(_vid(), F.col("id").cast("long").alias("id"), "cookie", F.length("data").cast("long").alias("n"), F.md5("data").alias("h"), "deleted")


@query("s1_read_volumes", f"with {_NEEDLES} select vid, id, cast(pos as bigint) as pos, cast(whole as bigint) as size from p")
def _(t):
    spark, folder = _written(t)
    spark.dataSource.register(volumes.NeedleSource)
    read = spark.read.format("needles").option("splitBytes", 1 << 16).load(folder)
    return read.select(_vid(), F.col("id").cast("long").alias("id"), "pos", "size")


@query("s2_decode_needles", "select cast(part_number as bigint) as part, count(*) as n, cast(sum(len) as bigint) as bytes from (select part_number, octet_length(encode(coalesce(data, ''))) as len from f_parts) group by part_number")
def _(t):
    record = F.udf(lambda cookie, i, data: volumes.encode(volumes.Needle(cookie, i, bytes(data))), "binary")
    files = t("f_parts").select(F.lit("x.dat").alias("path"), F.concat(F.unhex(F.lit("0300000000000000")), record("part_number", "upload_id", F.encode(F.coalesce("data", F.lit("")), "UTF-8"))).alias("content"))
    read = volumes.decoded(files)
    return read.groupBy(F.col("cookie").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes"))


@query("s3_index_entries", f"with {_NEEDLES} select vid, id as needle_key, cast(pos as bigint) as \"offset\", cast(case when len = 0 then 0 else whole end as bigint) as size from p")
def _(t):
    index = volumes.read_index(*_written(t))
    return index.select(_vid(), F.col("needle_key").cast("long").alias("needle_key"), "offset", "size")


@query(
    "s14_volume_ids",
    """select path, cast(regexp_extract(path, '/([0-9]+)[.]dat$', 1) as bigint) as vid from (select concat('/data/', case o_orderkey % 4 when 0 then 'v' when 1 then '' when 2 then '99999999' else '' end, o_orderkey, case when o_orderkey % 3 = 0 then '.idx' else '.dat' end) as path from orders)
    where regexp_matches(path, '/[0-9]{1,10}[.]dat$') and cast(regexp_extract(path, '/([0-9]+)[.]dat$', 1) as bigint) < 4294967296""",
)
def _(t):
    return volumes.volume_ids(t("orders").selectExpr("concat('/data/', case o_orderkey % 4 when 0 then 'v' when 1 then '' when 2 then '99999999' else '' end, o_orderkey, case when o_orderkey % 3 = 0 then '.idx' else '.dat' end) as path"))


@query("a21_used_space", f"with {_NEEDLES} select vid % 2 as location, cast(sum(whole) + 8 * count(distinct vid) + 16 * count(*) as bigint) as used from p group by vid % 2")
def _(t):
    spark, folder = _written(t)
    return volumes.used_space(volumes.scan_folder(spark, folder), _vid() % 2).withColumnRenamed("place", "location")


@query("s13_scan_folder", f"with {_NEEDLES}, f as (select vid, 8 + sum(whole) as dat, 16 * count(*) as idx from p group by vid) select vid || '.dat' as name, cast(dat as bigint) as size from f union all select vid || '.idx', cast(idx as bigint) from f")
def _(t):
    return volumes.scan_folder(*_written(t)).select(F.substring_index("path", "/", -1).alias("name"), "size")


@query("k15_tier_upload", "select upload_id % 7 <> 0 as ok, count(*) as n, cast(sum(size) as bigint) as bytes from f_parts group by upload_id % 7 <> 0")
def _(t):
    def put(row: dict) -> None:
        if row["upload_id"] % 7 == 0:
            raise OSError("no room")

    return feeds.upload(t("f_parts").select("upload_id", "size"), put).groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))

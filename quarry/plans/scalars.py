"""Queries that put each scalar function over a table's rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import codes, hashing, paths
from quarry.operators.namespace import drop_attribute, put_attributes
from quarry.operators.policies import expired
from quarry.plans.catalog import query
from quarry.sources.tables import NOW


def _path(t):
    return t("f_entries").select("inode", "dir", "name", F.concat_ws("/", "dir", "name").alias("path"))


@query("f1_dir_and_name", "select inode, case when inode % 50 = 0 then '/' when inode % 3 = 0 then '/' else dir end as d, case when inode % 50 = 0 then '' else name end as n from f_entries")
def _(t):
    p = F.when(F.col("inode") % 50 == 0, F.lit("/")).when(F.col("inode") % 3 == 0, F.when(F.col("inode") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("/"), "name"))).otherwise(F.col("path"))
    return _path(t).select("inode", paths.parent_dir(p).alias("d"), paths.base_name(p).alias("n"))


@query("f2_clean_path", "select inode, case inode % 4 when 0 then dir || '/' || name when 1 then '/buckets/' || name when 2 then '/' || name else '/' end as p from f_entries")
def _(t):
    raw = F.when(F.col("inode") % 4 == 0, F.concat(F.lit("/"), "dir", F.lit("//./"), "name", F.lit("/"))).when(F.col("inode") % 4 == 1, F.concat("dir", F.lit("/../../"), "name")).when(F.col("inode") % 4 == 2, F.concat(F.lit("../../"), "name")).otherwise(F.concat("dir", F.lit("/../../../..")))
    return _path(t).select("inode", paths.clean_path(raw).alias("p"))


@query("f3_full_path", "select inode, dir || '/' || name as child, '/' || name as top from f_entries")
def _(t):
    return _path(t).select("inode", paths.full_path(F.col("dir"), F.col("name")).alias("child"), paths.join_path(F.lit("/"), F.col("name")).alias("top"))


@query("f4_bucket_key", "select inode, string_split(dir, '/')[3] as bucket, string_split(dir, '/')[4] || '/' || name as key, '' as none from f_entries")
def _(t):
    rest = F.substring("path", 9, 2**30)
    return _path(t).select("inode", paths.bucket_of(rest).alias("bucket"), paths.key_of(rest).alias("key"), paths.key_of(paths.bucket_of(rest)).alias("none"))


_FID = "printf('%d,%016x%08x', vid, needle_key, needle_key * 31 % 65536)"


@query("f5_file_id", f"select pos, {_FID} as fid, vid, needle_key as needle, needle_key * 31 % 65536 as cookie from f_needle_log")
def _(t):
    log = t("f_needle_log").withColumn("fid", codes.format_file_id(F.col("vid"), F.col("needle_key"), F.col("needle_key") * 31 % 65536))
    p = codes.parse_file_id(F.col("fid"))
    return log.select("pos", "fid", p["vid"].alias("vid"), p["needle"].cast("long").alias("needle"), p["cookie"].alias("cookie"))


@query("f6_volume_of", f"select pos, case when pos % 3 = 0 then null else vid end as v from f_needle_log")
def _(t):
    log = t("f_needle_log")
    fid = codes.format_file_id(F.col("vid"), F.col("needle_key"), F.lit(1))
    text = F.when(F.col("pos") % 3 == 0, F.lit("x,1")).when(F.col("pos") % 3 == 1, F.col("vid").cast("string")).otherwise(fid)
    return log.select("pos", codes.volume_of(text).alias("v"))


@query("f7_placement", "select event_id, cast(a * 32 + b * 4 + c as integer) as packed, a as dc, b as rack, c as same, a + b + c + 1 as copies from (select event_id, cast(event_id % 8 as integer) as a, cast(event_id % 5 as integer) as b, cast(event_id % 4 as integer) as c from events)")
def _(t):
    n = F.col("event_id")
    digits = F.concat((n % 8).cast("string"), (n % 5).cast("string"), (n % 4).cast("string"))
    p = codes.placement_of_text(digits)
    e = t("events").select("event_id", p.alias("p")).withColumn("packed", codes.placement_byte(F.col("p.dc"), F.col("p.rack"), F.col("p.same")))
    q = codes.placement_parts(F.col("packed"))
    return e.select("event_id", "packed", q["dc"].alias("dc"), q["rack"].alias("rack"), q["same"].alias("same"), codes.total_copies(F.col("p")).alias("copies"))


@query("f_ttl_seconds", "select event_id, case when event_id % 9 = 7 then 0 when event_id % 9 = 8 then null when event_id % 300 > 255 then null when event_id % 9 = 6 then null else (event_id % 300) * [60, 3600, 86400, 604800, 2592000, 31536000][event_id % 9 + 1] end as s from events")
def _(t):
    n = F.col("event_id")
    unit = F.array(*[F.lit(u) for u in ("m", "h", "d", "w", "M", "y", "x", "", "")])[(n % 9).cast("int")]
    text = F.when(n % 9 == 7, F.lit("")).when(n % 9 == 8, F.lit("5")).otherwise(F.concat((n % 300).cast("string"), unit))
    return t("events").select("event_id", codes.ttl_seconds(text).alias("s"))


@query("f8_offsets", "select pos, pos * 16 // 8 as stored, pos * 16 as real from f_needle_log")
def _(t):
    stored = codes.offset_stored(F.col("pos") * 16)
    return t("f_needle_log").select("pos", stored.alias("stored"), codes.offset_real(stored).alias("real"))


@query("f9_padding", "select pos, (8 - size % 8) % 8 as pad from f_needle_log")
def _(t):
    return t("f_needle_log").select("pos", codes.padding(F.col("size")).alias("pad"))


@query(
    "f10_needle_size",
    """select pos, n + (8 - n % 8) % 8 as n from (select pos, 16 + 5 + size + case when pos % 5 > 0 then pos % 5 + 1 else 0 end + case when pos % 4 > 0 then pos % 4 + 1 else 0 end
      + case when pos % 7 > 0 then pos % 7 + 2 else 0 end + case when pos % 2 = 0 then 5 else 0 end + case when pos % 11 = 0 then 2 else 0 end + case when pos % 3 = 0 then 12 else 4 end as n from f_needle_log)""",
)
def _(t):
    p = F.col("pos")
    version = F.when(p % 3 == 0, 3).otherwise(p % 3)
    return t("f_needle_log").select("pos", codes.needle_disk_size(F.col("size"), p % 5, p % 4, p % 7, p % 2 == 0, p % 11 == 0, version).alias("n"))


@query(
    "f11_crc32",
    """select inode, xor(list_reduce(list_transform(string_split(name, ''), lambda c: ord(c)::bigint), lambda h, b: list_reduce(range(0, 8), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(h, b)), 4294967295::bigint), 4294967295) as crc from f_entries""",
)
def _(t):
    return t("f_entries").select("inode", F.crc32("name").alias("crc"))


@query("f12_sha256", "select inode, sha256(content) as h from f_entries")
def _(t):
    return t("f_entries").select("inode", F.sha2("content", 256).alias("h"))


@query("f13_md5", "select inode, md5(content) as h from f_entries")
def _(t):
    return t("f_entries").select("inode", F.md5("content").alias("h"))


@query(
    "f14_fnv1a",
    """select dir, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) as h from (select distinct dir,
      list_reduce(list_transform(string_split(dir, ''), lambda c: ord(c)::hugeint), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::hugeint, 14695981039346656037::hugeint) as h from f_entries)""",
)
def _(t):
    return t("f_entries").select("dir").distinct().select("dir", hashing.fnv1a_64(F.col("dir")).alias("h"))


@query("f15_addresses", "select event_id, 'h' || user_id || ':' || (8080 + user_id + 10000) as grpc, case when event_id % 2 = 0 then 'h' || user_id || ':777' else 'h' || user_id || ':' || (8080 + user_id - 10000) end as http from events")
def _(t):
    a = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(":"), (F.lit(8080) + F.col("user_id")).cast("string"))
    dotted = F.when(F.col("event_id") % 2 == 0, F.concat(a, F.lit(".777"))).otherwise(a)
    return t("events").select("event_id", codes.grpc_address(a).alias("grpc"), codes.http_address(dotted).alias("http"))


@query(
    "f16_version_id",
    "select event_id, array_to_string(list_transform([131621703842267136, 3656158440062976, 101559956668416, 2821109907456, 78364164096, 2176782336, 60466176, 1679616, 46656, 1296, 36, 1], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((1704067200000000000 + event_id) // p % 36 + 1)::integer, 1)), '') as v from events",
)
def _(t):
    return t("events").select("event_id", codes.version_id(F.lit(NOW * 1_000_000_000) + F.col("event_id")).alias("v"))


@query("f17_base64", "select inode, to_base64(encode(name)) as b, name as back from f_entries")
def _(t):
    b = F.base64("name")
    return t("f_entries").select("inode", b.alias("b"), F.decode(F.unbase64(b), "UTF-8").alias("back"))


_GLOBS = {"src1/*": "starts_with(k, 'src1/')", "*/en": "regexp_full_match(k, '[^/]*/en')", "src?/en/doc-*[05]": "regexp_full_match(k, 'src[^/]/en/doc-[^/]*[05]')", "src1[0-4]/*/doc-000000??": "regexp_full_match(k, 'src1[0-4]/[^/]*/doc-000000[^/][^/]')"}


@query("f18_glob", " union all ".join(f"select '{g}' as glob, substr(dir || '/' || name, 10) as key from f_entries where (select {c} from (select substr(dir || '/' || name, 10) as k))" for g, c in _GLOBS.items()))
def _(t):
    keys = _path(t).select(F.substring("path", 10, 2**30).alias("key"))
    hit = F.array(*[F.when(F.col("key").rlike(codes.glob_to_regex(g)), F.lit(g)) for g in _GLOBS])
    return keys.select(F.explode(F.array_compact(hit)).alias("glob"), "key")


@query("f19_json_documents", "select inode, name, file_size, disk_type = 'ssd' as fast from f_entries")
def _(t):
    doc = F.to_json(F.struct("name", "file_size", F.struct((F.col("disk_type") == "ssd").alias("fast")).alias("attr")))
    read = F.from_json(doc, "name string, file_size long, attr struct<fast: boolean>")
    return t("f_entries").select("inode", read.alias("r")).select("inode", "r.name", "r.file_size", "r.attr.fast")


@query("f21_access_key", "select event_id, case event_id % 4 when 0 then 'AK' || user_id when 1 then 'AK' || user_id when 2 then 'AK' || user_id end as k from events")
def _(t):
    k = F.concat(F.lit("AK"), F.col("user_id").cast("string"))
    n = F.col("event_id") % 4
    header = F.when(n == 0, F.concat(F.lit("AWS4-HMAC-SHA256 Credential="), k, F.lit("/20240101/us/s3/aws4_request, Signature=ab"))).when(n == 1, F.concat(F.lit("AWS "), k, F.lit(":sig")))
    q = F.when(n == 2, F.concat(F.lit("x=1&X-Amz-Credential="), k, F.lit("%2F20240101")))
    return t("events").select("event_id", codes.access_key(header, q).alias("k"))


@query("f22_client_ip", "select event_id, case event_id % 3 when 0 then '1.2.3.' || user_id % 256 when 1 then '4.4.4.4' else '9.9.9.' || user_id % 256 end as ip from events")
def _(t):
    u, n = (F.col("user_id") % 256).cast("string"), F.col("event_id") % 3
    forwarded = F.when(n == 0, F.concat(F.lit(" 1.2.3."), u, F.lit(", 5.5.5.5"))).when(n == 1, F.lit(" "))
    return t("events").select("event_id", codes.client_ip(forwarded, F.when(n == 1, F.lit("4.4.4.4")), F.concat(F.lit("9.9.9."), u, F.lit(":8080"))).alias("ip"))


@query("f23_days", "select inode, (1704067200 - mtime_sec) // 86400 as days, mtime_sec < 1704067200 - 7 * 86400 as old from f_entries")
def _(t):
    return t("f_entries").select("inode", F.floor((F.lit(NOW) - F.col("mtime_sec")) / 86400).alias("days"), expired(F.col("mtime_sec"), F.lit(7), NOW).alias("old"))


@query("f24_maps", "select inode, 'z' as a, name as b, cast(null as varchar) as c from f_entries")
def _(t):
    m = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("name"), F.lit("c"), F.lit("gone"))
    done = drop_attribute(put_attributes(m, F.create_map(F.lit("a"), F.lit("z"))), "c")
    return t("f_entries").select("inode", *[F.try_element_at(done, F.lit(k)).alias(k) for k in "abc"])


@query("p16_valid_names", "select inode, inode % 3 > 0 as name_ok, inode % 4 > 0 as path_ok from f_entries")
def _(t):
    name = F.when(F.col("inode") % 3 == 0, F.when(F.col("inode") % 2 == 0, F.lit("")).otherwise(F.repeat(F.lit("x"), F.lit(256)))).otherwise(F.col("name"))
    path = F.when(F.col("inode") % 4 == 0, F.concat("dir", F.lit("/%2e%2E/x"))).otherwise(F.concat("dir", F.lit("/..x")))
    return t("f_entries").select("inode", paths.valid_name(name).alias("name_ok"), paths.valid_path(path).alias("path_ok"))


@query("j2_chunk_urls", "select c.upload_id, c.part_number, string_agg(distinct 'http://n' || node, ',' order by 'http://n' || node) as urls from (select upload_id, part_number, (upload_id * 31 + part_number) % 2000 + 1 as vid from f_parts) c join f_topology t on c.vid = t.vid group by c.upload_id, c.part_number")
def _(t):
    chunks = t("f_parts").selectExpr("upload_id", "part_number", "(upload_id * 31 + part_number) % 2000 + 1 as vid")
    where = t("f_topology").groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("http://n"), F.col("node").cast("string")))), ",").alias("urls"))
    return chunks.join(where, "vid").select("upload_id", "part_number", "urls")


@query("ec_round_trip", "select inode, sha256(content) as h from f_entries")
def _(t):
    from quarry.operators import erasure

    own = t("f_entries").select("inode", F.encode("content", "UTF-8").alias("data"))
    shards = erasure.encode(own, "inode", 4, 2).where("shard_idx not in (1, 3)")
    return erasure.decode(shards, "inode", 4, 2).select("inode", F.sha2("data", 256).alias("h"))


@query(
    "ec_shards",
    """with o as (select inode, hex(encode(content)) as h, octet_length(encode(content)) as len, greatest(1, (octet_length(encode(content)) + 9) // 10) as width from f_entries)
    select inode, cast(i as int) as shard_idx, cast(width as int) as n, case when i < 10 then md5(unhex(substr(rpad(h, cast(20 * width as int), '0'), cast(1 + 2 * width * i as int), cast(2 * width as int)))) end as data_md5 from o, range(13) r(i)""",
)
def _(t):
    """Data shards by their content, parity shards by their size (tests hold parity against published bytes)."""
    from quarry.operators import erasure

    own = t("f_entries").select("inode", F.encode("content", "UTF-8").alias("data"))
    return erasure.encode(own, "inode").select("inode", "shard_idx", F.length("data").alias("n"), F.when(F.col("shard_idx") < 10, F.md5("data")).alias("data_md5"))


@query("k14_shard_manifest", "select cast(i as int) as shard_idx, count(*) as objects, cast(sum(greatest(1, (octet_length(encode(content)) + 9) // 10)) as bigint) as bytes from f_entries, range(13) r(i) group by i")
def _(t):
    from quarry.operators import erasure
    from quarry.sources.shared import shared_folder

    own = t("f_entries").select("inode", F.encode("content", "UTF-8").alias("data"))
    folder = f"{shared_folder(own.sparkSession)}/shards-{uuid.uuid4().hex}"
    erasure.write_shards(erasure.encode(own, "inode"), folder)
    return erasure.manifest(erasure.read_shards(own.sparkSession, folder, "long", "inode"))


#: A published example of the signature (the first of the service's own documentation): the request's day, region and string to sign.
_SIGNED = "AWS4-HMAC-SHA256\n20130524T000000Z\n20130524/us-east-1/s3/aws4_request\n7344ae5b7ee6c3e7e6b0fe0640412a37625d1fbfff95c48bbb2dc43964946972"


@query("f20_signature", "select event_id, 'f0e8bdb87c964420e857bd35b5d6ed310bd44f0170aba48dd91039c6036bdb41' as signature from events")
def _(t):
    from quarry.functions import hashing

    text = F.lit(_SIGNED)
    return t("events").select("event_id", hashing.signature(F.lit("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), F.lit("20130524"), F.lit("us-east-1"), text).alias("signature"))


@query("f25_split_command", "select event_id, 'volume.' || event_type || '|user ' || user_id || '|-force' as words from events")
def _(t):
    from quarry.functions import hashing

    line = F.concat(F.lit("volume."), F.col("event_type"), F.lit("  'user "), F.col("user_id").cast("string"), F.lit("' \"-force\""))
    return t("events").select("event_id", F.array_join(hashing.words_of(line), "|").alias("words"))

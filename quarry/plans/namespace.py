"""Queries over the namespace."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.paths import ancestors, full_path
from quarry.operators import namespace as ops
from quarry.plans.catalog import query
from quarry.sources.tables import NOW

_VISIBLE = r"not regexp_matches(substr(dir || '/' || name, 15), '(^|/)\.')"


@query("s5_list_directory", "select dir, name, file_size from f_entries where dir = '/buckets/src1/en' and name > 'doc-00000030' and starts_with(name, 'doc-') order by name limit 50")
def _(t):
    return ops.list_directory(t("f_entries"), "/buckets/src1/en", start="doc-00000030", prefix="doc-", limit=50).select("dir", "name", "file_size")


@query("s6_list_objects", rf"select substr(dir || '/' || name, 15) as key, file_size, mtime_sec from f_entries where (dir = '/buckets/src1' or starts_with(dir, '/buckets/src1/')) and {_VISIBLE} order by key")
def _(t):
    return ops.list_objects(t("f_entries"), "src1").select("key", "file_size", "mtime_sec")


@query("p3_list_objects_with_prefix", rf"select substr(dir || '/' || name, 15) as key from f_entries where starts_with(dir, '/buckets/src2/') and {_VISIBLE} and starts_with(substr(dir || '/' || name, 15), 'en/doc-0000')")
def _(t):
    return ops.list_objects(t("f_entries"), "src2", "en/doc-0000").select("key")


_TREE = """
with files as (select dir || '/' || name as path, false as is_dir, file_size as size, mtime_sec from f_entries where dir = '/buckets/src3' or starts_with(dir, '/buckets/src3/')),
parts as (select distinct string_split(dir, '/') as p from f_entries),
dirs as (select distinct array_to_string(p[1 : k], '/') as path from (select p, unnest(range(2, len(p) + 1)) as k from parts))
select path, is_dir, size, mtime_sec from files
union all select path, true, 0, 0 from dirs where path = '/buckets/src3' or starts_with(path, '/buckets/src3/')
"""


@query("s7_export_tree", _TREE)
def _(t):
    return ops.export_tree(t("f_entries"), "/buckets/src3")


@query("k3_backup_document", f"select regexp_replace(path, '/[^/]*$', '') as dir, {NOW} as generated_at, '/buckets/src3' as root, path, is_dir, size, mtime_sec from ({_TREE})")
def _(t):
    """The documents, read again."""
    docs = ops.backup_document(ops.export_tree(t("f_entries"), "/buckets/src3"), "/buckets/src3", NOW)
    kind = "generated_at int, root string, entries array<struct<path: string, is_dir: boolean, size: bigint, mtime_sec: bigint>>"
    each = docs.select("dir", F.from_json("doc", kind).alias("d")).select("dir", "d.generated_at", "d.root", F.explode("d.entries").alias("e"))
    return each.select("dir", "generated_at", "root", "e.path", "e.is_dir", "e.size", "e.mtime_sec")


@query("s8_list_buckets", "select distinct string_split(dir, '/')[3] as bucket from f_entries where not starts_with(string_split(dir, '/')[3], '.')")
def _(t):
    return ops.list_buckets(t("f_entries"))


@query("s9_find_entry", "select dir, name, file_size, mtime_sec from f_entries where dir = '/buckets/src2/fr' and name = 'doc-00000042' or (dir = '/buckets/src1/en' and name = 'doc-00000001')")
def _(t):
    e = t("f_entries")
    return ops.find_entry(e, "/buckets/src2/fr", "doc-00000042").unionByName(ops.find_entry(e, "/buckets/src1/en", "doc-00000001")).select("dir", "name", "file_size", "mtime_sec")


@query("s10_kv_get", "select upper(hex('dedup:' || doc_id)) as k, md5(text) as v from documents where doc_id in (7, 11, 13)")
def _(t):
    kv = t("documents").select(F.hex(F.concat(F.lit("dedup:"), F.col("doc_id").cast("string"))).alias("k"), F.md5("text").alias("v"))
    return ops.get_values(kv, [f"dedup:{i}".encode().hex().upper() for i in (7, 11, 13, 10**9)])


_CHANGES = """changes as (
  select dir, name, 1 as seq, file_size + 1 as file_size, mtime_sec + 5 as mtime_sec from f_entries where inode % 10 = 0
  union all select dir, name, 2, file_size + 2, mtime_sec + 6 from f_entries where inode % 20 = 0
  union all select dir, 'new-' || name, 1, file_size, mtime_sec from f_entries where inode % 50 = 0)"""


@query("k1_upsert_entries", f"with {_CHANGES} select dir, name, arg_max(file_size, seq) as file_size, arg_max(mtime_sec, seq) as mtime_sec from (select dir, name, 0 as seq, file_size, mtime_sec from f_entries union all select * from changes) group by dir, name")
def _(t):
    e = t("f_entries").select("dir", "name", "file_size", "mtime_sec", "inode")
    one = e.where("inode % 10 = 0").select("dir", "name", F.lit(1).alias("seq"), (F.col("file_size") + 1).alias("file_size"), (F.col("mtime_sec") + 5).alias("mtime_sec"))
    two = e.where("inode % 20 = 0").select("dir", "name", F.lit(2).alias("seq"), (F.col("file_size") + 2).alias("file_size"), (F.col("mtime_sec") + 6).alias("mtime_sec"))
    new = e.where("inode % 50 = 0").select("dir", F.concat(F.lit("new-"), "name").alias("name"), F.lit(1).alias("seq"), "file_size", "mtime_sec")
    return ops.upsert(e.drop("inode"), one.unionByName(two).unionByName(new))


@query("k6_delete_entries", "select dir, name, file_size from f_entries where inode % 3 <> 0")
def _(t):
    e = t("f_entries")
    return ops.delete_entries(e, e.where("inode % 3 = 0").select("dir", "name")).select("dir", "name", "file_size")


@query("k7_delete_children", "select dir, name from f_entries where not (dir = '/buckets/src1' or starts_with(dir, '/buckets/src1/'))")
def _(t):
    return ops.delete_children(t("f_entries"), "/buckets/src1").select("dir", "name")


@query("k8_delete_tree", "select dir, name from f_entries where not starts_with(dir || '/', '/buckets/src4/en/') and dir || '/' || name <> '/buckets/src4/en'")
def _(t):
    return ops.delete_tree(t("f_entries"), "/buckets/src4/en").select("dir", "name")


@query("k9_rename", "select case when inode = 1 then '/buckets/moved' else dir end as dir, case when inode = 1 then 'renamed' else name end as name, file_size from f_entries")
def _(t):
    return ops.rename(t("f_entries").select("inode", "dir", "name", "file_size"), F.col("inode") == 1, ("/buckets/moved", "renamed")).drop("inode")


@query(
    "k10_append_chunks",
    """with c as (select upload_id, part_number, size from f_parts), twice as (select upload_id, part_number as n, size, 0 as late from c union all select upload_id, part_number, size, 1 from c where part_number = 0)
    select upload_id, string_agg(concat(upload_id, '-', n, ':', size), ',' order by late, n) as chunks, count(*) as n_chunks from twice group by upload_id""",
)
def _(t):
    chunk = F.struct(F.concat_ws("-", F.col("upload_id").cast("string"), F.col("part_number").cast("string")).alias("file_id"), F.col("part_number").cast("long").alias("offset"), "size")
    own = t("f_parts").groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("part_number", chunk.alias("c")))).alias("l"))
    chunks = F.transform("l", lambda x: x["c"])
    both = ops.append_chunks(chunks, F.transform(F.filter("l", lambda x: x["part_number"] == 0), lambda x: x["c"]))
    return own.select("upload_id", F.array_join(F.transform(both, lambda c: F.concat_ws(":", c["file_id"], c["size"].cast("string"))), ",").alias("chunks"), F.size(both).cast("long").alias("n_chunks"))


@query(
    "k11_missing_directories",
    """with wanted as (select distinct string_split(dir || '/sub/' || name, '/') as p from f_entries), every as (select distinct array_to_string(p[1 : k], '/') as path from (select p, unnest(range(2, len(p))) as k from wanted))
    select path from every where path not in (select distinct dir from f_entries)""",
)
def _(t):
    e = t("f_entries")
    return ops.missing_directories(e.select(F.concat("dir", F.lit("/sub/"), "name").alias("path")), e.select(F.col("dir").alias("path")).distinct())


@query("k12_bulk_delete", "select substr(dir || '/' || name, 10) as key from f_entries where not (inode < 500 and inode % 2 = 0)")
def _(t):
    objects = t("f_entries").select(F.substring(full_path(F.col("dir"), F.col("name")), 10, 2**30).alias("key"), "inode")
    blank = objects.limit(1).select(F.lit("  ").alias("key"))
    left, _ = ops.bulk_delete(objects, objects.where("inode < 500 and inode % 2 = 0").select("key").unionByName(blank))
    return left.select("key")


@query(
    "k13_put_attributes",
    "select inode, case when inode % 2 = 0 then 'COLD' else 'HOT' end as class, disk_type as disk, case when inode % 3 = 0 then null else name end as owner from f_entries",
)
def _(t):
    e = t("f_entries")
    own = F.create_map(F.lit("class"), F.lit("HOT"), F.lit("disk"), F.col("disk_type"), F.lit("owner"), F.col("name"))
    new = F.when(F.col("inode") % 2 == 0, F.create_map(F.lit("class"), F.lit("COLD"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    put = ops.put_attributes(own, new)
    done = F.when(F.col("inode") % 3 == 0, ops.drop_attribute(put, "owner")).otherwise(put)
    return e.select("inode", done.alias("m")).select("inode", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("class", "disk", "owner")])


@query("p19_list_view", "select name || '/' as name, cast(0 as bigint) as size from (select distinct string_split(dir, '/')[4] as name from f_entries where starts_with(dir, '/buckets/src5/')) union all select name, file_size from f_entries where dir = '/buckets/src5/de'")
def _(t):
    e = t("f_entries")
    dirs = ops.directories(e, "/buckets/src5").where("path <> '/buckets/src5'").select(F.concat(F.substring_index("path", "/", -1), F.lit("/")).alias("name"), F.lit(0).cast("long").alias("size"))
    return dirs.unionByName(ops.list_directory(e, "/buckets/src5/de").select("name", F.col("file_size").alias("size")))


@query("l2_next_cursor", "select max(name) as cursor from (select name from f_entries where dir = '/buckets/src1/en' and name >= 'doc-00000001' order by name limit 10)")
def _(t):
    return ops.next_cursor(ops.list_directory(t("f_entries"), "/buckets/src1/en", "doc-00000001", include_start=True, limit=10))


@query("l4_capped_listing", "select dir, name from (select dir, name, row_number() over (partition by dir order by name) as k from f_entries) where k <= 7")
def _(t):
    return ops.capped_listing(t("f_entries"), 7).select("dir", "name")


@query("a20_non_empty_buckets", "with n as (select 'src' || b as bucket from range(0, 40) r(b)) select bucket from n where bucket in (select string_split(dir, '/')[3] from f_entries where not regexp_matches(name, '^[.]'))")
def _(t):
    e = t("f_entries")
    names = e.sparkSession.range(40).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("bucket"))
    return ops.non_empty(e, names)


@query("x1_group_by_delimiter", rf"select string_split(substr(dir || '/' || name, 15), '/')[1] || '/' as key, count(*) as n from f_entries where starts_with(dir, '/buckets/src1/') and {_VISIBLE} group by 1")
def _(t):
    return ops.group_by_delimiter(ops.list_objects(t("f_entries"), "src1"))


@query("u5_ancestors", "select distinct dir, array_to_string(p[1 : k], '/') as above from (select dir, string_split(dir, '/') as p, unnest(range(2, 4)) as k from f_entries)")
def _(t):
    return t("f_entries").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))

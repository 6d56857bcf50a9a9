"""Namespace operators: listings, lookups and changes over entries(dir, name, ...).

Listings are one scan with a range on dir, not a walk: Parquet's statistics prune it where files are laid out by dir and name.
Changes return the new table; deletes are anti joins or filters, upserts the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import ancestors, below, full_path, hidden
from quarry.plans.rewrite import prefix_range


def list_directory(entries: DataFrame, directory: str, start: str = "", include_start: bool = False, prefix: str = "", limit: int | None = None) -> DataFrame:
    """A page of a directory in byte order of names: after (or from) a start name, with a literal prefix.  No limit: all."""
    found = entries.where(F.col("dir") == directory)
    if start:
        found = found.where(F.col("name") >= start if include_start else F.col("name") > start)
    if prefix:
        found = found.where(prefix_range(F.col("name"), prefix))
    found = found.orderBy("name")
    return found if limit is None else found.limit(limit)


def next_cursor(page: DataFrame) -> DataFrame:
    """The name to go on after."""
    return page.agg(F.max("name").alias("cursor"))


def list_objects(entries: DataFrame, bucket: str, prefix: str = "", root: str = "/buckets") -> DataFrame:
    """Objects below a bucket, hidden parts left out: key and the entry's columns, by key."""
    top = f"{root}/{bucket}"
    inside = entries.where((F.col("dir") == top) | prefix_range(F.col("dir"), top + "/"))
    path = full_path(F.col("dir"), F.col("name"))
    keyed = inside.withColumn("key", F.substring(path, len(top) + 2, 2**30)).where(~hidden(F.col("key")))
    if prefix:
        keyed = keyed.where(F.col("key").startswith(prefix))
    return keyed.orderBy("key")


def group_by_delimiter(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """An extension: keys up to the next delimiter after the prefix, with how many objects each stands for."""
    rest = F.substring(F.col("key"), len(prefix) + 1, 2**30)
    common = F.when(F.contains(rest, F.lit(delimiter)), F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    return objects.where(F.col("key").startswith(prefix)).groupBy(common.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def list_buckets(entries: DataFrame, root: str = "/buckets") -> DataFrame:
    """Visible directories right below the root."""
    rest = F.substring(F.col("dir"), len(root) + 2, 2**30)
    return entries.where(prefix_range(F.col("dir"), root + "/")).select(F.substring_index(rest, "/", 1).alias("bucket")).distinct().where(~hidden(F.col("bucket"))).orderBy("bucket")


def directories(entries: DataFrame, root: str = "/") -> DataFrame:
    """All directories that entries lie in and those above them, from the root given downwards."""
    every = entries.select("dir").distinct().select(F.explode(F.array_append(ancestors(F.col("dir")), F.col("dir"))).alias("path")).distinct()
    return every.where(below(F.col("path"), root))


def export_tree(entries: DataFrame, root: str) -> DataFrame:
    """(path, is_dir, size, mtime_sec) of a subtree, parents before children."""
    files = entries.where(below(F.col("dir"), root)).select(full_path(F.col("dir"), F.col("name")).alias("path"), F.lit(False).alias("is_dir"), F.col("file_size").alias("size"), "mtime_sec")
    dirs = directories(entries, root).select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_sec"))
    # a slash sorts before all other characters, so a directory's children follow it at once
    return files.unionByName(dirs).orderBy(F.split("path", "/"))


def backup_document(tree: DataFrame, root: str, generated_at: int) -> DataFrame:
    """One JSON text a directory, each with its part of the backup: a tree of any size stays distributed."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    each = F.struct("path", "is_dir", "size", "mtime_sec")
    return tree.groupBy(parent.alias("dir")).agg(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.lit(root).alias("root"), F.array_sort(F.collect_list(each)).alias("entries"))).alias("doc"))


def find_entry(entries: DataFrame, directory: str, name: str) -> DataFrame:
    return entries.where((F.col("dir") == directory) & (F.col("name") == name))


def get_values(kv: DataFrame, keys: list[str]) -> DataFrame:
    """Values under keys; those without one are left out."""
    return kv.where(F.col("k").isin(keys))


def upsert(entries: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("dir", "name")) -> DataFrame:
    """entries with changes put in or over them; of several changes of a key that with the greatest seq wins."""
    rest = [c for c in entries.columns if c not in keys]
    log = entries.select(*keys, F.lit(-(2**62)).alias("seq"), *rest).unionByName(changes.select(*keys, "seq", *rest))
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("latest"))
    return latest.select(*keys, "latest.*").select(*entries.columns)


def delete_entries(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries without the (dir, name) given; missing ones are no error."""
    return entries.join(gone.select("dir", "name"), ["dir", "name"], "left_anti")


def delete_children(entries: DataFrame, directory: str) -> DataFrame:
    """All below a directory goes, at any depth; the directory's own entry stays."""
    return entries.where(~below(F.col("dir"), directory))


def delete_tree(entries: DataFrame, root: str) -> DataFrame:
    """A path and all below it go."""
    return entries.where(~below(full_path(F.col("dir"), F.col("name")), root))


def rename(entries: DataFrame, old: tuple[str, str] | Column, new: tuple[str, str], children: bool = False) -> DataFrame:
    """One entry moves; what stood at the new place is replaced.  children: what lies below moves too.
    The entry is named by its place (dir, name), or found by a condition, such as on its inode, wherever it stands."""
    by_place = isinstance(old, tuple)
    if children and not by_place:
        raise ValueError("children move with an entry that is named by its place")
    new_dir, new_name = new
    own = (F.col("dir") == old[0]) & (F.col("name") == old[1]) if by_place else F.coalesce(old, F.lit(False))
    same = F.lit(old == new) if by_place else own
    stay = entries.where(~(F.col("dir").eqNullSafe(new_dir) & F.col("name").eqNullSafe(new_name)) | same)
    placed = {"dir": new_dir, "name": new_name}
    moved = stay.select(*[F.when(own, F.lit(placed[c])).otherwise(F.col(c)).alias(c) if c in placed else F.col(c) for c in stay.columns])
    if not children:
        return moved
    (old_dir, old_name) = old
    a, b = f"{old_dir.rstrip('/')}/{old_name}", f"{new_dir.rstrip('/')}/{new_name}"
    return moved.withColumn("dir", F.when(below(F.col("dir"), a), F.concat(F.lit(b), F.substring("dir", len(a) + 1, 2**30))).otherwise(F.col("dir")))


def append_chunks(chunks: Column, more: Column) -> Column:
    """Chunk lists end to end; equal chunks stay twice and offsets as they are."""
    return F.concat(F.coalesce(chunks, F.array().cast("array<struct<file_id: string, offset: bigint, size: bigint>>")), more)


def missing_directories(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Directories to make so that each path in wanted(path) has its parents."""
    every = wanted.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return every.join(existing.select("path"), "path", "left_anti")


def bulk_delete(objects: DataFrame, keys: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Objects left, and the keys reported as deleted: every key that isn't blank, whether there was an object or not.
    A request names at most `most` keys, as the interface has it."""
    named = keys.where(F.trim("key") != "")
    if named.limit(most + 1).count() > most:
        raise ValueError(f"a request may name {most} keys")
    return objects.join(named.select("key"), "key", "left_anti"), named.select("key")


def put_attributes(attributes: Column, new: Column) -> Column:
    """A map with other entries put over its own."""
    kept = F.map_filter(attributes, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def drop_attribute(attributes: Column, key: str) -> Column:
    return F.map_filter(attributes, lambda k, v: k != key)


def non_empty(entries: DataFrame, names: DataFrame, root: str = "/buckets") -> DataFrame:
    """Those of names(bucket) that hold a visible object."""
    rest = F.substring(full_path(F.col("dir"), F.col("name")), len(root) + 2, 2**30)
    key = F.substring(rest, F.instr(rest, "/") + 1, F.length(rest))
    holders = entries.where(F.contains(rest, F.lit("/")) & ~hidden(key)).select(F.substring_index(rest, "/", 1).alias("bucket"))
    return names.join(holders, "bucket", "left_semi")


def capped_listing(entries: DataFrame, most: int = 10_000) -> DataFrame:
    """Each directory's first entries by name; only for results equal to a store that caps its listings."""
    from pyspark.sql import Window

    order = Window.partitionBy("dir").orderBy("name")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")

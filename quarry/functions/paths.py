"""Paths of a namespace, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """The path from the root, without empty, `.` and `..` parts; `..` at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def base_name(path: Column) -> Column:
    """What follows the last slash: empty for the root."""
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """What goes before the last slash; the root for what lies in it and for names without a slash."""
    head = F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    return F.when(F.contains(path, F.lit("/")) & (head != ""), head).otherwise(F.lit("/"))


def join_path(directory: Column, name: Column) -> Column:
    return clean_path(F.concat_ws("/", directory, name))


def full_path(directory: Column, name: Column) -> Column:
    """A child's path; directory is clean already."""
    return F.concat(F.when(directory == "/", F.lit("")).otherwise(directory), F.lit("/"), name)


def ancestors(path: Column) -> Column:
    """All directories above a clean path but the root, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def bucket_of(path: Column) -> Column:
    """The first part of bucket/key, with or without a slash before it."""
    return F.substring_index(F.ltrim(path, F.lit("/")), "/", 1)


def key_of(path: Column) -> Column:
    """What follows the bucket; empty without a key."""
    own = F.ltrim(path, F.lit("/"))
    return F.when(F.contains(own, F.lit("/")), F.substring(own, F.instr(own, "/") + 1, F.length(own))).otherwise(F.lit(""))


def hidden(path: Column) -> Column:
    """Whether any part starts with a dot."""
    return path.rlike(r"(^|/)\.")


def below(path: Column, root: str) -> Column:
    """Whether a path is the root given or lies under it."""
    if root == "/":
        return F.lit(True)
    return (path == root) | path.startswith(root + "/")


def valid_path(path: Column) -> Column:
    """No part may be two dots, also after percent-decoding."""
    return F.coalesce(~F.url_decode(path).rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def valid_name(name: Column) -> Column:
    """1 to 255 bytes, no slash, no zero byte, not a dot name."""
    return F.octet_length(name).between(1, 255) & ~name.rlike(r"[/\x00]") & ~name.isin(".", "..")

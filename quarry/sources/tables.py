"""Input tables, and the views over them that have the shapes of a blob store's metadata.

A view is one SQL text that Spark and DuckDB both run; names in braces are tables or other views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-01T00:00:00Z: operators take the time as a parameter, the registered queries use this.
NOW = 1704067200

VIEWS = {
    "f_entries": """select doc_id as inode, concat('/buckets/', source, '/', lang) as dir,
        concat(case when doc_id % 17 = 0 then '.' else '' end, 'doc-', lpad(cast(doc_id as varchar(20)), 8, '0')) as name,
        n_chars as file_size, text as content, 1704067200 - (doc_id % 400) * 86400 as mtime_sec,
        case when doc_id % 2 = 0 then 'ssd' else 'hdd' end as disk_type from {documents}""",
    "f_needle_log": """select event_id as pos, user_id % 4 as vid, user_id * 8 + event_id % 8 as needle_key,
        case when event_type = 'error' then cast(0 as bigint) else cast(floor(value * 100) as bigint) + 8 end as size from {events}""",
    "f_topology": """select distinct r.r_name as dc, n.n_name as rack, s.s_suppkey as node, l.l_partkey + 1 as vid
        from {lineitem} l join {supplier} s on l.l_suppkey = s.s_suppkey join {nation} n on s.s_nationkey = n.n_nationkey
        join {region} r on n.n_regionkey = r.r_regionkey""",
    "f_nodes": "select s_suppkey as node, s_suppkey % 7 as free_slots from {supplier}",
    "f_quota_log": """select event_id as seq, user_id, case when event_type in ('error', 'view') then -cast(floor(value * 100) as bigint)
        else cast(floor(value * 100) as bigint) end as delta from {events}""",
    "f_samples": "select event_id as seq, event_type as op, event_type <> 'error' as ok, cast(floor(value * 1000000) as bigint) as latency_ns from {events}",
    "f_parts": "select conv_id as upload_id, turn as part_number, text as data, md5(text) as etag, cast(length(text) as bigint) as size from {conversations}",
    "f_feed": """select event_id as seq, case when event_type in ('purchase', 'signup', 'click') then 'create' else 'delete' end as op,
        concat('/buckets/b', cast(user_id as varchar(20))) as dir, concat('o', cast(event_id % 7 as varchar(20))) as name from {events}""",
    "f_files": "select o_orderkey as file_id, cast(floor(o_totalprice) as bigint) as file_size from {orders}",
    "f_conf_rules": """select * from (values ('/buckets/', 'c-default', '000'), ('/buckets/src1', 'c-src1', '001'), ('/buckets/src1/en', 'c-en', '010'))
        as t(path_prefix, collection, replication)""",
    "f_lifecycle_rules": """select * from (values (0, '/buckets/src1', 30, 0, '', 'Enabled'), (1, '/buckets/', 0, 60, 'STANDARD_IA', 'Enabled'),
        (2, '/buckets/', 300, 0, '', 'Enabled'), (3, '/buckets/', 0, 200, 'GLACIER', 'Enabled'), (4, '/buckets/', 1, 0, '', 'Disabled'))
        as t(rule_idx, prefix, expire_days, transition_days, storage_class, status)""",
    "f_grants": "select * from (values ('u-read', 'Read'), ('u-admin', 'Admin'), ('u-scoped', 's3:GetObject:src1/*'), ('u-exact', 's3:PutObject')) as t(identity, grant_str)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet, or a view over such tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    parts = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **parts)


def oracle(sql: str) -> str:
    """SQL for DuckDB over the tables: views that the text names become common table expressions before it."""
    own = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in own]
    sql = sql.strip()
    if not heads:
        return sql
    if sql.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(heads) + ", " + sql[len("with recursive ") :]
    return "with " + ", ".join(heads) + (", " + sql[5:] if sql.lower().startswith("with ") else " " + sql)


def write_entries(entries: DataFrame, path: str, partitions: int | None = None) -> None:
    """Entries as Parquet laid out for listings: files hold ranges of (dir, name) in order, so that the statistics of files
    and row groups prune a listing to where it lies.  Ranges also part a directory that holds most of the entries."""
    from pyspark.sql import functions as F

    keys = [F.col("dir"), F.col("name")]
    dealt = entries.repartitionByRange(partitions, *keys) if partitions else entries.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)

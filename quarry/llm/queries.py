"""The operators applied to their whole tables, as queries, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, quality_rules, secret_scan, simhash, substring_dedup, token_counts, url_filters, weak_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a vocabulary lies: the public tokenizers' package, unless TOKENIZER_DIR names a folder."""
    own = os.environ.get("TOKENIZER_DIR")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


#: The query's list is made from the hosts in pages by rule: a host whose MD5 starts with one of 0 to 5 goes on the list, comes
#: off it and goes on again; so do site domains and the first path below a host, which is written in one of four
#: ways: as it is, without its last slash, with the host in upper case and a port, or the host alone with a scheme.
#: Fetch times are spread over 2024.
_START, _YEAR = 1704067200, 31622400
_ENTRIES = """
with hosts as (
  select distinct lower({host}) as host from pages
), named as (
  select 'domain' as kind, host as pattern, md5(host) as h from hosts where substr(md5(host), 1, 1) < '6'
  union all
  select distinct 'domain', site, md5(site) from (select regexp_extract(host, '([^.]+[.][^.]+)$', 1) as site from hosts) where substr(md5(site), 1, 1) < '4'
  union all
  select distinct 'prefix', case when substr(md5(p), 10, 1) < '4' then p when substr(md5(p), 10, 1) < '8' then concat(h, regexp_replace(d, '/$', ''))
    when substr(md5(p), 10, 1) < 'c' then concat(upper(h), ':8080', d) else concat('https://', upper(h), '.') end, md5(p)
  from (select lower({host}) as h, {path} as d, concat(lower({host}), {path}) as p from pages) where substr(md5(p), 1, 1) < '4'
), timed as (
  select kind, pattern, {hex1} as a, {hex2} as b from named
)
select kind, pattern, 'add' as action, 1704067200 + a * 200 as ts from timed
union all
select kind, pattern, 'remove', 1704067200 + a * 200 + b * 300 from timed where b % 3 <> 0
union all
select kind, pattern, 'add', 1704067200 + a * 200 + b * 400 from timed where b % 3 = 1
"""


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(_START) + F.pmod(F.col("page_id") * 7919 * 13, F.lit(_YEAR)))
    sql = _ENTRIES.format(host="regexp_extract(url, '//([^/?#:@]*)', 1)", path="regexp_extract(url, '//[^/?#]*(/[^/?#]*/)', 1)", hex1="cast(conv(substr(h, 2, 4), 16, 10) as bigint)", hex2="cast(conv(substr(h, 6, 4), 16, 10) as bigint)")
    entries = spark.sql(sql.replace("from pages", "from {pages}"), pages=pages)
    return url_filters.url_filter(captures, entries, at="ts")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, *langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated")


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weak_quality.classify(docs, weak_quality.train(docs))


def _of_kind(k: int) -> Callable:
    return lambda x: x["kind"] == k


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    base = secret_scan.KINDS[:3]
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(base)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.named(F.col("base")), 256).alias("base_sha256"), secret_scan.named(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_url_filters": op3_url_filters,
        "op4_simhash": op4_simhash,
        "op5_langid": op5_langid,
        "op6_bpe": op6_bpe,
        "op7_quality_rules": op7_quality_rules,
        "op8_decontaminate": op8_decontaminate,
        "op9_weak_quality": op9_weak_quality,
        "op10_secret_scan": op10_secret_scan,
    }


_OP1 = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 11)) as p, w from words where len(w) >= 13
), named as (
  select doc_id, p, array_to_string(w[p : p + 12], ' ') as t from windows
), judged as (
  select doc_id, p, doc_id > min(doc_id) over (partition by t) as again from named
), gone as (
  select distinct doc_id, unnest(range(p, p + 13)) as p from judged where again
), lists as (
  select doc_id, list(p) as g from gone group by doc_id
)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(g), 0) as bigint) as n_removed,
  sha256(array_to_string(case when g is null then w else list_filter(w, lambda x, i: not list_contains(g, i)) end, ' ')) as kept_sha256
from words left join lists on words.doc_id = lists.doc_id
"""


_OP8 = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), windows as (
  select item_id, least(13, len(w)) as n, w[p : p + least(13, len(w)) - 1] as v
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as p from iw where len(w) > 0)
), sizes as (
  select distinct n from windows
), places as (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, sizes where len(w) >= n)
), hits as (
  select doc_id, places.n, p, item_id from places join windows on places.n = windows.n and t = array_to_string(v, ' ')
), covered as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id
), named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by doc_id
)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered on dw.doc_id = covered.doc_id left join named on dw.doc_id = named.doc_id
"""


_OP3 = (
    "with entries as ("
    + _ENTRIES.format(host="regexp_extract(url, '//([^/?#:@]*)', 1)", path="regexp_extract(url, '//[^/?#]*(/[^/?#]*/)', 1)", hex1="cast('0x' || substr(h, 2, 4) as bigint)", hex2="cast('0x' || substr(h, 6, 4) as bigint)")
    + r"""), plain as (
  select kind, regexp_replace(pattern, '^https://', '') as p, action, ts from entries
), normal as (
  select kind, regexp_replace(regexp_replace(lower(split_part(p, '/', 1)), ':[0-9]*$', ''), '[.]$', '') || substr(p, length(split_part(p, '/', 1)) + 1) as pattern, action, ts from plain
), last_action as (
  select kind, pattern, ts, max(action) as action from normal group by kind, pattern, ts
), spans as (
  select kind, pattern, action, ts as from_at, coalesce(lead(ts) over (partition by kind, pattern order by ts), 4611686018427387904) as until_at from last_action
), captures as (
  select page_id, url, 1704067200 + (page_id * 7919 * 13) % 31622400 as fetched_at, lower(regexp_extract(url, '//([^/?#:@]*)', 1)) as host,
    regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1) as path from pages
), hits as (
  select distinct c.page_id, s.kind, s.pattern
  from captures c join spans s on s.action = 'add' and s.from_at <= c.fetched_at and c.fetched_at < s.until_at
    and case when s.kind = 'domain' then c.host = s.pattern or ends_with(c.host, '.' || s.pattern)
      else starts_with(c.host || c.path, s.pattern) and (ends_with(s.pattern, '/') or c.host || c.path = s.pattern or substr(c.host || c.path, length(s.pattern) + 1, 1) = '/') end
), found as (
  select page_id, count(*) as n_matches, max(struct_pack(n := length(pattern), d := kind = 'domain', pattern := pattern, kind := kind)) as best from hits group by page_id
)
select c.page_id, c.url, c.fetched_at, best is not null as blocked, cast(coalesce(n_matches, 0) as bigint) as n_matches, best.pattern as pattern, best.kind as kind
from captures c left join found on c.page_id = found.page_id
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _OP1,
        "op3_url_filters": _OP3,
        "op8_decontaminate": _OP8,
    }

"""Identifiers, packed codes and sizes of a blob store, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = r"^[0-9a-fA-F]+$"
#: Seconds of a time-to-live unit: minute, hour, day, week, month of 30 days, year of 365.
TTL_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000, "y": 31536000}


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def parse_file_id(text: Column) -> Column:
    """struct(vid, needle, cookie) of "vid,needlecookie"; the last eight digits are the cookie.  Null if malformed."""
    vid, rest = F.substring_index(text, ",", 1), F.substring(text, F.instr(text, ",") + 1, F.length(text))
    good = F.contains(text, F.lit(",")) & vid.rlike(r"^[0-9]{1,10}$") & rest.rlike(HEX) & F.length(rest).between(9, 24)
    n = F.length(rest)
    needle, cookie = F.substring(rest, F.lit(1), n - 8), F.substring(rest, n - 7, F.lit(8))
    parsed = F.struct(vid.cast("long").alias("vid"), from_hex(needle).alias("needle"), F.conv(cookie, 16, 10).cast("long").alias("cookie"))
    return F.when(good & (F.when(good, vid.cast("long")).otherwise(F.lit(0)) < 2**32), parsed)


def format_file_id(vid: Column, needle: Column, cookie: Column) -> Column:
    """needle and cookie are whole numbers below 2^63 and 2^32."""
    return F.concat(vid.cast("string"), F.lit(","), F.lower(F.lpad(F.hex(needle.cast("long")), 16, "0")), F.lower(F.lpad(F.hex(cookie.cast("long")), 8, "0")))


def volume_of(text: Column) -> Column:
    """The volume of a file id, or of plain digits; null otherwise."""
    plain = F.when(text.rlike(r"^[0-9]{1,10}$"), text.cast("long"))
    return F.coalesce(parse_file_id(text)["vid"], F.when(plain < 2**32, plain))


def placement_byte(dc: Column, rack: Column, same: Column) -> Column:
    """Three, three and two bits."""
    return F.shiftleft(dc.bitwiseAND(7), 5).bitwiseOR(F.shiftleft(rack.bitwiseAND(7), 2)).bitwiseOR(same.bitwiseAND(3))


def placement_parts(byte: Column) -> Column:
    return F.struct(F.shiftright(byte, 5).bitwiseAND(7).alias("dc"), F.shiftright(byte, 2).bitwiseAND(7).alias("rack"), byte.bitwiseAND(3).alias("same"))


def placement_of_text(text: Column) -> Column:
    """struct of three digits; null if they are not."""
    digit = lambda k: F.substring(text, k, 1).cast("int")
    return F.when(text.rlike("^[0-9]{3}$"), F.struct(digit(1).alias("dc"), digit(2).alias("rack"), digit(3).alias("same")))


def total_copies(p: Column) -> Column:
    return p["dc"] + p["rack"] + p["same"] + 1


def ttl_seconds(text: Column) -> Column:
    """0 for none; null if malformed.  m is a minute and M a month."""
    count, unit = F.regexp_extract(text, r"^([0-9]{1,3})([mhdwMy])$", 1), F.regexp_extract(text, r"^([0-9]{1,3})([mhdwMy])$", 2)
    each = F.lit(None).cast("long")
    for u, s in TTL_SECONDS.items():
        each = F.when(unit == u, F.lit(s).cast("long")).otherwise(each)
    n = F.when(count != "", count.cast("long"))
    return F.when(text == "", F.lit(0).cast("long")).when(n < 256, n * each)


def offset_stored(offset: Column) -> Column:
    return F.floor(offset / 8).cast("long")


def offset_real(stored: Column) -> Column:
    return (stored * 8).cast("long")


def padding(n: Column) -> Column:
    """Bytes up to the next multiple of eight."""
    return F.pmod(-n, F.lit(8))


def needle_disk_size(data: Column, name: Column, mime: Column, pairs: Column, has_modified: Column, has_ttl: Column, version: Column) -> Column:
    """Bytes that a record takes: header, body, footer (with the time of appending in version 3) and padding."""
    optional = lambda n, head: F.when(n > 0, n + head).otherwise(0)
    body = 4 + data + 1 + optional(name, 1) + optional(mime, 1) + optional(pairs, 2) + F.when(has_modified, 5).otherwise(0) + F.when(has_ttl, 2).otherwise(0)
    raw = 16 + body + F.when(version == 3, 12).otherwise(4)
    return (raw + padding(raw)).cast("long")


def grpc_address(address: Column, shift: int = 10000) -> Column:
    """host:port to its RPC address: port + shift, or the port after a dot if one is given."""
    host, port = F.substring_index(address, ":", 1), F.substring_index(address, ":", -1)
    return F.when(F.contains(port, F.lit(".")), F.concat(host, F.lit(":"), F.substring_index(port, ".", -1))).otherwise(F.concat(host, F.lit(":"), (F.substring_index(port, ".", 1).cast("long") + shift).cast("string")))


def http_address(address: Column, shift: int = 10000) -> Column:
    return grpc_address(address, -shift)


def version_id(ns: Column) -> Column:
    return F.lower(F.conv(ns.cast("string"), 10, 36))


def glob_to_regex(pattern: str) -> str:
    """A path glob as a regular expression: * and ? don't cross a slash, [..] is a class, \\ quotes; a trailing /*
    takes the whole subtree."""
    import re

    if pattern.endswith("/*"):
        return f"^{re.escape(pattern[:-1])}.*$" if not re.search(r"[*?\[\\]", pattern[:-2]) else f"^{_glob(pattern[:-1])}.*$"
    return f"^{_glob(pattern)}$"


def _glob(pattern: str) -> str:
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i:end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "^" else inner).replace("[", r"\[") + "]"
            i = end + 1
        elif c == "\\" and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        else:
            out += re.escape(c)
    return out


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """The first forwarded address, else the real one, else the peer's without its port."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(F.substring_index(forwarded, ",", 1)), blank(real), F.regexp_replace(remote, r":[0-9]+$", ""))


def access_key(authorization: Column, query: Column) -> Column:
    """The key of a signed request: from Credential=, from the older AWS key:signature, or from the query string."""
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(pick(authorization, r"Credential=([^/,\s]+)"), pick(authorization, r"^AWS ([^:\s]+):"), pick(query, r"(?:^|&)X-Amz-Credential=([^/&%]+)"), pick(query, r"(?:^|&)AWSAccessKeyId=([^&]+)"))


def ipv4(text: Column) -> Column:
    """An address as a number; null if it isn't one."""
    good = text.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$") & ~text.endswith(".")
    part = lambda k: F.split(text, r"\.")[k].cast("long")
    return F.when(good, F.shiftleft(part(0), 24) + F.shiftleft(part(1), 16) + F.shiftleft(part(2), 8) + part(3))


def snowflake(ms: Column, node: Column, seq: Column) -> Column:
    return F.shiftleft(ms.cast("long"), 22).bitwiseOR(F.shiftleft(node.cast("long"), 12)).bitwiseOR(seq.cast("long"))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(100)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.floor(done * 100 / total)))).cast("long")


def backoff_ms(attempt: Column, first: int = 500, most: int = 30000) -> Column:
    """The wait before each try, doubled up to the most."""
    return F.least(F.lit(most), first * F.pow(F.lit(2), F.least(attempt, F.lit(20)))).cast("long")

"""Hashes and signatures that Spark has no function for; Arrow batches, whole columns at a time."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 64 bits: offset basis and prime.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    """FNV-1a as a signed 64-bit number."""
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def fnv1a_of(texts: list[bytes]) -> np.ndarray:
    """Of many texts at once: a step for each place, over those texts that reach it."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order], np.int64)
    data, first = np.frombuffer(b"".join(texts[i] for i in order), np.uint8), np.cumsum(size) - size
    h = np.full(len(texts), FNV_BASIS, np.uint64)
    live = len(texts)
    for at in range(int(size.max(initial=0))):
        while size[live - 1] <= at:
            live -= 1
        h[:live] = (h[:live] ^ data[first[:live] + at]) * np.uint64(FNV_PRIME)
    out = np.empty(len(texts), np.int64)
    out[order] = h.view(np.int64)
    return out


def fnv1a_64(text: Column) -> Column:
    """For tables laid out by it; xxhash64 is the one to use otherwise."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        there = s.notna()
        out = pd.Series(None, index=s.index, dtype="Int64")
        out[there] = fnv1a_of([t.encode() for t in s[there]])
        return out

    return run(text)


def signing_key(secret: str, date: str, region: str, service: str = "s3") -> bytes:
    key = ("AWS4" + secret).encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def canonical_query(query: Column) -> Column:
    """The parameters sorted, each with an equals sign, without the signature itself."""
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("X-Amz-Signature="))
    return F.array_join(F.array_sort(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")


def canonical_request(method: Column, path: Column, query: Column, headers: Column, signed: Column, payload_hash: Column) -> Column:
    """headers: a map in lower case; signed: their names in order, joined by semicolons."""
    lines = F.transform(F.split(signed, ";"), lambda h: F.concat(h, F.lit(":"), F.regexp_replace(F.trim(F.coalesce(F.try_element_at(headers, h), F.lit(""))), r" +", " "), F.lit("\n")))
    return F.concat_ws("\n", method, path, canonical_query(query), F.array_join(lines, ""), signed, payload_hash)


def string_to_sign(timestamp: Column, scope: Column, request: Column) -> Column:
    return F.concat_ws("\n", F.lit("AWS4-HMAC-SHA256"), timestamp, scope, F.sha2(request, 256))


def signature(secret: Column, date: Column, region: Column, text: Column) -> Column:
    """The signature of a string to sign, in hexadecimal."""

    @F.pandas_udf("string")
    def run(s: pd.Series, d: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
        keys: dict[tuple, bytes] = {}
        out = []
        for own in zip(s, d, r, t, strict=True):
            key = keys.get(own[:3]) or keys.setdefault(own[:3], signing_key(*own[:3]))
            out.append(hmac.new(key, own[3].encode(), hashlib.sha256).hexdigest())
        return pd.Series(out)

    return run(secret, date, region, text)


def split_command(line: str) -> list[str]:
    """Words of a command line; quotes hold spaces, a backslash takes the next character as it is."""
    words, word, quote, own, i = [], "", "", False, 0
    while i < len(line):
        c = line[i]
        if c == "\\" and quote != "'" and i + 1 < len(line):
            i += 1
            word, own = word + line[i], True
        elif quote:
            quote = "" if c == quote else quote
            word += "" if not quote and c in "'\"" else c
        elif c in "'\"":
            quote, own = c, True
        elif c.isspace():
            if own or word:
                words.append(word)
            word, own = "", False
        else:
            word += c
        i += 1
    if quote:
        raise ValueError("a quote is not closed")
    return words + [word] if own or word else words


def words_of(line: Column) -> Column:
    """split_command of a column."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else split_command(t))

    return run(line)

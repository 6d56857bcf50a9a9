"""Volume files: the record codec, a data source for .dat files, index files in plain SQL.

A .dat file is an 8-byte head and records one after another; where the next begins is known only from the one before, or from the
index: an .idx file is a log of 16-byte entries with the places of records, so a volume is cut at some of these places and each piece
is read record by record.  Files are opened by path (a folder that driver and workers see, such as a mount); read_dat and
read_index go by Spark's own readers instead, which reach any store but take files of up to 2 GB."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = 8
RECORD_HEAD = struct.Struct(">IQI")  # cookie, id, bytes of body and footer
ENTRY = struct.Struct(">QII")  # id, place in units of eight bytes, size
#: Bits of the flags byte.
NAME, MIME, MODIFIED, TTL, PAIRS, COMPRESSED = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
SCHEMA = "path string, pos long, version int, cookie long, id decimal(20,0), data binary, flags int, name binary, mime binary, pairs binary, last_modified long, ttl string, checksum long, append_at_ns long, deleted boolean, size long, error string"
#: Bytes of a volume that a task reads.
SPLIT = 128 << 20


@dataclass
class Needle:
    cookie: int
    id: int
    data: bytes = b""
    name: bytes | None = None
    mime: bytes | None = None
    pairs: bytes | None = None
    last_modified: int | None = None
    ttl: str | None = None
    append_at_ns: int = 0
    compressed: bool = False

    @property
    def flags(self) -> int:
        own = ((NAME, self.name), (MIME, self.mime), (MODIFIED, self.last_modified), (TTL, self.ttl), (PAIRS, self.pairs))
        return sum(bit for bit, v in own if v is not None) | COMPRESSED * self.compressed


def checksum(cookie: int, needle: int, body: bytes) -> int:
    return zlib.crc32(struct.pack(">IQ", cookie, needle) + body)


def encode(n: Needle, version: int = 3) -> bytes:
    for value, most in ((n.name, 255), (n.mime, 255), (n.pairs, 65535)):
        if value is not None and len(value) > most:
            raise ValueError("a field is too long")
    body = struct.pack(">I", len(n.data)) + n.data + bytes([n.flags])
    for value, head in ((n.name, ">B"), (n.mime, ">B"), (n.pairs, ">H")):
        if value is not None:
            body += struct.pack(head, len(value)) + value
    if n.last_modified is not None:
        body += n.last_modified.to_bytes(5, "big")
    if n.ttl is not None:
        body += bytes([int(n.ttl[:-1] or 0) if n.ttl else 0, ord(n.ttl[-1]) if n.ttl else 0])
    foot = struct.pack(">I", checksum(n.cookie, n.id, body)) + (struct.pack(">Q", n.append_at_ns) if version >= 3 else b"")
    out = RECORD_HEAD.pack(n.cookie, n.id, len(body) + len(foot)) + body + foot
    return out + b"\0" * (-len(out) % 8)


class Reader:
    """Fields of a record, in their order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the record is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")


def decode(record: bytes, version: int = 3) -> tuple[Needle, int]:
    """A record and the bytes it takes; a wrong checksum is an error.  A head without a body is an empty needle."""
    head = Reader(record)
    cookie, needle, size = RECORD_HEAD.unpack(head.take(RECORD_HEAD.size))
    if not size:
        return Needle(cookie, needle), RECORD_HEAD.size
    r = Reader(head.take(size))
    n = Needle(cookie, needle, r.take(r.number(4)))
    flags = r.number(1)
    n.compressed = bool(flags & COMPRESSED)
    if flags & NAME:
        n.name = r.take(r.number(1))
    if flags & MIME:
        n.mime = r.take(r.number(1))
    if flags & PAIRS:
        n.pairs = r.take(r.number(2))
    if flags & MODIFIED:
        n.last_modified = r.number(5)
    if flags & TTL:
        count, unit = r.take(2)
        n.ttl = f"{count}{chr(unit)}" if count else ""
    body = r.data[: r.at]
    if r.number(4) != checksum(cookie, needle, body):
        raise ValueError("the checksum is wrong")
    if version >= 3:
        n.append_at_ns = r.number(8)
    whole = RECORD_HEAD.size + size
    return n, whole + -whole % 8


def encode_head(version: int, placement: int = 0, ttl: str = "", revision: int = 0) -> bytes:
    return struct.pack(">BBBBHH", version, placement, int(ttl[:-1]) if ttl else 0, ord(ttl[-1]) if ttl else 0, revision, 0)


def decode_head(data: bytes) -> dict:
    if len(data) < HEAD:
        raise ValueError("the head is cut short")
    version, placement, count, unit, revision, _ = struct.unpack(">BBBBHH", data[:HEAD])
    return {"version": version, "placement": placement, "ttl": f"{count}{chr(unit)}" if count else "", "revision": revision}


def read_records(f: BinaryIO, start: int = HEAD, end: int | None = None, corrupt: str = "fail") -> Iterator[tuple[int, int, Needle, int, str | None]]:
    """(place, version, needle, bytes, error) of the records of an open .dat file from one place up to another, one at a time.

    A torn record at the end is left out.  A record that can't be decoded is an error, or with corrupt="mark" a needle with its
    cookie and id alone, and what is wrong with it."""
    if corrupt not in ("fail", "mark"):
        raise ValueError("corrupt is fail or mark")
    version, at = decode_head(f.read(HEAD))["version"], start
    f.seek(start)
    while end is None or at < end:
        head = f.read(RECORD_HEAD.size)
        if len(head) < RECORD_HEAD.size:
            return
        cookie, needle, size = RECORD_HEAD.unpack(head)
        body = f.read(size)
        if len(body) < size:
            return
        whole, error = RECORD_HEAD.size + size, None
        whole += -whole % 8
        try:
            n, _ = decode(head + body, version)
        except ValueError as e:
            if corrupt == "fail":
                raise
            n, error = Needle(cookie, needle), str(e)
        yield at, version, n, whole, error
        at += whole
        f.seek(at)


def records(data: bytes) -> Iterator[tuple[int, int, Needle, int]]:
    """(place, version, needle, bytes) of a .dat file's records; a torn record at the end is left out."""
    for at, version, n, whole, _ in read_records(io.BytesIO(data)):
        yield at, version, n, whole


def decoded(files: DataFrame, corrupt: str = "fail") -> DataFrame:
    """files(path, content) of .dat files: their records."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                held, total = [], 0
                for r in read_records(io.BytesIO(content.as_py()), corrupt=corrupt):
                    held.append(_row(path, *r))
                    total += r[3]
                    if total > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, total = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_dat(spark: SparkSession, path: str, corrupt: str = "fail") -> DataFrame:
    """Records of .dat files of up to 2 GB, by Spark's own reader, so that any store it reads will do.  Larger volumes are
    read by format("needles")."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").option("recursiveFileLookup", "true").load(path), corrupt)


def _row(path: str, at: int, version: int, n: Needle, size: int, error: str | None = None) -> dict:
    from decimal import Decimal

    return {
        "path": path, "pos": at, "version": version, "cookie": n.cookie, "id": Decimal(n.id), "data": n.data, "flags": n.flags, "name": n.name, "mime": n.mime, "pairs": n.pairs,
        "last_modified": n.last_modified, "ttl": n.ttl, "checksum": None, "append_at_ns": n.append_at_ns, "deleted": not n.data and error is None, "size": size, "error": error,
    }


class NeedleSource(DataSource):
    """spark.read.format("needles").load(folder): records of the .dat files of a folder that all workers see.

    Options: splitBytes, so many of a volume a task reads (those with an index); corrupt, fail or mark (see read_records)."""

    @classmethod
    def name(cls) -> str:
        return "needles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return NeedleReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)), self.options.get("corrupt", "fail"))


def splits(dat: Path, most: int) -> list[tuple[int, int]]:
    """Stretches of a volume that begin at records, by its index; one without an index."""
    size, index = dat.stat().st_size, dat.with_suffix(".idx")
    cuts = {HEAD}
    if size > most and index.exists():
        n, parts = index.stat().st_size // ENTRY.size, -(-size // most)
        with open(index, "rb") as f:
            for i in range(1, parts):
                f.seek(n * i // parts * ENTRY.size)
                at = ENTRY.unpack(f.read(ENTRY.size))[1] * 8
                if HEAD < at < size:
                    cuts.add(at)
    starts = sorted(cuts)
    return list(zip(starts, [*starts[1:], size], strict=True))


class NeedleReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT, corrupt: str = "fail"):
        self.path, self.split, self.corrupt = path, split, corrupt

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((str(p), *cut)) for p in sorted(Path(self.path).rglob("*.dat")) for cut in splits(p, self.split)]

    def read(self, partition: InputPartition):
        path, start, end = partition.value
        with open(path, "rb") as f:
            for r in read_records(f, start, end, self.corrupt):
                yield tuple(_row(path, *r).values())


def parse_index(files: DataFrame) -> DataFrame:
    """files(path, content) of .idx files: (path, pos, needle_key, offset, size), without Python.  A torn entry at the end is
    left out; offsets are stored in units of eight bytes."""
    n = F.floor(F.octet_length("content") / 16)
    each = files.where(F.octet_length("content") >= 16).select("path", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.hex(F.substring("content", (i * 16 + 1).cast("int"), F.lit(16))))).alias("pos", "h"))
    number = lambda a, k, kind: F.conv(F.substring("h", a, k), 16, 10).cast(kind)
    return each.select("path", F.col("pos").cast("long").alias("pos"), number(1, 16, "decimal(20,0)").alias("needle_key"), (number(17, 8, "long") * 8).alias("offset"), number(25, 8, "long").alias("size"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index(spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").option("recursiveFileLookup", "true").load(path))


def index_entry(key: int, offset: int, size: int) -> bytes:
    return ENTRY.pack(key, offset // 8, size)


def volume_ids(files: DataFrame) -> DataFrame:
    """files(path): those named <number>.dat, with the number."""
    name = F.substring_index("path", "/", -1)
    n = F.when(name.rlike(r"^[0-9]{1,10}\.dat$"), F.regexp_extract(name, r"^([0-9]+)", 1).cast("long"))
    return files.withColumn("vid", n).where(F.col("vid") < 2**32)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))


def used_space(files: DataFrame, place: Column) -> DataFrame:
    """files(path, size): (place, used), the bytes of .dat and .idx files of each place (an expression of the path)."""
    own = files.where(F.col("path").rlike(r"\.(dat|idx)$"))
    return own.groupBy(place.alias("place")).agg(F.sum("size").alias("used"))


def write_volume(needles: DataFrame, path: str, version: int = 3) -> None:
    """needles(vid, seq, cookie, id, data) as <vid>.dat and <vid>.idx below a folder that all workers see; a volume's
    records in order of seq, written one by one.  A volume's file is put in place whole, so a task that runs again does no harm."""
    import os
    import uuid

    def run(rows: Iterator) -> None:
        now, files, at = None, {}, 0

        def close() -> None:
            for kind, (f, tmp) in files.items():
                f.close()
                os.replace(tmp, os.path.join(path, f"{now}.{kind}"))

        for r in rows:
            if r.vid != now:
                close()
                now, at = r.vid, HEAD
                names = {kind: os.path.join(path, f".{now}.{kind}.{uuid.uuid4().hex}") for kind in ("dat", "idx")}
                files = {kind: (open(tmp, "wb"), tmp) for kind, tmp in names.items()}
                files["dat"][0].write(encode_head(version))
            record = encode(Needle(r.cookie, int(r.id), bytes(r.data or b"")), version)
            files["idx"][0].write(index_entry(int(r.id), at, len(record) if r.data else 0))
            files["dat"][0].write(record)
            at += len(record)
        close()

    os.makedirs(path, exist_ok=True)
    needles.repartition(F.xxhash64("vid")).sortWithinPartitions("vid", "seq").foreachPartition(run)


def open_store(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """Entries from a store: parquet, json or csv by path, or a database by JDBC (its driver must be there)."""
    if kind in ("parquet", "json", "csv", "orc"):
        return spark.read.format(kind).load(options["path"])
    if kind in ("postgres", "mysql"):
        return spark.read.format("jdbc").options(**options).load()
    raise ValueError(f"unknown store {kind}")

"""Reed-Solomon shards: any k of an object's k + m shards give it back.

Arithmetic in GF(2^8) by tables made from the polynomial.  The code is the usual systematic one: powers of the row's number
(a Vandermonde matrix) times the inverse of their upper square, so that data shards are the data.  A product over the
field goes column by column, so objects of a batch that lack the same shards are multiplied at once, side by side; the
matrix that gives back what they lack is made once for each set of shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, PARITY = 10, 3
POLYNOMIAL = 0x11D


@lru_cache
def _product() -> np.ndarray:
    """The product of any two bytes."""
    power, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 256:
            x ^= POLYNOMIAL
    out = power[log[:, None] + log[None, :]].astype(np.uint8)
    out[0, :] = out[:, 0] = 0
    return out


def inverse_of(a: int) -> int:
    return int(np.flatnonzero(_product()[a] == 1)[0])


def times(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Matrix product over the field."""
    table, out = _product(), np.zeros((len(m), rows.shape[1]), np.uint8)
    for i in range(len(m)):
        for j in range(m.shape[1]):
            out[i] ^= table[m[i, j]][rows[j]]
    return out


def invert(m: np.ndarray) -> np.ndarray:
    n, table = len(m), _product()
    both = np.concatenate([m, np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        p = c + int(np.flatnonzero(both[c:, c])[0])
        both[[c, p]] = both[[p, c]]
        both[c] = table[inverse_of(int(both[c, c]))][both[c]]
        for r in range(n):
            if r != c and both[r, c]:
                both[r] ^= table[both[r, c]][both[c]]
    return both[:, n:]


@lru_cache
def code_matrix(k: int, m: int) -> np.ndarray:
    if k < 1 or m < 0 or k + m > 255:
        raise ValueError("one data shard at least, no fewer than zero parity shards, 255 in all")
    table = _product()
    powers = np.ones((k + m, k), np.uint8)
    for c in range(1, k):
        powers[:, c] = table[powers[:, c - 1], np.arange(k + m)]
    return times(powers, invert(powers[:k]))


@lru_cache(maxsize=4096)
def repair_matrix(own: tuple[int, ...], k: int, m: int) -> np.ndarray:
    """What turns those k shards into the data shards."""
    return invert(code_matrix(k, m)[list(own)])


def shards_of(data: bytes, k: int, m: int) -> list[bytes]:
    size = max(1, -(-len(data) // k))
    rows = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    return [r.tobytes() for r in times(code_matrix(k, m), rows)]


def reconstruct(shards: dict[int, bytes], k: int, m: int) -> list[bytes]:
    """All shards from any k of them."""
    if len({len(s) for s in shards.values()}) > 1:
        raise ValueError("shards differ in size")
    if len(shards) < k:
        raise ValueError(f"{k} shards are needed, {len(shards)} are there")
    own = tuple(sorted(shards)[:k])
    rows = np.stack([np.frombuffer(shards[i], np.uint8) for i in own])
    return [r.tobytes() for r in times(code_matrix(k, m), times(repair_matrix(own, k, m), rows))]


def verify(shards: dict[int, bytes], k: int, m: int) -> bool:
    """Whether all shards are there and agree."""
    return len(shards) == k + m and reconstruct({i: shards[i] for i in range(k)}, k, m) == [shards[i] for i in range(k + m)]


#: Bytes of objects or shards that a worker works on at once, and of an Arrow batch that Spark sends it.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def _bounded(rows: DataFrame) -> DataFrame:
    """rows; the session's bound on an Arrow batch is lowered to BATCH_BYTES, as 10,000 whole objects would fill the workers."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession.conf
    n, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(name).strip().lower()).groups()
    if not 0 < int(n) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return rows


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about CHUNK_BYTES of data (one row at least)."""
    for b in batches:
        for first, end in _sized(pc.fill_null(pc.binary_length(b.column("data")), 0).to_pylist()):
            yield b.slice(first, end - first)


def _sized(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes."""
    a = total = 0
    for b, n in enumerate(sizes):
        if total and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def encode(objects: DataFrame, id_col: str, k: int = DATA, m: int = PARITY) -> DataFrame:
    """objects(id, data): (id, shard_idx, data, size) of each shard; size is the object's."""
    code_matrix(k, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            data = [x or b"" for x in b.column("data").to_pylist()]
            width = [max(1, -(-len(x) // k)) for x in data]
            rows = np.concatenate([np.frombuffer(x.ljust(w * k, b"\0"), np.uint8).reshape(k, w) for x, w in zip(data, width, strict=True)], axis=1)
            made, to = times(code_matrix(k, m), rows), np.cumsum(width).tolist()
            shards = [row[e - w : e].tobytes() for e, w in zip(to, width, strict=True) for row in made]
            n = len(data)
            of = np.repeat(np.arange(n), k + m)
            size = np.array(list(map(len, data)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of)), pa.array(np.tile(np.arange(k + m, dtype=np.int32), n)), pa.array(shards, pa.binary()), pa.array(np.repeat(size, k + m))], ["id", "shard_idx", "data", "size"])

    kind = objects.schema[id_col].dataType.simpleString()
    own = _bounded(objects).select(F.col(id_col).alias("id"), F.col("data").cast("binary").alias("data"))
    return own.mapInArrow(run, f"id {kind}, shard_idx int, data binary, size long").withColumnRenamed("id", id_col)


def _data_of(objects: list[tuple[object, int, dict[int, bytes]]], k: int, m: int) -> list[bytes]:
    """The data of (id, size, shards) of each object, those that have the same shards at once."""
    out, alike = [b""] * len(objects), {}
    for i, (_, _, shards) in enumerate(objects):
        if len(shards) < k:
            raise ValueError(f"{k} shards are needed, {len(shards)} are there")
        if len({len(x) for x in shards.values()}) > 1:
            raise ValueError("shards differ in size")
        alike.setdefault(tuple(sorted(shards)[:k]), []).append(i)
    for own, group in alike.items():
        rows = np.stack([np.frombuffer(b"".join(objects[i][2][x] for i in group), np.uint8) for x in own])
        made = rows if own == tuple(range(k)) else times(repair_matrix(own, k, m), rows)
        at = 0
        for i in group:
            width = len(objects[i][2][own[0]])
            out[i] = made[:, at : at + width].tobytes()[: objects[i][1]]
            at += width
    return out


def decode(shards: DataFrame, id_col: str, k: int = DATA, m: int = PARITY, most: int = 4 << 20) -> DataFrame:
    """shards(id, shard_idx, data, size), k at least of each object: (id, data).  Shards are dealt by id and sorted; a worker
    holds whole objects of about `most` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, first = [], 0, True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], arrow), pa.array(_data_of(held, k, m), pa.binary())], ["id", "data"])

        arrow = None
        for b in _pieces(batches):
            arrow = b.schema.field("id").type
            for i, place, data, size in zip(*(b.column(c).to_pylist() for c in ("id", "shard_idx", "data", "size")), strict=True):
                if first or held[-1][0] != i:
                    if total > most:
                        yield done()
                        held, total = [], 0
                    held.append((i, size, {}))
                    first = False
                held[-1][2][place] = data
                total += len(data)
        if held:
            yield done()

    kind = shards.schema[id_col].dataType.simpleString()
    own = _bounded(shards).select(F.col(id_col).alias("id"), "shard_idx", "data", "size")
    return own.repartition(F.xxhash64("id")).sortWithinPartitions("id").mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def write_shards(shards: DataFrame, path: str) -> None:
    """JSON lines, a folder for each shard, data in base64; beside them a manifest (see manifest)."""
    shards.withColumn("data", F.base64("data")).write.partitionBy("shard_idx").json(f"{path}/shards")
    manifest(shards).write.json(f"{path}/manifest")


def manifest(shards: DataFrame) -> DataFrame:
    """(shard_idx, objects, bytes) of each shard."""
    return shards.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("objects"), F.sum(F.length("data")).alias("bytes"))


def read_shards(spark, path: str, id_type: str = "long", id_col: str = "id") -> DataFrame:
    return spark.read.schema(f"{id_col} {id_type}, data string, size long, shard_idx int").json(f"{path}/shards").withColumn("data", F.unbase64("data"))

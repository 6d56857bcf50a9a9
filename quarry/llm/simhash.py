"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: XXH64 of each word shingle, one majority vote for each of 64 bits.  Links: bit position i
gets a non-zero vector m(i) of radius+1 bits; table v (each non-zero v) keeps the positions where
<m(i), v> = 1.  Any `radius` vectors leave some v orthogonal to them all, so two fingerprints that differ in
at most `radius` bits agree on a whole table: no link can be missed, and there is no chance in it.

Scale: equal fingerprints become one row first (map-side combine), so copies cost nothing further.  A
table's bucket is read as a sorted stream.  Up to PAIRWISE rows it is compared at once and gives a spanning
forest (fewer edges than rows), not its pairs.  Beyond that, each fingerprint goes out under itself and its
flips of up to radius/2 bits; those who share one are linked, and those who are linked share one, so that way
is exact too, and its groups hold 65 members at most for radius 2.

Nulls: a null text has no words; fingerprint zero, linked like any other.  Rows with a null id take part and
get the component's smallest id that is not null (null if none).  Repeated rows stay.  Empty table: empty.
A long text is hashed in one worker, with some 100 bytes of memory for each of its words.  Ids are whole numbers (strings
of digits too).  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .frames import as_bytes, checkpointed, chunks, col, fresh, id_and_text
from .textbytes import LOWER, Words, xxh64_ranges

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Rows of a bucket that are compared pair by pair; the exact way for larger ones is above.
PAIRWISE = 16384
#: Rows of a table's buckets that a partition gets, about.
PER_PARTITION = 4_000_000
#: Byte value to its eight bits, each in a byte of its own.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run of hashes (sizes of one or more), the bits that over half of them have."""
    out = np.zeros(len(size), np.uint64)
    if not len(size):
        return out
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    seg = np.flatnonzero(place % 255 == 0)  # a byte counts up to 255
    of = np.flatnonzero(place[seg] == 0)
    for byte in range(8):
        lane = np.add.reduceat(_SPREAD[(h >> np.uint64(8 * byte)) & np.uint64(255)], seg)
        count = np.add.reduceat(lane.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        bits = (2 * count > size[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def simhash(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    w = Words([t.translate(LOWER) for t in texts])
    n = np.diff(w.first)
    m = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    own = np.flatnonzero(m)
    out = np.zeros(len(texts), np.uint64)
    if not len(own):
        return out
    k = m[own]
    place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    a = np.repeat(w.first[own], k) + place
    b = np.minimum(a + shingle, np.repeat(w.first[own + 1], k)) - 1
    out[own] = majority(xxh64_ranges(w.buf, w.start[a], w.end[b], seed), k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, fp) of each row; fp holds the 64 bits as a long, digest tells texts with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches):
            fp = simhash(as_bytes(x.column("text")), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("digest"), pa.array(fp)], ["doc_id", "digest", "fp"])

    own = id_and_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, digest long, fp long")


def masks(radius: int) -> list[int]:
    """The bits that each table keeps, as signed longs.  Up to radius 4 the vectors take turns, so each is used alike;
    for 6 they are a one and the position's six bits (a Reed-Muller code), so each table keeps 32 bits."""
    if radius not in (0, 2, 4, 6):
        raise ValueError("radius must be 0, 2, 4 or 6")
    top = 1 << (radius + 1)
    vector = [(64 | i) if radius == 6 else i % (top - 1) + 1 for i in range(64)]
    kept = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, top)]
    if radius:
        kept = [m for m in kept if m != 2**64 - 1]  # that table has only equal fingerprints meet
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among distinct fingerprints, breadth first: each from the least fingerprint of its tree, so
    that other buckets give many of the same edges."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left) > 1:
        queue, tree, left = [left[0]], [left[:1]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
            got = left[near]
            if len(got):
                left = left[~near]
                tree.append(got)
                queue.extend(got.tolist())
        if len(tree) > 1:
            own = np.sort(fp[np.concatenate(tree)])
            a.append(np.full(len(own) - 1, own[0]))
            b.append(own[1:])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bucket_edges(radius: int, pairwise: int):
    """Reads rows (t, fp) sorted by t and the bits that table keeps; yields kind 0: edges, kind 1: a fingerprint under one of
    its flips."""
    kept = [np.uint64(m & (2**64 - 1)) for m in masks(radius)]
    masked = np.array(kept)

    def rows(kind: int, which: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(a), kind, np.int32), which.astype(np.int32), a.view(np.int64), b.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "which", "a", "b"])

    def flips(t: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        which, mask = divmod(t, len(kept))
        spare = [1 << i for i in range(64) if not int(kept[mask]) >> i & 1]
        for x in (fp[i : i + 20_000] for i in range(0, len(fp), 20_000)):
            for n in range(radius // 2 + 1):
                for some in combinations(spare, n):
                    yield rows(1, np.full(len(x), which), x ^ np.uint64(sum(some)), x)

    def groups(t: np.ndarray, x: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        size = np.diff(np.append(start, len(x)))
        two = start[size == 2]
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
        found = [(t[two], x[two], x[two + 1])]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n <= pairwise:
                a, b = _forest(x[s : s + n], radius)
                found.append((np.full(len(a), t[s]), a, b))
            else:
                yield from flips(int(t[s]), x[s : s + n])
        table, a, b = (np.concatenate(part) for part in zip(*found, strict=True))
        yield rows(0, table // len(kept), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, x, over = np.zeros(0, np.int32), np.zeros(0, np.uint64), None
        for batch in batches:
            t = np.concatenate([t, batch.column("t").to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            while len(x):
                key = x & masked[t % len(kept)]
                start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
                if over is not None and over == (t[0], key[0]):  # more of a bucket that is too large to hold
                    n = start[1] if len(start) > 1 else len(x)
                    yield from flips(int(t[0]), x[:n])
                    t, x = t[n:], x[n:]
                    continue
                last = start[-1]
                if last:
                    yield from groups(t[:last], x[:last], start[:-1])
                    t, x = t[last:], x[last:]
                if len(x) > pairwise:
                    over = (t[0], key[-1])
                    yield from flips(int(t[0]), x)
                    t, x = t[:0], x[:0]
                break
        if len(x):
            yield from groups(t, x, np.zeros(1, np.int64))

    return run


def links(fps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (which, a, b) between distinct (which, fp) that hold together what is linked; fingerprints of another `which` never
    meet (none: all are alike).  Partitions grow with the rows that the tables make."""
    fps = fps if "which" in fps.columns else fps.withColumn("which", F.lit(0))
    kept, conf = masks(radius), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(conf, fps.count() * len(kept) // PER_PARTITION)
    tables = F.explode(F.array(*[F.lit(v) for v in range(len(kept))])).alias("v")
    # spread first: few fingerprints make many table rows
    dealt = fps.repartition(conf, "which", "fp").select("which", "fp", tables).select((F.col("which") * len(kept) + F.col("v")).cast("int").alias("t"), "fp")
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in kept]), F.pmod("t", F.lit(len(kept))) + 1))
    out = dealt.repartition(parts, "t", key).sortWithinPartitions("t", key).mapInArrow(_bucket_edges(radius, pairwise), "kind int, which int, a long, b long")
    out = checkpointed(out)
    over = out.filter("kind = 1").select("which", F.col("a").alias("flip"), F.col("b").alias("fp"))
    rest = over.join(over.groupBy("which", "flip").agg(F.min("fp").alias("m")), ["which", "flip"]).filter("fp <> m").select("which", F.col("fp").alias("a"), F.col("m").alias("b"))
    return out.filter("kind = 0").select("which", "a", "b").unionByName(rest)


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, pairwise: int) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) of each row."""
    own = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    fps = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(fps.select(F.lit(0).alias("which"), "fp"), radius, pairwise))
    placed = checkpointed(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # computed first, so that the join below has a shuffle of its own on either side and AQE can split a large component
    component = checkpointed(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    to = placed.join(component, "root").select("fp", "root", "component_id")
    return own.join(to, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, fp, component_id) of each row; see the module's notes."""
    return _classed(docs, id_col, text_col, shingle, radius, pairwise).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, of each component only one: that with the smallest id, as keep_least chooses it."""
    return keep_least(docs, _classed(docs, id_col, text_col, shingle, radius, PAIRWISE), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of found(doc_id, digest, root, component_id), whose name is root: the one with the smallest id.

    Rows with one id and different texts are told apart by a digest of the text: the row that stays is of the component's own
    texts.  Of rows with the same id and text one stays, whatever their other columns.  Rows with a null id have no name to be
    chosen by; they stay."""
    keep, which, row = fresh(docs, "keep"), fresh(docs, "digest"), fresh(docs, "row")
    best = found.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("best")).select(F.col("best.doc_id").alias(keep), F.col("best.digest").alias(which))
    named = docs.filter(col(docs, id_col).isNotNull())
    digest = F.xxhash64(col(named, text_col).cast("string"))
    stay = named.withColumn(row, digest).join(best, (col(named, id_col).cast("long") == F.col(keep)) & (F.col(row) == F.col(which)), "left_semi")
    once = Window.partitionBy(col(stay, id_col).cast("long"), row).orderBy(row)
    return stay.withColumn(row, F.row_number().over(once)).filter(F.col(row) == 1).drop(row).unionByName(docs.filter(col(docs, id_col).isNull()))

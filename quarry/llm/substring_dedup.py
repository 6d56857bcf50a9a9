"""Exact substring dedup over word windows, by super-k-mer partitioning.

A window is W consecutive words of one document.  Each word covered by a window whose words also stand
together in a document with a smaller id is removed; windows are judged on the input.

1. Each window has a minimiser: the least hash of its M-word pieces.  Consecutive windows that share it are a
   super-k-mer, and travel as one packed string (about 3 bytes for a byte of text, before compression, where
   windows on their own would take W) to the minimiser's bucket.  Equal super-k-mers of one chunk of text
   are settled there: only those of the smallest id travel.  So a group of copies, however large, sends a
   bucket at most one string from each chunk.
2. A bucket sorts its windows by hash, compares those with equal hashes byte for byte, and reports the
   stretches of words to remove.
3. The stretches meet the texts, which travel as compressed blocks, by a hash of the document.

Skew: a first pass over all text counts minimisers; those with a large share of all windows, or with MANY windows (LISTED
of them at most, the most frequent, so the list is small), send each of their windows on its own, dealt by the window's hash.  It sets the layout
only, never the result.  Buckets are read as sorted streams, one at a time.  Of windows that stand in a bucket again
and again only the smallest id's is held on to; what is then still too large for memory is held compressed and sorted in
several passes, each over the windows with one remainder of their hash.  Partitions grow with the bytes of the text.

Nulls: a null text has no words.  A null id is larger than any other and equal to another null.  Rows
with the same id and text get the same result each; rows with the same id and other texts are told apart.
Texts of under W words keep all.  Empty table: empty.  A long text is read whole in one worker, with some 100 bytes of memory for
each of its words.  Ids are whole numbers.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_bytes, chunks, id_and_text
from .textbytes import Words, hash_ranges, lanes, mix, same_ranges  # noqa: F401

WINDOW = 13
PIECE = 3
#: A minimiser with more than 1/HOT of all windows, or with more than MANY, is dealt by window; LISTED of them at most.
HOT, MANY, LISTED = 4000, 1_000_000, 200_000
#: Bytes of text in a chunk of the map side, in a bucket on average, and in a bucket that is sorted in one pass.
CHUNK, BUCKET, MOST = 6 << 20, 12 << 20, 48 << 20
#: So many buckets at least.
LEAST = 256
#: Bytes of blocks (about four for a byte of text, before compression) in a partition.
PARTITION = 256 << 20
NO_ID = 2**63 - 1
_R = np.uint64(0xC6A4A7935BD1E995)
_R_INV = np.uint64(pow(0xC6A4A7935BD1E995, -1, 2**64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed block."""
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(a) for a in arrays], np.int64).tobytes() + body)


def unpack(block: bytes, *types) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(data, np.int64, len(types)).tolist(), types, strict=True):
        out.append(np.frombuffer(data, t, n, at))
        at += out[-1].nbytes
    return out


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words from their hashes."""
    power = np.cumprod(np.full(len(h) + 1, _R, np.uint64))
    back = np.cumprod(np.full(len(h) + 1, _R_INV, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * back[: len(total) - n])


def _minimisers(w: Words, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that start a window, the minimiser of each, and all words' hashes."""
    h = hash_ranges(w.buf, w.start, w.end)
    first = np.diff(w.first) - window + 1
    own = np.flatnonzero(first > 0)
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), h
    k = first[own]
    at = np.repeat(w.first[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    least, width = _rolling(h, piece), 1
    span = window - piece + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return at, least[at], h


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _row_keys(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def _dealt(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ mix(keys.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        yield int(sorted_[a]), order[a:b]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is binary, in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_BLOCKS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("block", pa.binary())])
_PLACED = pa.schema([("place", pa.int64()), ("kind", pa.int32()), ("block", pa.binary())])


def _survey(window: int, piece: int) -> Callable:
    """Bytes of text (key null), and minimisers with many of a chunk's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches, most=CHUNK):
            texts = as_bytes(x.column("text"))
            _, least, _ = _minimisers(Words(texts), window, piece)
            value, count = np.unique(least, return_counts=True)
            many = count > max(2, len(least) // (5 * HOT))
            keys = [None, *value[many].view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sum(map(len, texts)), *count[many].tolist()], pa.int64()), pa.array([len(least)] + [0] * (len(keys) - 1), pa.int64())], ["key", "n", "windows"])

    return run


def survey(text: DataFrame, window: int = WINDOW, piece: int = PIECE) -> tuple[int, np.ndarray]:
    """Bytes of all text, and the hot minimisers."""
    counts = text.mapInArrow(_survey(window, piece), "key long, n long, windows long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    most = counts.orderBy(F.col("key").isNotNull(), F.col("n").desc()).limit(LISTED).collect()
    if not most:
        return 0, np.zeros(0, np.uint64)
    total, *found = most  # the row without a key comes first
    hot = [r.key for r in found if r.n > max(100, min(total.windows // HOT, MANY))]
    return total.n, np.sort(np.array(hot, np.int64).view(np.uint64))


def _super_kmers(window: int, piece: int, buckets: int, places: int, hot: np.ndarray) -> Callable:
    """Kind 0: super-k-mers for a bucket.  Kind 1: stretches that this chunk alone shows to be repeated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for x in chunks(batches, most=CHUNK):
            texts, ids = as_bytes(x.column("text")), _ids(x.column("doc_id"))
            w, keys = Words(texts), _row_keys(texts)
            at, least, h = _minimisers(w, window, piece)
            if not len(at):
                continue
            bucket = mix(least)
            new = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
            if len(hot):
                alone = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
                new |= alone[1:] | alone[:-1]
                bucket = np.where(alone, mix(_rolling(h, window)[at]), bucket)
            head = np.flatnonzero(np.concatenate([[True], new]))
            n = np.diff(np.append(head, len(at)))  # windows of each super-k-mer
            a, bucket = at[head], (bucket[head] % np.uint64(buckets)).astype(np.int64)
            b = a + n + window - 2  # its last word
            doc = np.searchsorted(w.first, a, side="right") - 1
            # those with the same words: only the smallest id's need to travel
            start, end, own = w.start[a], w.end[b], ids[doc]
            whole = hash_ranges(w.buf, start, end)
            order = np.lexsort((own, whole))
            first = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
            lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
            later = own[order] > own[lead]
            i, j = order[later], lead[later]
            same = same_ranges(w.buf, start[i], end[i], start[j], end[j])
            settled = np.zeros(len(a), bool)
            settled[i[same]] = True
            pos = a - w.first[doc]
            k = np.flatnonzero(settled)
            yield from ((p % buckets, 1, p, block) for p, block in _stretches(own[k], keys[doc[k]], pos[k], pos[k] + n[k] + window - 1, places))
            go = np.flatnonzero(~settled)
            for p, i in _by_bucket(bucket[go]):
                i = go[i]
                docs, of = np.unique(doc[i], return_inverse=True)
                text = b"".join([w.raw[s : e + 1].tobytes() for s, e in zip(start[i].tolist(), end[i].tolist(), strict=True)])
                yield p, 0, 0, pack(ids[docs], keys[docs], of.astype(np.int32), pos[i].astype(np.int32), n[i].astype(np.int32), np.frombuffer(text, np.uint8))

    return lambda batches: _batches(rows(batches), _BLOCKS)


def _stretches(ids, keys, start, end, places: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of stretches of words, merged where they meet, for the place of their document."""
    if not len(ids):
        return
    order = np.lexsort((start, keys, ids))
    ids, keys, start, end = ids[order], keys[order], start[order], end[order]
    other = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    # ends counted from a base that grows with each document, so one running maximum serves all
    base = np.cumsum(other) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    head = np.flatnonzero(other | np.concatenate([[True], start[1:] + base[1:] > reach[:-1]]))
    last = np.append(head[1:], len(ids)) - 1
    ids, keys, start, end = ids[head], keys[head], start[head], reach[last] - base[last]
    for p, i in _by_bucket(_dealt(ids, keys, places)):
        yield p, pack(ids[i], keys[i], start[i].astype(np.int32), end[i].astype(np.int32))


def _windows(block: bytes, window: int) -> tuple:
    """Of a block: its buffer, and of each window its first and last word's offsets, hash, id, row key and place."""
    ids, keys, of, pos, n, text = unpack(block, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)
    end = np.flatnonzero(text == 0x20)
    start = np.concatenate([[0], end[:-1] + 1])
    buf = np.concatenate([text, np.zeros(8, np.uint8)])
    step = n + window - 1
    lead = np.cumsum(step) - step
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(lead, n) + k
    whole = _rolling(hash_ranges(buf, start, end), window)[at]
    own = np.repeat(of, n)
    return buf, start[at], end[at + window - 1], whole, ids[own], keys[own], np.repeat(pos, n) + k


def _joined(parts: list[tuple]) -> tuple:
    """The windows of several buffers as those of one."""
    size = np.array([len(p[0]) for p in parts])
    shift = np.cumsum(size) - size
    return (np.concatenate([p[0] for p in parts]), *(np.concatenate([p[c] + s for p, s in zip(parts, shift, strict=True)]) for c in (1, 2)), *(np.concatenate([p[c] for p in parts]) for c in (3, 4, 5, 6)))


def _picked(part: tuple, which: np.ndarray) -> tuple:
    """Only some windows, with a buffer of their own."""
    buf, s, e, *rest = part
    s, e = s[which], e[which]
    size = e - s
    text = b"".join([buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)])
    to = np.cumsum(size)
    return (np.frombuffer(text + b"\0" * 8, np.uint8), to - size, to, *(x[which] for x in rest))


def _repeated(buf, start, end, whole, ids, keys, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, row key and place of each window that a smaller id has as well."""
    i = _later(buf, start, end, whole, ids)
    return ids[i], keys[i], pos[i]


def _later(buf, start, end, whole, ids) -> np.ndarray:
    """The windows that a smaller id has as well."""
    order = np.argsort(whole, kind="stable")
    sorted_ = whole[order]
    eq = sorted_[1:] == sorted_[:-1]
    order = order[np.concatenate([[False], eq]) | np.concatenate([eq, [False]])] if len(order) else order
    order = order[np.lexsort((ids[order], whole[order]))]
    if not len(order):
        return order
    first = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = ids[order] > ids[lead]
    i, j = order[later], lead[later]
    same = same_ranges(buf, start[i], end[i], start[j], end[j])
    if not same.all():  # other words with the same hash: settle these hashes by their words
        odd = np.isin(whole[order], np.unique(whole[i[~same]]))
        least: dict[bytes, int] = {}
        group = order[odd].tolist()
        words = [buf[start[k] : end[k]].tobytes() for k in group]
        for k, t in zip(group, words, strict=True):
            least[t] = min(least.get(t, NO_ID), int(ids[k]))
        more = [k for k, t in zip(group, words, strict=True) if ids[k] > least[t]]
        i = np.concatenate([i[~np.isin(whole[i], whole[order[odd]])], np.array(more, i.dtype)])
    return i


def _count_windows(window: int, places: int, most: int) -> Callable:
    """Reads blocks sorted by bucket; yields stretches for each place."""

    class Bucket:
        """Windows of one bucket.  new: blocks that came last; old: blocks that had little in common; least: what is left of
        windows that stood there again and again."""

        def __init__(self):
            self.new, self.old, self.least, self.size, self.before = [], [], [], 0, 0

        def add(self, block: bytes) -> Iterator[tuple]:
            self.new.append(block)
            self.size += zstandard.frame_content_size(block)
            if self.size > most:
                yield from self.settle()

        def settle(self) -> Iterator[tuple]:
            """Reports what is repeated among the new blocks and the least, and lets go of it, if that is most of them."""
            one = _joined([*(_windows(b, window) for b in self.new), *self.least])
            later = _later(*one[:5])
            if 2 * len(later) > len(one[3]) and sum(len(x[0]) for x in self.least) <= most:
                yield tuple(x[later] for x in one[4:])
                stay = np.ones(len(one[3]), bool)
                stay[later] = False
                self.least = [_picked(one, np.flatnonzero(stay))]
            else:
                self.old += self.new
                self.before += self.size
            self.new, self.size = [], 0

        def rest(self) -> Iterator[tuple]:
            blocks, size = self.old + self.new, self.before + self.size + sum(len(x[0]) for x in self.least)
            parts = -(-size // most)
            if parts <= 1:
                yield _repeated(*_joined([*(_windows(b, window) for b in blocks), *self.least]))
                return
            parts *= 4  # windows on their own take more room than in a super-k-mer
            for k in range(parts):
                one = [_picked(x, np.flatnonzero(x[3] // np.uint64(7) % np.uint64(parts) == k)) for x in chain((_windows(b, window) for b in blocks), self.least)]
                yield _repeated(*_joined(one))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, known, now = None, [], None

        def flush() -> Iterator[tuple]:
            if known:
                ids, keys, pos = (np.concatenate(c) for c in zip(*known, strict=True))
                known.clear()
                yield from ((p, 0, block) for p, block in _stretches(ids, keys, pos.astype(np.int64), pos.astype(np.int64) + window, places))

        for batch in batches:
            for bucket, kind, place, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    yield place, 0, block
                    continue
                if bucket != now or held is None:
                    known.extend(held.rest() if held else ())
                    now, held = bucket, Bucket()
                known.extend(held.add(block))
                if sum(len(k[0]) for k in known) > 1_000_000:
                    yield from flush()
        known.extend(held.rest() if held else ())
        yield from flush()

    return lambda batches: _batches(rows(batches), _PLACED)


def _texts(places: int) -> Callable:
    """Blocks of documents for their places."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for x in chunks(batches, most=4 * CHUNK):
            texts, ids = as_bytes(x.column("text")), _ids(x.column("doc_id"))
            keys, size = _row_keys(texts), np.array([len(t) for t in texts], np.int64)
            named = np.array(x.column("doc_id").is_valid(), bool).astype(np.uint8)
            for p, i in _by_bucket(_dealt(ids, keys, places)):
                yield p, 1, pack(ids[i], named[i], keys[i], size[i], np.frombuffer(b"".join([texts[k] for k in i.tolist()]), np.uint8))

    return lambda batches: _batches(rows(batches), _PLACED)


def _cut(emit_text: bool) -> Callable:
    """Reads blocks sorted by place and kind: stretches, then documents; yields each document's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone, merged = None, [], {}
        for batch in batches:
            for place, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now:
                    now, gone, merged = place, [], None
                if kind == 0:
                    gone.append(unpack(block, np.int64, np.int64, np.int32, np.int32))
                    continue
                if merged is None:
                    merged = {}
                    for ids, keys, start, end in gone:
                        for i, k, s, e in zip(ids.tolist(), keys.tolist(), start.tolist(), end.tolist(), strict=True):
                            merged.setdefault((i, k), []).append((s, e))
                    gone = []
                yield from kept(unpack(block, np.int64, np.uint8, np.int64, np.int64, np.uint8), merged)

    def kept(block, merged) -> Iterator[pa.RecordBatch]:
        ids, named, keys, size, data = block
        to = np.cumsum(size)
        data = data.tobytes()
        w = Words([data[a:b] for a, b in zip((to - size).tolist(), to.tolist(), strict=True)])
        n, removed, text = np.diff(w.first), np.zeros(len(ids), np.int64), []
        for d, (i, k, f) in enumerate(zip(ids.tolist(), keys.tolist(), w.first.tolist(), strict=False)):
            m = int(n[d])
            stretches = merged.get((i, k))
            if not stretches:
                text.append(w.text(f, f + m))
                continue
            stay = np.ones(m, bool)
            for s, e in stretches:
                stay[s:e] = False
            removed[d] = m - int(stay.sum())
            raw = w.raw[w.start[f] : w.end[f + m - 1] + 1]
            text.append(raw[np.repeat(stay, w.end[f : f + m] - w.start[f : f + m] + 1)][:-1].tobytes())
        out = [pa.array(ids, mask=named == 0), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if emit_text:
            out.append(pa.array(text, pa.binary()).cast(pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(out, names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, emit_text: bool = False, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of each row: the words left are joined by one space."""
    if not 1 <= piece <= window:
        raise ValueError("piece must be from 1 to window")
    text = id_and_text(docs, id_col, text_col)
    total, hot = survey(text, window, piece)
    buckets, places = max(LEAST, 3 * total // BUCKET), max(LEAST, total // BUCKET)
    sent = text.mapInArrow(_super_kmers(window, piece, buckets, places, hot), "bucket long, kind int, place long, block binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * total // PARTITION)
    gone = _dealt_by(sent, "bucket", parts).sortWithinPartitions("bucket").mapInArrow(_count_windows(window, places, most), "place long, kind int, block binary")
    whole = text.mapInArrow(_texts(places), "place long, kind int, block binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * emit_text
    return _dealt_by(gone.unionByName(whole), "place", parts).sortWithinPartitions("place", "kind").mapInArrow(_cut(emit_text), schema)


def _dealt_by(blocks: DataFrame, number: str, parts: int) -> DataFrame:
    """Buckets in turn over the partitions: each gets as many, give or take one, where a hash would give some twice that."""
    return blocks.repartitionById(parts, F.pmod(F.col(number), F.lit(parts)).cast("int"))

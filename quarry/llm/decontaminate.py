"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts and items are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII.  A window
is 13 consecutive words of an item; an item of fewer words is one window.  The automaton runs over numbers of words: it holds
every seventh piece of seven words of each item (and short items whole) and reads each text once.  Every window has such
a piece in it, whole; so where a piece is found, up to six words of text and item on either side are compared, and windows
that lie in what agrees are hit.  That is exact, and takes one node for a word of the items, where all windows would take 13.
Hit words are mapped back to places in the original text.

Scale: documents never move; there is no shuffle.  The items are the stated query set; up to BLOCK bytes of them are
broadcast and a worker holds their automaton (some 200 MB for 20 MB of items).  Only a set beyond BLOCK is cut into blocks of that size,
each of which is another scan with an automaton of its own; what the scans find meets by document, without the texts.

Nulls: a null text or item has no words.  Words that only an item without an id holds are hit but no item is named.
Repeated rows stay; an item id that is repeated counts once, with all its texts.  Empty tables: no hits.  A long text is read in
one worker.  Ids are whole numbers.  find_overlap reads only the columns named; decontaminate keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_bytes, chunks, col, fresh, id_and_text, spread, total_bytes

WINDOW = 13
#: A document is contaminated if one word in so many is hit, at least.
SHARE = 20
#: Bytes of items in an automaton.
BLOCK = 32 << 20
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Machine:
    """The automaton of items (id, text), and what it takes to extend a match."""

    def __init__(self, items: tuple[tuple[int | None, bytes], ...], window: int):
        self.window, self.piece = window, (window + 1) // 2
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        flat, self.ids, first = array("I"), [], []
        for item, text in items:
            words = normal_words(text)
            if words:
                first.append(len(flat))
                self.ids.append(item)
                flat.extend(number(w, len(self.vocabulary) + 2) for w in words)
                flat.append(1)  # no word of a text has this number, nor that of unknown words, 0
        flat.extend([1] * window)
        self.words = np.concatenate([np.ones(window, np.uint32), np.frombuffer(flat, np.uint32)])
        self.first = np.array(first, np.int64) + window
        found: dict[tuple, array] = {}
        for k, start in enumerate(first):
            n = (first[k + 1] if k + 1 < len(first) else len(flat) - window) - 1 - start
            size = self.piece if n >= window else n
            for a in range(start, start + n - size + 1, size):
                found.setdefault(tuple(flat[a : a + size]), array("q")).append(a + window)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, at in found.items():
            self.machine.add_word(key, (len(key), np.frombuffer(at, np.int64)))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def runs(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set]:
        """Stretches of a text's words that windows cover, in any order, and the ids of these windows' items."""
        known = tuple(map(self.vocabulary.get, words, repeat(0)))
        text, out, items = None, set(), set()
        for end, (size, at) in self.machine.iter(known):
            p = end + 1 - size
            short = self.words[at + size] == 1
            whole = short & (self.words[at - 1] == 1)  # the piece is an item
            if whole.any():
                out.add((p, p + size))
                items.update(self.owner(at[whole]))
            more = at[~whole] if size == self.piece else at[:0]
            if len(more):
                if text is None:
                    text = np.concatenate([np.zeros(self.window, np.uint32), np.array(known, np.uint32), np.zeros(self.window, np.uint32)])
                reach = np.arange(1, self.window - self.piece + 1)
                left = self._agree(text, self.window + p - reach, self.words[more[:, None] - reach])
                right = self._agree(text, self.window + p + size - 1 + reach, self.words[more[:, None] + size - 1 + reach])
                hit = left + size + right >= self.window
                if hit.any():
                    out.update(zip((p - left[hit]).tolist(), (p + size + right[hit]).tolist(), strict=True))
                    items.update(self.owner(more[hit]))
        return out, items

    @staticmethod
    def _agree(text: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How many words of each row agree with the text's before the first that doesn't."""
        return np.logical_and.accumulate(words == text[at], axis=1).sum(axis=1)

    def owner(self, at: np.ndarray) -> list:
        return [self.ids[k] for k in np.unique(np.searchsorted(self.first, at, "right") - 1).tolist()]


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[int | None, bytes], ...], window: int) -> Machine | None:
    machine = Machine(items, window)
    return None if machine.empty else machine


def scan(text: bytes, machine: Machine | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, stretches of words that matches cover (merged, in order), ids of the items."""
    words = normal_words(text)
    if machine is None or not words:
        return len(words), [], set()
    found, items = machine.runs(words)
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return len(words), [(a, b) for a, b in out], items


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple]:
    """Blocks of items, each of bounded size."""
    items = benchmark.select(col(benchmark, id_col).cast("long").alias("item_id"), col(benchmark, text_col).cast("string").alias("text")).filter("text is not null")
    blocks = max(1, -(-total_bytes(items) // BLOCK))
    dealt = items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return [tuple(sorted(((r.item_id, r.text.encode()) for r in dealt.filter(F.col("block") == b).collect()), key=str)) for b in range(blocks)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) of each row; items: ids in order, spans: places in the
    original text (code points, end exclusive)."""
    text, blocks = id_and_text(docs, id_col, text_col), _items(benchmark, item_col, item_text)
    if len(blocks) > 1:
        return _by_blocks(text, blocks, window, share)
    sent = docs.sparkSession.sparkContext.broadcast(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(sent.value, window)
        for x in chunks(batches):
            rows = [judge(t, machine, share) for t in as_bytes(x.column("text"))]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    names = ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), _SPANS, pa.bool_()]
    schema = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: int, end: int>>, contaminated boolean"
    return text.mapInArrow(run, schema)


def _by_blocks(text: DataFrame, blocks: list[tuple], window: int, share: int, keep_key: bool = False) -> DataFrame:
    """A scan for each block.  Documents are named by id and digest of the text, so equal rows share what was found."""
    keyed = text.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))

    def scanned(block: tuple) -> DataFrame:
        sent = text.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _automaton(sent.value, window)
            for x in chunks(batches):
                found = [(i, *scan(t, machine)[1:], t) for i, t in enumerate(as_bytes(x.column("text")))]
                found = [f for f in found if f[1]]
                at = pa.array([f[0] for f in found], pa.int64())
                hits = [[{"a": a, "b": b, "start": s["start"], "end": s["end"]} for (a, b), s in zip(f[1], places(f[3], f[1]), strict=True)] for f in found]
                kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "start", "end")]))
                yield pa.RecordBatch.from_arrays([x.column("doc_id").take(at), x.column("key").take(at), pa.array(hits, kind), pa.array([sorted(i for i in f[2] if i is not None) for f in found], pa.list_(pa.int64()))], ["doc_id", "key", "hits", "items"])

        return keyed.mapInArrow(run, "doc_id long, key string, hits array<struct<a: int, b: int, start: int, end: int>>, items array<long>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches):
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("key"), pa.array([len(normal_words(t)) for t in as_bytes(x.column("text"))], pa.int64())], ["doc_id", "key", "n_words"])

    every = reduce(DataFrame.unionByName, [scanned(b) for b in blocks]).distinct()
    # a document has as many rows here as there are blocks, at most
    met = every.groupBy("doc_id", "key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<a: int, b: int, start: int, end: int>>")
    last = lambda m: F.element_at(m, -1)
    joined = lambda m, h: F.struct(last(m)["a"].alias("a"), F.greatest(last(m)["b"], h["b"]).alias("b"), last(m)["start"].alias("start"), F.greatest(last(m)["end"], h["end"]).alias("end"))
    merged = F.aggregate("hits", empty, lambda m, h: F.when((F.size(m) > 0) & (h["a"] <= F.try_element_at(m, F.lit(-1))["b"]), F.concat(F.slice(m, 1, F.size(m) - 1), F.array(joined(m, h)))).otherwise(F.concat(m, F.array(h))))
    met = met.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), merged.alias("hits"), "items")
    own = keyed.mapInArrow(count, "doc_id long, key string, n_words long")
    out = own.join(met, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").withColumn("hits", F.coalesce("hits", empty))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["b"] - h["a"])
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    out = out.select("doc_id", *["key"] * keep_key, "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), spans.alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def places(text: bytes, stretches: list[tuple[int, int]]) -> list[dict]:
    """Stretches of words as places in the text, in code points."""
    if not stretches:
        return []
    at = [m.span() for m in _WORD.finditer(text.decode())]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in stretches]


def judge(text: bytes, machine, share: int) -> tuple:
    n, hit, items = scan(text, machine)
    covered = sum(b - a for a, b in hit)
    return n, covered, sorted(i for i in items if i is not None), places(text, hit), covered > 0 and share * covered >= n


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs that aren't contaminated, as they are."""
    blocks, at = _items(benchmark, item_col, item_text), docs.columns.index(text_col)
    if len(blocks) > 1:
        text = id_and_text(docs, id_col, text_col)
        name, key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
        digest = lambda c: F.md5(F.coalesce(c.cast("string"), F.lit("")))
        judged = _by_blocks(text, blocks, window, share, keep_key=True).filter("contaminated").select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct()
        return docs.join(judged, col(docs, id_col).cast("long").eqNullSafe(F.col(name)) & (digest(col(docs, text_col)) == F.col(key)), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(sent.value, window)
        for x in chunks(batches, at):
            yield x.filter(pa.array([not judge(t, machine, share)[-1] for t in as_bytes(x.column(at))], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)

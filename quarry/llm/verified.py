"""Near duplicates that SimHash proposes and whole texts confirm.

Links: two texts are linked if their sets of five-word shingles have a Jaccard similarity of SIMILAR or more and fingerprints
propose them.  Fingerprints here are of a text's distinct words, one vote each: a changed word changes five shingles but one
word, so texts that share 0.8 of their shingles share some 0.95 of their words and differ by 3 to 6 of 64 bits (fingerprints of
shingles would differ by 10).  Each text gets COPIES of them, under as many hash functions, and covering tables
(simhash.links) find every pair that is within RADIUS bits in one of them.  Texts that these pairs join, by chains too,
are a proposal; within it all pairs are compared.  The result's components are those of the confirmed links.

Scale: texts with equal sets become one first, and only proposals of more than one set are read again.  Up to `most` sets a
proposal is compared in one worker by an inverted index of shingles.  A larger one is dealt by salt: all its sets meet
a few pivots first, which join what is alike; those outside the largest class so found (few, where the
texts are versions of one) then meet all sets, block by block.  Sets of one class need no comparison, and no worker holds a proposal.

Nulls: a null text has no words; texts without words are equal.  A text of fewer than five words is one shingle.  Rows with
a null id take part and get the component's smallest id that is not null (null if none).  Repeated rows stay.  Empty table:
empty.  A long text is read whole in one worker (8 bytes for a shingle).  Ids are whole numbers.  Only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import as_bytes, checkpointed, chunks, id_and_text
from .simhash import SEED, keep_least, links, majority
from .textbytes import LOWER, Words, mix, xxh64_ranges

#: The rule for stages on word shingles.
WORDS = 5
SIMILAR = 0.8
#: Bits that a fingerprint may differ by, and fingerprints of a text.
RADIUS = 4
COPIES = 4
#: Sets that a worker compares at once, and their bytes.
MOST = 256
BYTES = 8 << 20
#: Sets to read again whose ids are broadcast; more are joined.
BROADCAST = 100_000
#: Rounds of pivots for large proposals, and pivots of each.
ROUNDS = 1
PIVOTS = 32


def _ranges(first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as (first word, last word), and where each text's begin."""
    n = np.diff(first)
    m = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(m)])
    a = np.repeat(first[:-1], m) + np.arange(at[-1]) - np.repeat(at[:-1], m)
    return a, np.minimum(a + words, np.repeat(first[1:], m)) - 1, at


def _sets(w: Words, words: int) -> list[np.ndarray]:
    a, b, at = _ranges(w.first, words)
    if not at[-1]:
        return [np.zeros(0, np.uint64)] * (len(at) - 1)
    h = xxh64_ranges(w.buf, w.start[a], w.end[b], SEED)
    return [np.unique(h[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's word shingles."""
    return _sets(Words([t.translate(LOWER) for t in texts]), words)


def word_fingerprints(sets: list[np.ndarray], copies: int = COPIES) -> np.ndarray:
    """Fingerprints (texts, copies) of sets of word hashes; zero for none."""
    out = np.zeros((len(sets), copies), np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    own = np.flatnonzero(size)
    if len(own):
        flat = np.concatenate([sets[i] for i in own.tolist()])
        for k in range(copies):
            with np.errstate(over="ignore"):
                out[own, k] = majority(mix(flat + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)), size[own])
    return out


def _sign(own: np.ndarray) -> str:
    return hashlib.md5(own.tobytes()).hexdigest()


def _number(sign: str | Column) -> Column:
    """The first 120 bits of a sign as a number, which Spark compares and adds up without sorting."""
    half = lambda at: F.conv(F.substring(sign, at, 15), 16, 10).cast("decimal(19,0)")
    return (half(1) * F.lit(2**60).cast("decimal(19,0)") + half(16)).cast("decimal(38,0)")


class Index:
    """Sets by shingle: compares one set with all of them in the time of what they share."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.of = np.repeat(np.arange(len(sets)), self.size)[order]
        self.keys, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def similarity(self, one: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a set to each; sets without members are equal."""
        if not len(one):
            return (self.size == 0).astype(float)
        both = np.zeros(len(self.size), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, one), len(self.keys) - 1)
            at = at[self.keys[at] == one]
            n = self.end[at] - self.start[at]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
            both = np.bincount(self.of[place], minlength=len(self.size))
        return both / (len(one) + self.size - both)


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that join what is linked: those found are taken up in turn."""
    if len(sets) == 2 and min(map(len, sets)) < least * max(map(len, sets)):
        return []
    index, left, out = Index(sets), np.ones(len(sets), bool), []
    while left.any():
        queue = [int(np.flatnonzero(left)[0])]
        left[queue[0]] = False
        while queue and left.any():
            i = queue.pop()
            got = np.flatnonzero(left & (index.similarity(sets[i]) >= least)).tolist()
            left[got] = False
            out += [(i, j) for j in got]
            queue += got
    return out


def _names(copies: int) -> list[str]:
    return [f"fp{k}" for k in range(copies)]


def _facts(docs: DataFrame, id_col: str, text_col: str, words: int, copies: int) -> DataFrame:
    """(doc_id, digest, sign, fp0, ...) of each row: a digest of the text, one of its shingles, and fingerprints of its words."""
    names = ["doc_id", "digest", "sign", *_names(copies)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches):
            w = Words([t.translate(LOWER) for t in as_bytes(x.column("text"))])
            sign = pa.array([_sign(s) for s in _sets(w, words)], pa.string())
            fps = word_fingerprints(_sets(w, 1), copies).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("digest"), sign, *(pa.array(np.ascontiguousarray(f)) for f in fps.T)], names)

    own = id_and_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, digest long, sign string, " + ", ".join(f"{f} long" for f in _names(copies)))


def _proposals(distinct: DataFrame, radius: int, copies: int) -> DataFrame:
    """(node, root) of the sets of distinct(node, fp0, ...) that fingerprints join to others."""
    each = distinct.select("node", F.posexplode(F.array(*_names(copies))).alias("which", "fp"))
    first = checkpointed(each.groupBy("which", "fp").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")))
    same = each.join(first.filter("n > 1"), ["which", "fp"]).filter("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    near = links(first.select("which", "fp"), radius)
    for end in ("a", "b"):
        near = near.join(first.select("which", F.col("fp").alias(end), F.col("m").alias(f"{end}_node")), ["which", end])
    return connected_components(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionByName(same))


def _sets_of(texts: DataFrame, words: int) -> DataFrame:
    """texts(root, sign, text): (root, sign, own) of the texts that have that very sign, own the set's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches):
            sets = shingle_sets(as_bytes(x.column("text")), words)
            true = pa.array([_sign(s) == want for s, want in zip(sets, x.column("sign").to_pylist(), strict=True)], pa.bool_())
            own = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([x.column("root"), x.column("sign"), own], ["root", "sign", "own"]).filter(true)

    # a row that is repeated brings its set again
    return texts.mapInArrow(run, "root long, sign string, own binary").dropDuplicates(["root", "sign"])


def _edges(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["a", "b"])


def _within(sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within each proposal, which one worker holds."""

    def found(held: dict[str, bytes]) -> pa.RecordBatch:
        names = list(held)
        return _edges([(names[i], names[j]) for i, j in forest([np.frombuffer(b, np.uint64) for b in held.values()], least)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for root, sign, own in zip(*(batch.column(c).to_pylist() for c in ("root", "sign", "own")), strict=True):
                if root != key:
                    if len(held) > 1:
                        yield found(held)
                    key, held = root, {}
                held[sign] = own
        if len(held) > 1:
            yield found(held)

    # dealt by a hash of its own: a repartition by a join's key is optimised away, and AQE may then split that join's groups
    return sets.select("root", "sign", "own").repartition(F.xxhash64("root")).sortWithinPartitions("root").mapInArrow(run, "a string, b string")


def _dealt(name: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(name), blocks).cast("int")


def _meet(asked: DataFrame, sets: DataFrame, least: float, most: int) -> DataFrame:
    """Links (a, b) of the sets asked(root, sign, own) with all sets of their proposals.

    A worker holds a block of those asked for, and the others stream by."""
    size = asked.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(most), F.sum(F.length("own")) / F.lit(BYTES))).alias("blocks"))
    size = size.join(sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("salts")), "root")
    held = asked.join(size, "root").select("root", _dealt("sign", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), F.lit(0).alias("kind"), "sign", "own")
    passing = sets.join(size, "root").select("root", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), _dealt("sign", F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "sign", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, own_sets, index = None, [], [], None
        for batch in batches:
            pairs = []
            for root, block, salt, kind, sign, own in zip(*(batch.column(c).to_pylist() for c in ("root", "block", "salt", "kind", "sign", "own")), strict=True):
                if (root, block, salt) != key:
                    key, names, own_sets, index = (root, block, salt), [], [], None
                if kind == 0:
                    names.append(sign)
                    own_sets.append(np.frombuffer(own, np.uint64))
                elif names:
                    index = index or Index(own_sets)
                    near = np.flatnonzero(index.similarity(np.frombuffer(own, np.uint64)) >= least)
                    pairs += [(sign, names[i]) for i in near.tolist() if names[i] != sign]
            yield _edges(pairs)

    rows = held.unionByName(passing).repartition(F.xxhash64("root", "block", "salt")).sortWithinPartitions("root", "block", "salt", "kind")
    return checkpointed(rows.mapInArrow(run, "a string, b string").distinct())


def _numbered(edges: DataFrame) -> DataFrame:
    return edges.select(_number("a").alias("a"), _number("b").alias("b"))


def _outside(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets that are not of the largest class of their proposal, by the edges found so far."""
    found = connected_components(_numbered(edges)).select(F.col("node").alias("number"), F.col("root").alias("class"))
    known = sets.select("root", "sign", _number("sign").alias("number")).join(found, "number", "left")
    known = checkpointed(known.select("root", "sign", F.coalesce("class", "number").alias("class")))
    largest = known.groupBy("root", "class").count().groupBy("root").agg(F.max(F.struct("count", "class")).alias("top")).select("root", "top.class")
    return sets.join(known.join(largest, ["root", "class"], "left_anti").select("root", "sign"), ["root", "sign"], "left_semi")


def _pivots(sets: DataFrame, pivots: int) -> DataFrame:
    """(root, sign) of a few sets of each proposal, drawn by hash: the first of each of as many parts."""
    part = F.pmod(F.xxhash64("sign", F.lit("pivot")), F.lit(pivots))
    return sets.groupBy("root", part.alias("part")).agg(F.min("sign").alias("sign")).select("root", "sign")


def _confirmed(sets: DataFrame, least: float, most: int, rounds: int, pivots: int) -> DataFrame:
    """Links (a, b) of sets(root, sign, own) that hold together what is linked."""
    size = checkpointed(sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("own")).alias("bytes")))
    large = size.filter((F.col("n") > most) | ((F.col("bytes") > BYTES) & (F.col("n") > 2)))
    edges = _within(sets.join(large, "root", "left_anti"), least)
    if large.isEmpty():
        return edges
    rest = every = checkpointed(sets.join(large, "root", "left_semi"))
    found = None
    for _ in range(rounds):
        met = _meet(rest.join(_pivots(rest, pivots), ["root", "sign"], "left_semi"), every, least, most)
        found = met if found is None else found.unionByName(met)
        rest = checkpointed(_outside(every, found))
        if rest.isEmpty():
            break
    met = _meet(rest, every, least, most)
    return edges.unionByName(met if found is None else found.unionByName(met))


def _classed(docs: DataFrame, id_col: str, text_col: str, radius: int, words: int, least: float, copies: int, most: int, rounds: int, pivots: int) -> DataFrame:
    """(doc_id, digest, root, component_id) of each row."""
    rows = checkpointed(_facts(docs, id_col, text_col, words, copies))
    # equal sets of shingles have equal sets of words, and so equal fingerprints; one of the rows is read again
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row")
    distinct = rows.groupBy("sign").agg(row, *(F.min(f).alias(f) for f in _names(copies)))
    distinct = checkpointed(distinct.select("sign", "row.doc_id", "row.digest", F.xxhash64("sign").alias("node"), *_names(copies)))
    proposed = _proposals(distinct.select("node", *_names(copies)), radius, copies)  # a node only names a proposal
    asked = checkpointed(distinct.join(proposed, "node").select("root", "sign", F.col("doc_id").alias("of"), F.col("digest").alias("text_digest")))
    near = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    own = id_and_text(docs, id_col, text_col)
    texts = own.join(near, own["doc_id"].eqNullSafe(near["of"]) & (F.xxhash64(own["text"]) == near["text_digest"]))
    sets = checkpointed(_sets_of(texts.select("root", "sign", "text"), words))
    found = connected_components(_numbered(_confirmed(sets, least, most, rounds, pivots)))
    named = distinct.select("sign", F.col("doc_id").alias("least"), _number("sign").alias("number"))
    grouped = checkpointed(named.join(found.withColumnRenamed("node", "number"), "number", "left").select("sign", "least", F.coalesce("root", "number").alias("root")))
    component = checkpointed(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.select("doc_id", "digest", "sign").join(grouped.join(component, "root").select("sign", "root", "component_id"), "sign").select("doc_id", "digest", "root", "component_id")


def verified_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, least: float = SIMILAR, copies: int = COPIES, most: int = MOST, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, component_id) of each row; see the module's notes."""
    return _classed(docs, id_col, text_col, radius, words, least, copies, most, rounds, pivots).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """The rows of docs, one for each component, as simhash.keep_least chooses it."""
    return keep_least(docs, _classed(docs, id_col, text_col, radius, words, least, COPIES, MOST, ROUNDS, PIVOTS), id_col, text_col)

"""A quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing.  Nobody knows how right they are: expectation-maximisation
over the counts of vote patterns estimates, for each labeller, how often it votes good and bad on good documents and on each kind
of bad ones.  The posterior of a pattern then is the label of its documents, and a hashed linear scorer (words and word shapes) learns these
labels; it judges every document, also where the labellers are silent.

Scale: the votes of all documents meet as counts of at most 3^LABELLERS patterns, so that many rows a task are shuffled.  The
scorer is fitted on a sample of at most SAMPLE documents, drawn by a hash of id and text; all documents are scored one by one.
Nothing else is sampled, texts are read whole, and no text moves.

Nulls: a null text is empty; a document without words gets no votes and, having no features, the scorer's bias alone.  Null ids and
repeated rows stay, each judged on its own.  Empty table: empty.  If all vote alike, nothing is rejected.  A long text is read in
one worker, with some 100 bytes of memory for each of its words.  Ids are whole numbers.  classify reads only the id and the
text; keep_good keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_bytes, chunks, id_and_text, spread
from .textbytes import LOWER, Words, hash_ranges, mix

BITS = 16
SAMPLE = 4000
#: A document is kept if the scorer thinks it good with at least this probability.
LEAST = 0.3
GOOD, SILENT, BAD = 2, 1, 0
NAMES = ("symbols", "capitals", "repeated_lines", "short_words", "sentence_ends", "word_length", "stutter")
PATTERNS = 3 ** len(NAMES)
_CLASS = np.array([32 if c == 32 else 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(97, 123))) | (np.arange(256) >= 128)
_END = np.isin(np.arange(256), list(b".!?"))


def _per_doc(w: Words, flags: np.ndarray) -> np.ndarray:
    """How many of a text's bytes are flagged."""
    total = np.concatenate([[0], np.cumsum(flags)])
    edge = np.append(w.start, len(w.raw))[w.first]
    return np.diff(total[edge])


def votes(texts: list[bytes], w: Words) -> np.ndarray:
    """A vote of each labeller (columns) on each text."""
    n = np.diff(w.first)
    some = np.maximum(n, 1)
    size = w.end - w.start
    letters = np.maximum(_per_doc(w, _LETTER[w.raw]), 1)
    out = np.full((len(texts), len(NAMES)), SILENT, np.int64)

    def cast(k: int, bad: np.ndarray, good: np.ndarray) -> None:
        out[:, k] = np.where(n == 0, SILENT, np.where(bad, BAD, np.where(good, GOOD, SILENT)))

    x = _per_doc(w, _SYMBOL[w.raw]) / some
    cast(0, x > 0.25, x < 0.05)
    x = _per_doc(w, _UPPER[w.raw]) / letters
    cast(1, x > 0.35, x < 0.12)
    lines = [[t for t in text.split(b"\n") if len(t) > 20] for text in texts]
    count = np.array([len(x) for x in lines])
    x = 1 - np.array([len(set(x)) for x in lines]) / np.maximum(count, 1)
    cast(2, (x > 0.3) & (count > 3), (x == 0) & (count > 3))
    short = np.concatenate([[0], np.cumsum(size <= 3)])
    x = np.diff(short[w.first]) / some
    cast(3, (x < 0.12) & (n > 20), (x > 0.2) & (x < 0.75) & (n > 20))
    last = w.buf[np.maximum(w.end - 1, 0)] if len(w) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(_END[last])])
    x = np.diff(ends[w.first]) / some
    cast(4, ((x < 0.01) | (x > 0.6)) & (n > 40), (x > 0.03) & (x < 0.4) & (n > 10))
    long = np.concatenate([[0], np.cumsum(size)])
    x = np.diff(long[w.first]) / some
    cast(5, ((x > 11) | (x < 2)) & (n > 10), (x > 3.5) & (x < 8) & (n > 10))
    again = np.concatenate([[0], np.cumsum(stutters(w))])
    x = np.diff(again[w.first]) / some
    cast(6, (x > 0.15) & (n > 10), (x < 0.05) & (n > 10))
    return out


def stutters(w: Words) -> np.ndarray:
    """Whether each word equals the one before."""
    h = hash_ranges(w.buf, w.start, w.end)
    out = np.zeros(len(h), bool)
    out[1:] = h[1:] == h[:-1]
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the count of each pattern: the posterior that its documents are good; of each labeller the chance of a good and of a
    bad vote, when it votes, in each class (labeller, class, bad or good); the classes' shares.

    Class 0 is good; as bad documents come in kinds that trip different labellers, class k+1 starts as those that
    labeller k calls bad.  Silence is no evidence."""
    k = int(round(np.log(len(counts)) / np.log(3)))
    cast = np.stack([np.arange(len(counts)) // 3**i % 3 for i in range(k)], axis=1)
    bad, good = cast == BAD, cast == GOOD
    post = np.full((k + 1, len(counts)), 1e-3)
    post[0] += ~bad.any(axis=1)
    post[1:] += bad.T / np.maximum(bad.sum(axis=1), 1)
    post /= post.sum(axis=0)
    for _ in range(rounds):
        weight = post * counts
        hits = np.stack([weight @ bad, weight @ good], axis=2)  # class, labeller, vote
        hits[0] += [0.02, 1.98]  # a labeller is right, until shown otherwise
        hits[1:] += 1.0
        chance = hits / hits.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (counts.sum() + k + 1)
        logs = np.log(share)[:, None] + np.log(chance[:, :, 0]) @ bad.T + np.log(chance[:, :, 1]) @ good.T
        post = np.exp(logs - logs.max(axis=0))
        post /= post.sum(axis=0)
    return post[0], chance.transpose(1, 0, 2), share


def features(texts: list[bytes], w: Words) -> np.ndarray:
    """Three hashed features a word: itself in lower case, its shape (runs of letter, capital, digit, other bytes), and
    whether it repeats the word before."""
    top = np.uint64((1 << BITS) - 1)
    low = np.frombuffer(w.buf.tobytes().translate(LOWER), np.uint8)
    word = mix(hash_ranges(low, w.start, w.end)) & top
    kind = _CLASS[w.raw]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    kind = kind[keep]
    end = np.flatnonzero(kind == 32)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    shape = mix(hash_ranges(np.concatenate([kind, np.zeros(8, np.uint8)]), start, end) + np.uint64(1)) & top
    again = mix(stutters(w).astype(np.uint64) + np.uint64(2)) & top
    return np.stack([word, shape, again], axis=1).astype(np.int64)


def _means(weights: np.ndarray, f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean weight of each text's features, 0 without any."""
    total = np.concatenate([[0.0], np.cumsum(weights[f].sum(axis=1))])
    return np.diff(total[first]) / np.maximum(f.shape[1] * np.diff(first), 1)


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 300, rate: float = 30.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent on mean features; labels may be any probability."""
    weights, bias = np.zeros(1 << BITS), 0.0
    of = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    at = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    for _ in range(steps):
        z = np.bincount(of, weights[at] * value, minlength=len(rows)) + bias
        wrong = (label - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) / max(len(rows), 1)
        weights += rate * np.bincount(at, wrong[of] * value, minlength=1 << BITS) - decay * weights
        bias += wrong.sum()
    return weights, float(bias)


class Model:
    def __init__(self, posterior: np.ndarray, chance: np.ndarray, prior: np.ndarray, weights: np.ndarray, bias: float):
        self.posterior, self.chance, self.prior, self.weights, self.bias = posterior, chance, prior, weights, bias

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its pattern, the pattern's posterior, the scorer's probability."""
        w = Words(texts)
        p = pattern(votes(texts, w))
        z = _means(self.weights, features(texts, w), w.first) + self.bias
        return p, self.posterior[p], 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    text = id_and_text(docs, id_col, text_col)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(PATTERNS, np.int64)
        for x in chunks(batches):
            texts = as_bytes(x.column("text"))
            count += np.bincount(pattern(votes(texts, Words(texts))), minlength=PATTERNS)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own])], ["pattern", "n"])

    counts = np.zeros(PATTERNS)
    for r in text.mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
        counts[r.pattern] = r.n
    posterior, chance, prior = estimate(counts)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    few = text.withColumn("drawn", drawn).filter(F.col("drawn") < min(1.0, 1.3 * sample / max(1.0, counts.sum())) * (1 << 30))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches):
            texts = as_bytes(x.column("text"))
            w = Words(texts)
            f, p, at, value = features(texts, w), pattern(votes(texts, w)), [], []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                i, n = np.unique(f[a:b], return_counts=True)
                at.append(i.astype(np.int32).tobytes())
                value.append((n / max(1, f.shape[1] * (b - a))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([x.column("drawn"), pa.array(p), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["drawn", "pattern", "at", "value"])

    got = few.mapInArrow(sparse, "drawn long, pattern long, at binary, value binary").orderBy("drawn", "pattern", "at").limit(sample).collect()
    rows = [(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.value, np.float32).astype(float)) for r in got]
    weights, bias = fit_linear(rows, posterior[[r.pattern for r in got]] if got else np.zeros(0))
    return Model(posterior, chance, prior, weights, bias)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of each row; votes: + good, - bad, 0 silent, in the order of NAMES."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    sign = "-0+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches):
            p, posterior, score = sent.value.score(as_bytes(x.column("text")))
            cast = ["".join(sign[k // 3**i % 3] for i in range(len(NAMES))) for k in p.tolist()]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(cast, pa.string()), pa.array(posterior), pa.array(score), pa.array(score >= least)], ["doc_id", "votes", "posterior", "score", "keep"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, votes string, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that the scorer doesn't reject, as they are."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches, at):
            yield x.filter(pa.array(sent.value.score(as_bytes(x.column(at)))[2] >= least))

    return spread(docs).mapInArrow(run, docs.schema)

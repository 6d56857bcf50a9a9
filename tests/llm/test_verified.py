"""Near duplicates of the pipeline against a brute-force comparison of all pairs."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quarry.llm import simhash, verified

SCHEMA = "doc_id long, text string"


def shingles(text, k=5):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1))))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def words_of(text):
    return sorted({x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")})


def scrambled(h):
    """The bijection that makes other hash functions of one."""
    top = 2**64 - 1
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & top
    h ^= h >> 29
    h = h * 0x9E3779B97F4A7C15 & top
    return h ^ h >> 32


def fingerprint(words, k):
    """Bit by bit: a vote for each distinct word."""
    h = [scrambled((xxhash.xxh64_intdigest(w.encode(), 42) + k * 0x9E3779B97F4A7C15) % 2**64) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_hand(rows, radius, least):
    """Components of pairs within a proposal that share enough shingles."""
    n = len(rows)
    fps = [[fingerprint(words_of(t), k) for k in range(verified.COPIES)] for _, t in rows]
    own = [shingles(t) for _, t in rows]

    def components(linked, inside):
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(n):
            for j in range(i):
                if inside(i, j) and linked(i, j):
                    root[find(i)] = find(j)
        return [find(i) for i in range(n)]

    coarse = components(lambda i, j: min((a ^ b).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= radius, lambda i, j: True)
    fine = components(lambda i, j: jaccard(own[i], own[j]) >= least, lambda i, j: coarse[i] == coarse[j] or own[i] == own[j])
    ids = {}
    for (d, _), r in zip(rows, fine, strict=True):
        ids[r] = min((x for x in (ids.get(r), d) if x is not None), default=None)
    return coarse, [(d, ids[r]) for (d, _), r in zip(rows, fine, strict=True)]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    rows = []
    for k in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        rows += [(None, edited(rng, base, n)) for n in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    return rows + [(3, rows[3][1]), (900, None), (901, ""), (None, rows[12][1]), (902, "a b"), (903, "A  b"), (904, "a c")]


@pytest.mark.parametrize("most, rounds, pivots", [(256, 2, 32), (4, 2, 2), (3, 0, 1), (2, 1, 1)])
def test_equals_all_pairs(spark, made, most, rounds, pivots):
    coarse, want = by_hand(made, verified.RADIUS, 0.8)
    out = verified.verified_duplicates(spark.createDataFrame(made, SCHEMA), most=most, rounds=rounds, pivots=pivots).collect()
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in out))) == sorted(map(repr, want))
    assert len(set(coarse)) < len({c for _, c in want})  # fingerprints alone would drop more


def test_stage_keeps_documents_below_the_threshold(spark, sf, made):
    docs = spark.createDataFrame([r for r in made if r[0] is not None], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).select("doc_id").collect()}
    _, want = by_hand([r for r in made if r[0] is not None], verified.RADIUS, 0.8)
    assert kept == {c for _, c in want}


def test_similarity():
    a, b = verified.shingle_sets([b"a b c d e f", b"a b c d e g"])
    assert verified.Index([a, b, np.zeros(0, np.uint64)]).similarity(a).tolist() == [1.0, 1 / 3, 0.0]
    assert verified.Index([a, np.zeros(0, np.uint64)]).similarity(np.zeros(0, np.uint64)).tolist() == [0.0, 1.0]


def pairs_that_share(texts, least):
    """All pairs of different shingle sets that reach the threshold: those who share none of their rarest shingles can't."""
    own = list({shingles(t) for t in texts})
    of = {}
    for i, s in enumerate(own):
        for x in s:
            of.setdefault(x, []).append(i)
    found = set()
    for i, s in enumerate(own):
        rare = sorted(s, key=lambda x: (len(of[x]), x))[: len(s) - math.ceil(least * len(s)) + 1]
        for j in {j for x in rare for j in of[x] if j < i}:
            if jaccard(s, own[j]) >= least:
                found.add((j, i))
    return own, found


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_proposals(spark, folder):
    """Of all pairs that reach the threshold, how many the result joins; and it joins no document without such a pair."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    of = {r.doc_id: r.component_id for r in verified.verified_duplicates(docs).collect()}
    own, pairs = pairs_that_share(texts.values(), 0.8)
    at = {s: i for i, s in enumerate(own)}
    by_set = {}
    for d, t in texts.items():
        by_set.setdefault(at[shingles(t)], []).append(of[d])
    assert all(len(set(c)) == 1 for c in by_set.values())
    joined = [(i, j) for i, j in pairs if by_set[i][0] == by_set[j][0]]
    assert len(joined) >= 0.9 * len(pairs)
    linked = {i for pair in pairs for i in pair}
    counts = {}
    for i, c in by_set.items():
        counts.setdefault(c[0], []).append(i)
    assert all(len(g) == 1 or set(g) <= linked for g in counts.values())


def test_texts_with_one_id(spark):
    """Each class keeps a row of its own texts, whatever ids repeat."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, a), (None, b), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for found in (verified.deduplicate(docs), simhash.deduplicate(docs)):
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(3, a), (5, b), (7, c), (None, b), (None, None)]))
    empty = spark.createDataFrame([], SCHEMA + ", keep string, row int, digest int, root int, sign int")
    for found in (verified.deduplicate(empty), simhash.deduplicate(empty)):
        assert found.columns == empty.columns and not found.collect()

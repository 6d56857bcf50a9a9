"""Scores and emitted columns, recomputed one step at a time."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from quarry.llm import bpe, quality_rules, queries, secret_scan, textbytes, weak_quality
from quarry.llm.queries import tokenizer_file, tokenizer_pattern

from test_text_operators import components_by_hand, counts_by_hand, fingerprint_by_hand, secrets_by_hand

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def patterns(n):
    return [[p // 3**i % 3 for i in range(n)] for p in range(3**n)]


def estimate_by_hand(counts, n, rounds):
    """Expectation maximisation, one pattern and one class at a time."""
    every, bad, good = patterns(n), weak_quality.BAD, weak_quality.GOOD
    post = []
    for cast in every:
        k = sum(v == bad for v in cast)
        start = [1e-3 + (k == 0)] + [1e-3 + (v == bad) / max(k, 1) for v in cast]
        post.append([x / sum(start) for x in start])
    for _ in range(rounds):
        chance, share = {}, []
        for c in range(n + 1):
            weight = [counts[p] * post[p][c] for p in range(len(every))]
            share.append((sum(weight) + 1) / (sum(counts) + n + 1))
            for i in range(n):
                b = sum(w for w, cast in zip(weight, every, strict=True) if cast[i] == bad) + (0.02 if c == 0 else 1.0)
                g = sum(w for w, cast in zip(weight, every, strict=True) if cast[i] == good) + (1.98 if c == 0 else 1.0)
                chance[i, c] = (b / (b + g), g / (b + g))
        for p, cast in enumerate(every):
            x = [s * math.prod(chance[i, c][0] if v == bad else chance[i, c][1] if v == good else 1.0 for i, v in enumerate(cast)) for c, s in enumerate(share)]
            post[p] = [y / sum(x) for y in x]
    return [x[0] for x in post], chance, share


def test_expectation_maximisation_by_hand():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 3**3).astype(float)
    posterior, chance, share = weak_quality.estimate(counts, rounds=7)
    want, chances, shares = estimate_by_hand(counts.tolist(), 3, 7)
    assert posterior == pytest.approx(want, rel=1e-6) and share == pytest.approx(shares, rel=1e-6)
    assert all(chance[i, c] == pytest.approx(chances[i, c], rel=1e-6) for i in range(3) for c in range(4))


def votes_by_hand(text):
    words = [w for w in WORD.findall(text)]
    n = len(words)
    if not n:
        return [weak_quality.SILENT] * 7
    raw = [w.encode() for w in words]
    letters = max(1, sum(b >= 128 or chr(b).isalpha() for w in raw for b in w))
    lines = [t for t in text.encode().split(b"\n") if len(t) > 20]
    again = sum(a == b for a, b in zip(raw, raw[1:], strict=False))
    x = [sum(c in b"#*$%&|<>" for w in raw for c in w) / n, sum(65 <= c <= 90 for w in raw for c in w) / letters, 1 - len(set(lines)) / max(1, len(lines)), sum(len(w) <= 3 for w in raw) / n, sum(w[-1:] in (b".", b"!", b"?") for w in raw) / n, sum(map(len, raw)) / n, again / n]
    bad = [x[0] > 0.25, x[1] > 0.35, x[2] > 0.3 and len(lines) > 3, x[3] < 0.12 and n > 20, (x[4] < 0.01 or x[4] > 0.6) and n > 40, (x[5] > 11 or x[5] < 2) and n > 10, x[6] > 0.15 and n > 10]
    good = [x[0] < 0.05, x[1] < 0.12, x[2] == 0 and len(lines) > 3, 0.2 < x[3] < 0.75 and n > 20, 0.03 < x[4] < 0.4 and n > 10, 3.5 < x[5] < 8 and n > 10, x[6] < 0.05 and n > 10]
    return [weak_quality.BAD if b else weak_quality.GOOD if g else weak_quality.SILENT for b, g in zip(bad, good, strict=True)]


def features_by_hand(text):
    """Word, shape and stutter of each word, hashed one by one."""
    top, out, before = (1 << weak_quality.BITS) - 1, [], None

    def hashed(data, plus=0):
        buf = np.frombuffer(data + b"\0" * 8, np.uint8)
        h = textbytes.hash_ranges(buf, np.array([0]), np.array([len(data)])) + np.uint64(plus)
        return int(textbytes.mix(h)[0]) & top

    for w in WORD.findall(text):
        raw = w.encode()
        kind = re.sub(rb"(.)\1+", rb"\1", bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in raw), flags=re.S)
        out.append([hashed(raw.translate(textbytes.LOWER)), hashed(kind, 1), int(textbytes.mix(np.array([2 + (raw == before)], np.uint64))[0]) & top])
        before = raw
    return out


def test_weak_labels_by_hand(spark, docs, rows):
    """Votes, their counts, the posterior, the features and the score of every document."""
    model = weak_quality.train(docs)
    cast = {i: votes_by_hand(t or "") for i, t in rows}
    counts = Counter(tuple(v) for v in cast.values())
    number = {tuple(p): k for k, p in enumerate(patterns(7))}
    dense = np.zeros(3**7)
    for v, n in counts.items():
        dense[number[v]] = n
    posterior = weak_quality.estimate(dense)[0]
    for r in weak_quality.classify(docs, model).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.votes == "".join("-0+"[v] for v in cast[r.doc_id])
        assert r.posterior == pytest.approx(posterior[number[tuple(cast[r.doc_id])]], abs=1e-9)
        f = [x for w in features_by_hand(text) for x in w]
        z = sum(model.weights[x] for x in f) / max(1, len(f)) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), abs=1e-6) and r.keep == (r.score >= weak_quality.LEAST)


def test_the_linear_scorer_by_hand():
    rows = [(np.array([1, 5]), np.array([0.5, 0.5])), (np.array([2]), np.array([1.0])), (np.zeros(0, np.int64), np.zeros(0))]
    label = np.array([1.0, 0.2, 0.6])
    weights, bias = weak_quality.fit_linear(rows, label, steps=20)
    w, b = {}, 0.0
    for _ in range(20):
        wrong = [(y - 1 / (1 + math.exp(-(sum(w.get(k, 0.0) * v for k, v in zip(i.tolist(), x.tolist(), strict=True)) + b)))) / 3 for (i, x), y in zip(rows, label, strict=True)]
        step = {}
        for (i, x), e in zip(rows, wrong, strict=True):
            for k, v in zip(i.tolist(), x.tolist(), strict=True):
                step[k] = step.get(k, 0.0) + e * v
        w = {k: w.get(k, 0.0) + 30.0 * step.get(k, 0.0) - 1e-6 * w.get(k, 0.0) for k in {*w, *step}}
        b += sum(wrong)
    assert bias == pytest.approx(b) and {k: weights[k] for k in w} == pytest.approx(w)


def test_quality_score_and_verdict_by_hand(spark):
    """The score of every document, the threshold and the verdict, from the published hash up."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    n, seen = quality_rules.BUCKETS, {}

    def bucket(*words):
        if words not in seen:
            h = 42
            for w in words:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            seen[words] = h % n if h < 2**63 else (h - 2**64) % n
        return seen[words]

    def grams(text):
        w = WORD.findall(text)
        return [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:], strict=False)]

    own = {i: grams(t) for i, t in rows}
    corpus, target = Counter(), Counter()
    for i, g in own.items():
        corpus.update(g)
        target.update(g if i in good else ())
    all_corpus, all_target = sum(corpus.values()), sum(target.values())
    ratio = [math.log((target[g] + 1) / (all_target + n)) - math.log((corpus[g] + 1) / (all_corpus + n)) for g in range(n)]
    score = {i: sum(ratio[x] for x in g) / len(g) if g else 0.0 for i, g in own.items()}
    failed = {i: counts_by_hand(t)[-1] for i, t in rows}
    x = [round(score[i] * 1e6) for i in own if i in good and not failed[i]]
    least = (np.mean(x) - quality_rules.SPREAD * np.std(x)) / 1e6
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(score[r.doc_id], abs=1e-9)
        assert r.kept == (not failed[r.doc_id] and score[r.doc_id] >= least) or abs(score[r.doc_id] - least) < 1e-6


def test_simhash_columns(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, sf).collect()}
    assert len(got) == len(rows)
    assert all(got[i].fingerprint == f"{fingerprint_by_hand(t, 3):016x}" for i, t in rows)
    assert all(got[i].component_id == c for i, _, c in components_by_hand(rows, 3, 2))


def test_bpe_columns(spark, sf, rows):
    import tiktoken

    ranks = bpe.read_ranks(Path(tokenizer_file("byte_bpe_50k.tiktoken")).read_bytes())
    library = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op6_bpe(spark, sf).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_secret_columns(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op10_secret_scan(spark, sf).collect()}
    text = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for i, t in rows:
        base, spans = secrets_by_hand(t)
        kinds = Counter(k for _, k, _ in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds[0], kinds[1], kinds[2])
        assert got[i].base_sha256 == hashlib.sha256(text(base).encode()).hexdigest() and got[i].spans == text(spans)

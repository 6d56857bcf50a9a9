"""Each text operator against a brute-force version, on odd rows and on a real table."""

import base64
import hashlib
import math
import random
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from quarry.llm import bpe, decontaminate, langid, quality_rules, secret_scan, simhash, substring_dedup, textbytes, token_counts, weak_quality
from quarry.llm.queries import tokenizer_file, tokenizer_pattern

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "the cat sat on the mat and the dog sat on the log near the old mill"),
    (2, "the cat sat on the mat and the dog sat on the log near the old mill"),
    (2, "the cat sat on the mat and the dog sat on the log near the old mill"),
    (None, "the cat sat on the mat and the dog sat on the log near the old mill"),
    (3, None),
    (4, ""),
    (5, " \n\t \r\n"),
    (None, None),
    (6, "word " * 3000),
    (7, "naïve été 漢字 😀 " * 9 + "\x0b\x1c\x85end"),
    (8, "x" * 20000),
    (9, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns that clash with those the operators make."""
    rows = [(i, t, "en", i, "k", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp long, kind string, score double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_hashes_of_ranges():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(4000)) + b"\0" * 8
    start = np.array([rng.randrange(3000) for _ in range(800)])
    end = start + np.array([rng.choice([0, 1, 3, 4, 7, 8, 12, 20, 31, 32, 33, 63, 64, 65, 900]) for _ in start])
    buf = np.frombuffer(data, np.uint8)
    got = textbytes.xxh64_ranges(buf, start, end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(start, end, strict=True)]
    assert textbytes.same_ranges(buf, start, end, start, end).all()


def dedup_by_hand(rows, window):
    none = 2**63 - 1
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, none), none if i is None else i)
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (none if i is None else i):
                gone[k : k + window] = [True] * window
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def test_substring_dedup(spark, odd, docs, rows):
    same(substring_dedup.substring_dedup(odd).collect(), dedup_by_hand(ODD, 13))
    same(substring_dedup.substring_dedup(docs).collect(), dedup_by_hand(rows, 13))
    same(substring_dedup.substring_dedup(docs, most=5000).collect(), dedup_by_hand(rows, 13))  # several passes a bucket
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0
    rng = random.Random(3)
    few = [(rng.choice([None, 1, 2, 3, 4]), " ".join(rng.choice("abcd") for _ in range(rng.randrange(50)))) for _ in range(120)]
    frame = spark.createDataFrame(few, "doc_id long, text string").repartition(4)
    for window, piece in ((3, 2), (5, 5), (4, 1)):
        same(substring_dedup.substring_dedup(frame, window=window, piece=piece).collect(), dedup_by_hand(few, window))


def test_a_window_in_every_document(spark, monkeypatch):
    """A passage that all documents share, in buckets that are folded as they come, and hot by count or not at all."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))) + f" {passage} " + "x " * rng.randrange(20)) for i in rng.sample(range(10_000), 800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(substring_dedup, "CHUNK", 2000)
    for many, hot in ((1_000_000, 4000), (20, 4000), (1_000_000, 1)):
        monkeypatch.setattr(substring_dedup, "MANY", many)
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        for most in (1000, 20_000, 1 << 20):
            same(substring_dedup.substring_dedup(frame, most=most).collect(), dedup_by_hand(rows, 13))


def test_windows_whose_hashes_collide():
    text = np.frombuffer(b"aa bb cc dd aa bb " + b"\0" * 8, np.uint8)
    start, end = np.array([0, 6, 12]), np.array([5, 11, 17])
    ids, keys, pos = substring_dedup._repeated(text, start, end, np.zeros(3, np.uint64), np.array([1, 2, 3]), np.zeros(3, np.int64), np.arange(3))
    assert ids.tolist() == [3]  # "cc dd" is another window with the same hash


def fingerprint_by_hand(text, n):
    w = (text or "").encode().translate(textbytes.LOWER).split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows, n, radius):
    fps = sorted({fingerprint_by_hand(t, n) for _, t in rows})
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(fingerprint_by_hand(t, n))
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, int(np.uint64(fingerprint_by_hand(t, n)).astype(np.int64)), least.get(find(fingerprint_by_hand(t, n)))) for i, t in rows]


def test_near_duplicates(odd, docs, rows):
    same(simhash.near_duplicates(odd).collect(), components_by_hand(ODD, 3, 2))
    same(simhash.near_duplicates(docs).collect(), components_by_hand(rows, 3, 2))
    same(simhash.near_duplicates(docs, radius=4, pairwise=1).collect(), components_by_hand(rows, 3, 4))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, 7, 8, 9, None, None]


def test_covering_masks_miss_nothing():
    for radius in (2, 4, 6):
        own = [m & (2**64 - 1) for m in simhash.masks(radius)]
        assert min(m.bit_count() for m in own) >= 32
        rng = random.Random(radius)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(flip & m == 0 for m in own)


def test_a_bucket_too_large_for_pairs(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base} | {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {rng.getrandbits(64) for _ in range(50)})
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for pairwise in (8, 100_000):
        found = simhash.connected_components(simhash.links(frame, 2, pairwise)).collect()
        groups = Counter(r.root for r in found)
        assert list(groups.values()) == [len(fps) - 50]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    for per_task in (1_000_000, 70, 7):  # joined by one task, or in rounds
        found = sorted((r.node, r.root) for r in simhash.connected_components(edges.repartition(40), per_task=per_task).collect())
        assert found == sorted({(i, 0) for i in range(201)} | {(1000, 1000), (1001, 1000)})
    assert simhash.connected_components(edges.limit(0)).count() == 0


def test_bpe_equals_the_library(odd, rows):
    import tiktoken

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Encoder(ranks, pattern)
    rng = random.Random(1)
    letters = "aabcde  \n\t\x1c\x85\xa0 éß漢字😀٣½'st.,!0123" + "".join(map(chr, (0x300, 0x2028, 0x1F600, 0x10FFFF)))
    texts = [t for _, t in rows] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 3000, " " * 999 + "x", "=" * 500, "é" * 700]
    for t in texts:
        want = " ".join(map(str, library.encode_ordinary(t))).encode()
        assert coder.encode(t) == want
        assert coder.decode(want) == t.encode()
    got = bpe.bpe_encode(odd, path, pattern, emit_ids=True).collect()
    same(((r.doc_id, r.ids, r.n_tokens, r.decoded_sha256) for r in got), ((i, ids := library.encode_ordinary(t or ""), len(ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD))
    assert bpe.bpe_encode(odd.limit(0), path, pattern).count() == 0


def test_edits_are_encoded_anew_only_near_them():
    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        own = bpe.PrefixBpe(bpe.read_ranks(f.read()))
    rng = random.Random(2)
    for _ in range(60):
        buffer = bpe.Buffer(own, bytes(rng.choice(b"abcdefgh eioutn") for _ in range(rng.randrange(300))))
        for _ in range(3):
            at = rng.randrange(len(buffer.data) + 1)
            buffer.edit(at, rng.randrange(min(5, len(buffer.data) - at) + 1), bytes(rng.choice(b"thenoua ") for _ in range(rng.randrange(6))))
            assert list(buffer.last) == list(own.prefix_table(buffer.data))
    long = bpe.Buffer(own, b"the quick brown fox " * 200)
    long.edit(100, 3, b"dog")
    assert long.work < 400 and list(long.last) == list(own.prefix_table(long.data))


def test_memos_are_bounded_in_bytes():
    """A long text without spaces leaves no long key behind, and is read in the time of its length."""
    coder = bpe.Encoder(bpe.read_ranks(Path(tokenizer_file("byte_bpe_50k.tiktoken")).read_bytes()), tokenizer_pattern())
    rng = random.Random(2)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(150_000))
    begun = time.monotonic()
    ids = coder.encode(text)
    assert time.monotonic() - begun < 20
    assert coder.decode(ids) == text.encode()
    counter = token_counts.Counter([("▁", -1.0), *((c, -2.0) for c in "etaoinshrdlu"), ("th", -2.5), ("eth", -2.6)])
    assert 100_000 < counter.count(text) <= 150_001
    for memo in (coder.memo, coder.bpe.prefixes, counter.memo):
        assert all(len(k) <= bpe.SHORT for part in (memo, memo.old) for k in part)


def test_token_counts_equal_the_library(odd, rows):
    from tokenizers import models

    path = tokenizer_file("piece_bpe_32k.model")
    pieces = token_counts.read_unigrams(path)
    names, library = {p for p, _ in pieces}, models.Unigram([("<unk>", 0.0), *pieces], 0, False)

    def by_library(text):
        got = library.tokenize("▁" + text.replace(" ", "▁")) if text else []
        return sum(1 if t.value in names else len(t.value.encode()) for t in got)

    counter = token_counts.Counter(pieces)
    rng = random.Random(2)
    letters = "the and ing  \n\t　é漢字😀ß'.,!0123 aeioutn   ▁"
    for t in [t for _, t in rows] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]:
        assert counter.count(t) == by_library(t), t
    same(token_counts.token_counts(odd, path).collect(), ((i, by_library(t or "")) for i, t in ODD))
    ties = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0)])
    assert ties.best("abc") == 1  # the candidate that starts first comes first
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def overlap_by_hand(rows, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(item)
    sizes = {len(w) for w in windows}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        yield i, len(w), len(hit), sorted(x for x in found if x is not None), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, odd, docs, rows, sf, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    pick = ("doc_id", "n_words", "n_hit", "items", "contaminated")
    got = decontaminate.find_overlap(docs, benchmark).select(*pick).collect()
    assert any(r.contaminated for r in got)
    whole = decontaminate.find_overlap(docs, benchmark).collect()
    same(got, overlap_by_hand(rows, items))
    own = [(1, "Sat on the MAT"), (1, "old mill"), (2, None), (3, ""), (None, "dog sat"), (4, "word " * 20)]
    few = spark.createDataFrame(own, "item_id long, text string")
    same(decontaminate.find_overlap(odd, few).select(*pick).collect(), overlap_by_hand(ODD, own))
    for block in (30, 2000):  # several scans
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        same(decontaminate.find_overlap(odd, few).select(*pick).collect(), overlap_by_hand(ODD, own))
        same(decontaminate.find_overlap(docs, benchmark).collect(), whole)
        want = [i for i, *_, bad in overlap_by_hand(ODD, own) if not bad]
        assert sorted((r.doc_id for r in decontaminate.decontaminate(odd, few).collect()), key=str) == sorted(want, key=str)
    monkeypatch.undo()
    spans = decontaminate.find_overlap(spark.createDataFrame([(1, "Hé! Sat, on (THE) mat.")], "doc_id long, text string"), few).first().spans
    assert [(s.start, s.end) for s in spans] == [(4, 21)]
    clean = decontaminate.decontaminate(odd, few)
    assert clean.columns == odd.columns
    want = [i for i, *_, bad in overlap_by_hand(ODD, own) if not bad]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(odd, few.limit(0)).count() == len(ODD)
    assert decontaminate.find_overlap(odd.limit(0), few).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 13])
def test_the_automaton_against_all_windows(window):
    rng = random.Random(window)
    for _ in range(150):
        make = lambda most: " ".join(rng.choice("abc") for _ in range(rng.randrange(most)))  # noqa: B023, E731
        items = [(rng.choice([None, 1, 2, 3, 4]), make(5 * window)) for _ in range(rng.randrange(5))]
        text = make(40)
        machine = decontaminate._automaton(tuple((i, t.encode()) for i, t in items), window)
        n, stretches, found = decontaminate.scan(text.encode(), machine)
        words, hit, want = text.split(), set(), set()
        for i, t in items:
            w = t.split()
            size = min(window, len(w))
            for a in range(len(w) - size + 1) if w else ():
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == w[a : a + size]:
                        hit |= set(range(p, p + size))
                        want.add(i)
        assert n == len(words) and found == want
        assert sorted(x for a, b in stretches for x in range(a, b)) == sorted(hit)


def test_a_large_item_set_is_one_automaton():
    """20 MB of items: the memory stays below 1.5 GB, built and used."""
    code = """
import random, resource, sys
sys.path[:0] = sys.argv[1:]
from quarry.llm import decontaminate
rng = random.Random(1)
words = ["%x" % rng.randrange(1 << 20) for _ in range(100000)]
items = tuple((i, " ".join(rng.choices(words, k=60)).encode()) for i in range(62000))
assert 19e6 < sum(len(t) for _, t in items) < decontaminate.BLOCK
machine = decontaminate._automaton(items, 13)
n, hit, found = decontaminate.scan(b"x y " + b" ".join(items[777][1].split()[20:40]) + b" z", machine)
assert (n, hit, found) == (23, [(2, 22)], {777})
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 1500


def secrets_by_hand(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, text, re.A) if len(m[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        if any(re.search(p, m[0]) for p in secret_scan.ALLOW):
            continue
        spans = []
        for i in range(len(m[0]) - 19):
            w = m[0][i : i + 20]
            kind = "hex" if re.fullmatch("[0-9a-fA-F]+", w) else "alnum" if w.isalnum() else "any"
            if -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) > secret_scan.LEAST[kind]:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + 20
                else:
                    spans.append([i, i + 20])
        more += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    base.sort()
    return base, sorted(base + [x for x in more if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)])


def masked_by_hand(text):
    out, at = "", 0
    for a, _, b in secrets_by_hand(text)[1]:
        if a >= at:
            out += text[at:a] + secret_scan.MASK
        at = max(at, b)
    return out + text[at:]


def test_many_secrets_are_masked_in_linear_time(spark):
    """30,000 secrets in one text, and a candidate with many spans."""
    rng = random.Random(4)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    long = "".join(rng.choice(["é ", "x ", "\n", f"token={value(14)}z ", f"AKIA{value(14).upper()} ", f"{value(18)} "]) for _ in range(60_000))
    mixed = "".join(value(22) + "a" * 30 for _ in range(600))
    small = "".join(rng.choice(["é ", f"token={value(14)}z", f"{value(18)} ", f"{value(30)}Qx7"]) for _ in range(300))
    for text in (long, mixed, small):
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.monotonic()
        got = secret_scan.redact(frame).first().text
        assert time.monotonic() - begun < 60
        assert re.sub(secret_scan.ASSIGN_ANYWHERE, secret_scan.MASK, masked_by_hand(text)) == got


def test_secrets(spark, odd, docs, rows):
    rng = random.Random(5)
    parts = ["password", "PassWord", "api_key", "token", "=", ":", " ", "  ", "'", '"', "abc", "é", "😀", "deadbeef01234567", "AKIA", "ABCDEF0123456789", "x9Kq2LmZ8pRt5Wv3Yb7N", "a" * 24, "0aZ/+_-=", "\n", ".", "sK4f9Lq2Zp8Xw1Rt6Vb3Nm7Jh5"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.choice([3, 10, 40, 900])))) for k in range(150)]
    for frame, own in ((spark.createDataFrame(texts, "doc_id long, text string"), texts), (odd, ODD), (docs, rows)):
        got = [(r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.spans]) for r in secret_scan.find_secrets(frame).collect()]
        same(got, ((i, *secrets_by_hand(t)) for i, t in own))
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns and masked.dtypes == docs.dtypes
    before = dict(rows)
    for r in masked.collect():
        assert not secrets_by_hand(r.text)[0]
        assert r.text == before[r.doc_id] or (secret_scan.MASK in r.text and r.n_chars == len(r.text))
        if not secrets_by_hand(before[r.doc_id])[1]:
            assert r.text == before[r.doc_id]
    same(secret_scan.redact(odd).select("doc_id", "text").collect(), ODD)
    assert secret_scan.redact(odd.limit(0)).count() == 0
    assert secret_scan.find_secrets(odd.limit(0)).count() == 0


def counts_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_rules(spark, odd, docs, rows, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    pick = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules.quality_rules(docs, labels)
    same(got.select(*pick).collect(), ((i, *counts_by_hand(t)) for i, t in rows))
    larger = sf.replace("sf0.001", "sf0.01")  # enough bad documents to count
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    good = {r.doc_id: r.quality for r in labels.collect()}
    found = quality_rules.quality_rules(spark.read.parquet(f"{larger}/documents.parquet"), labels)
    judged = [(good[r.doc_id], r.kept) for r in found.collect() if r.doc_id in good and not r.base_failed]
    assert len(judged) > 300
    assert all(kept for q, kept in judged if q) and sum(kept for q, kept in judged if not q) <= 0.2 * sum(not q for q, _ in judged)
    own = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    same(quality_rules.quality_rules(odd, own).select(*pick).collect(), ((i, *counts_by_hand(t)) for i, t in ODD))
    assert all(r.kept == (not r.base_failed) for r in quality_rules.quality_rules(odd, None).collect())
    assert quality_rules.quality_rules(odd.limit(0), own).count() == 0


def test_quality_verdict_rejects_bad_documents(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(docs, labels).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    assert sum(q == 0 for q, _ in judged) > 20
    assert all(kept == bool(q) for q, kept in judged)  # of 27 bad ones 4 were kept at six deviations


def test_quality_score_is_the_mean_log_ratio(spark):
    from pyspark.sql import functions as F

    text = spark.createDataFrame([("a b a", True), ("c d", False), ("", False)], "text string, target boolean")
    ratio = quality_rules.ratios(text)
    grams = {r.text: r.g for r in text.select("text", quality_rules.let(quality_rules.words(F.col("text")), quality_rules.ngrams).alias("g")).collect()}
    assert [len(grams[t]) for t in ("a b a", "c d", "")] == [5, 3, 0]
    corpus, target = Counter(grams["a b a"] + grams["c d"]), Counter(grams["a b a"])
    n = quality_rules.BUCKETS
    for g in corpus:
        assert ratio[g] == pytest.approx(math.log((target[g] + 1) / (5 + n)) - math.log((corpus[g] + 1) / (8 + n)))


def test_weak_labels(odd, docs, rows, spark, sf):
    model = weak_quality.train(docs)
    got = {r.doc_id: r for r in weak_quality.classify(docs, model).collect()}
    labels = [(r.quality, got[r.doc_id].keep) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert len(got) == len(rows) and np.mean([q == k for q, k in labels]) > 0.9
    kept = weak_quality.keep_good(docs, model)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.keep)
    assert weak_quality.classify(odd, weak_quality.train(odd)).count() == len(ODD)
    empty = odd.limit(0)
    assert weak_quality.classify(empty, weak_quality.train(empty)).count() == 0


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(1)
    k = len(weak_quality.NAMES)
    good = rng.random(40_000) < 0.8
    v = np.full((len(good), k), weak_quality.SILENT)
    kind = rng.integers(0, 3, len(good))
    for i in range(k):
        # bad documents of three kinds, each seen by some labellers, who miss a quarter; alarms on good ones are rare
        bad = np.where(good, rng.random(len(good)) < 0.001, (kind == i % 3) & (rng.random(len(good)) < 0.75))
        v[:, i] = np.where(rng.random(len(good)) < 0.2, weak_quality.SILENT, np.where(bad, weak_quality.BAD, weak_quality.GOOD))
    counts = np.bincount(weak_quality.pattern(v), minlength=weak_quality.PATTERNS).astype(float)
    posterior, chance, share = weak_quality.estimate(counts)
    seen = (v == weak_quality.BAD).any(axis=1)
    assert np.mean(((posterior[weak_quality.pattern(v)] > 0.5) == good)[good | seen]) > 0.98
    assert 0.78 < share[0] < 0.86 and (chance[:, 0, 0] < 0.01).all()


def test_gru_gradients():
    model = langid.BiGru(3, 4, kind=np.float64)
    x, y = np.frombuffer(b"abcdzzabqqaz", np.uint8).reshape(3, 4), np.array([0, 2, 1])
    _, grad = model.gradients(x, y)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        for _ in range(6):
            at = (int(rng.choice(x.ravel())), int(rng.integers(0, 12))) if name.startswith("wx") else tuple(int(rng.integers(0, n)) for n in g.shape)
            w = model.w[name]
            old = w[at]
            w[at] = old + 1e-5
            up = model.gradients(x, y)[0]
            w[at] = old - 1e-5
            down = model.gradients(x, y)[0]
            w[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def labels_by_hand(model, text):
    """The probabilities at each byte, one window and one step at a time, in double precision."""
    k, w = model.h, {n: x.astype(float) for n, x in model.w.items()}

    def states(d, data):
        h, out = np.zeros(k), []
        for byte in data:
            g, s = w[f"wx{d}"][byte], h @ w[f"u{d}"]
            r, z = (1 / (1 + np.exp(-(g + s)[i * k : (i + 1) * k])) for i in (0, 1))
            n = np.tanh(g[2 * k :] + r * s[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    out = []
    for start, end, first, last in langid.windows(text):
        assert len(out) == first and start == max(0, start) and (start == first or first - start <= langid.CONTEXT + 3)
        data = text[start:end]
        data.decode()  # cut between characters
        both = zip(states("f", data), states("b", data[::-1])[::-1], strict=True)
        logits = [np.concatenate(x) @ w["v"] + w["c"] for x in both][first - start : last - start]
        out += [np.exp(z - z.max()) / np.exp(z - z.max()).sum() for z in logits]
    assert len(out) == len(text)
    return np.array(out)


def test_rare_languages_are_learned(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "cat", "and", "dog"]) for _ in range(20)), "en") for i in range(3000)]
    rows += [(i, " ".join(rng.choice(["ñandu", "güey", "año"]) for _ in range(20)), "xx") for i in range(5000, 5012)] + [(8000 + i, None, "yy") for i in range(9)] + [(None, "a", "zz"), (7000, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, model = langid.train(docs, per_language=3)
    assert languages == ["en", "xx"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, languages, model).collect()}
    assert got[5001] == "xx" and got[1] == "en" and got[7000] in languages


def test_language_identification(spark, odd, docs):
    languages, model = langid.train(docs)
    got = langid.identify(docs, languages, model).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and abs(sum(r.probabilities) - 1) < 1e-3 for r in got)
    few = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, languages, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "und")} <= few and len(langid.identify(odd, languages, model).collect()) == len(ODD)
    # a document's probabilities are the mean over its bytes
    for text in ("Thé cat, sat 12!", "漢字かな " * 60 + "é", "x" * 700, "a"):
        got = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), languages, model).first()
        assert got.probabilities == pytest.approx(labels_by_hand(model, text.lower().encode()).mean(axis=0), abs=2e-3)
    none, nothing = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none, nothing).collect()} == {"und"}

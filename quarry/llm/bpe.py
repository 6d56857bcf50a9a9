"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Each prefix of a byte string has exactly one encoding, so one last token.  That token is the one suffix token
whose predecessor is the last token of the prefix before it and whose border with it BPE never merges away.
So `last[i]` for every prefix i is an exact encoding of all prefixes at once: an append adds entries, and after
an edit only the entries near it are made anew, until as many in a row as the longest token has bytes agree with the old.

Texts are split by the tokenizer's pattern first, whole texts, nothing cut.  Workers keep encodings of recent
pieces and prefixes in bounded memory.  The merge ranks are one file of fixed size that the driver reads and broadcasts.

Nulls: a null text is the empty text (no tokens).  A null id stays null.  Repeated rows stay.  Empty table: empty.
A long piece takes 4 bytes of memory for each of its bytes.  Ids are whole numbers.  Only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import chunks, id_and_text

#: Pieces and prefixes that a worker remembers (two generations of each at most).
MEMO = 250_000
#: Longer pieces are not remembered.
SHORT = 48
#: The pieces of longer texts are made one by one, not as a list.
LONG = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Recent(dict):
    """A memo of bounded size that forgets the older half.  Keys over SHORT are made anew each time, so its bytes are bounded too."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= SHORT:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class PrefixBpe:
    """Encodes byte strings exactly as merging by rank does."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks, self.most = ranks, memo
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.borders: dict[int, bool] = {}
        self.prefixes = Recent(None, memo)
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            ends.setdefault(token[-2:], set()).add(len(token))
        #: To two last bytes, the sizes of the tokens that end so, longest first; one byte is a token itself.
        self.sizes = {end: sorted(n | {1}, reverse=True) for end, n in ends.items() if len(end) == 2}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < i and b < i and self.stays(a, b):
                    self.left[i], self.right[i] = a, b
                    self.pairs[a, b] = i
                    break

    def stays(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between these neighbours: undo their merges, latest first, and
        see whether the two parts that then meet would have merged before."""
        left, right, pairs = self.left, self.right, self.pairs
        before = 1 << 62
        while True:
            if pairs.get((a, b), before) < before:
                return False
            if a > b and a in right:
                before, a = a, right[a]
            elif b in left:
                before, b = b + 1, left[b]
            elif a in right:
                before, a = a, right[a]
            else:
                return True

    def border(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) >= self.most:
                self.borders.clear()
            known = self.borders[key] = self.stays(a, b)
        return known

    def step(self, data: bytes, last: list[int], i: int) -> int:
        """The last token of data[:i], from those of shorter prefixes (made if need be; last[0] is unused)."""
        get = self.ranks.get
        for n in self.sizes.get(data[i - 2 : i], (1,)) if i > 1 else (1,):
            token = get(data[i - n : i]) if n <= i else None
            a = i - n
            if token is not None and (not a or self.border(last[a] if last[a] >= 0 else self.recall(data, last, a), token)):
                return token
        raise ValueError("the ranks have no token for a byte")

    def recall(self, data: bytes, last: list[int], i: int) -> int:
        """Fills in last[i] of a short piece."""
        key = data[:i]
        token = self.prefixes.get(key)
        if token is None:
            token = self.prefixes.old.get(key)
            if token is None:
                token = self.step(data, last, i)
            self.prefixes.keep(key, token)
        last[i] = token
        return token

    def prefix_table(self, data: bytes) -> list[int]:
        """last, whole."""
        last = array("i", [-1])
        for i in range(1, len(data) + 1):
            last.append(self.step(data, last, i))
        return last

    def known_table(self, data: bytes) -> list[int]:
        """last, as far as it takes to read the encoding; goes on from the longest prefix remembered."""
        memo, old, n = self.prefixes, self.prefixes.old, len(data)
        last, i = [-1] * (n + 1), n
        while i:
            token = memo.get(data[:i])
            if token is None:
                token = old.get(data[:i])
            if token is not None:
                last[i] = token
                break
            i -= 1
        # step(), written out: this is where the time goes
        rank, known, sizes = self.ranks.get, self.borders.get, self.sizes.get
        for j in range(i + 1, n + 1):
            for size in sizes(data[j - 2 : j], (1,)) if j > 1 else (1,):
                a = j - size
                if a < 0:
                    continue
                token = rank(data[a:j])
                if token is None:
                    continue
                if not a:
                    break
                before = last[a]
                if before < 0:
                    before = self.recall(data, last, a)
                stays = known(before << 32 | token)
                if self.border(before, token) if stays is None else stays:
                    break
            else:
                raise ValueError("the ranks have no token for a byte")
            last[j] = token
            memo.keep(data[:j], token)
        return last

    def tokens(self, last: Sequence[int]) -> list[int]:
        out, i, size = [], len(last) - 1, self.bytes
        while i > 0:
            out.append(last[i])
            i -= len(size[last[i]])
        return out[::-1]

    def short_tokens(self, data: bytes) -> list[int]:
        last, out, i, size = self.known_table(data), [], len(data), self.bytes
        while i > 0:
            token = last[i] if last[i] >= 0 else self.recall(data, last, i)
            out.append(token)
            i -= len(size[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        if token is not None:
            return [token]
        return self.short_tokens(data) if len(data) <= SHORT else self.tokens(self.prefix_table(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class Buffer:
    """A byte string that is appended to and edited, with its encoding kept up to date."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last, self.work = bpe, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.edit(len(self.data), 0, more)

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replaces `removed` bytes at `at`; work counts the entries that had to be made."""
        old, tail = self.last, len(self.data) - at - removed
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last, same, self.work = old[: at + 1], 0, 0
        for i in range(at + 1, len(self.data) + 1):
            token = self.bpe.step(self.data, self.last, i)
            self.work += 1
            self.last.append(token)
            was = len(old) - 1 - (len(self.data) - i)
            same = same + 1 if i > at + len(inserted) and len(self.data) - i < tail and old[was] == token else 0
            if same >= self.bpe.longest:
                self.last += old[was + 1 :]
                return

    def ids(self) -> list[int]:
        return self.bpe.tokens(self.last)


class Encoder:
    """Texts to ids, as decimal text with one space between."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.bpe = PrefixBpe(ranks, memo)
        self.pattern = regex.compile(pattern)
        self.memo = Recent(self.piece, memo)
        self.plain = {b"%d" % i: t for i, t in self.bpe.bytes.items()}

    def piece(self, text: str) -> bytes:
        return b" ".join([b"%d" % i for i in self.bpe.encode(text.encode())])

    def encode(self, text: str) -> bytes:
        pieces = self.pattern.findall(text) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text))
        return b" ".join(map(self.memo.__getitem__, pieces))

    def forget(self) -> None:
        """Lets go of what is older; a worker that has done its task may have other work."""
        self.memo.old, self.bpe.prefixes.old = {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.plain.__getitem__, ids.split(b" "))) if ids else b""


@lru_cache(maxsize=1)
def _encoder(data: bytes, pattern: str, memo: int) -> Encoder:
    return Encoder(read_ranks(data), pattern, memo)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", emit_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row; the digests are of the decimal ids joined
    by one space and of the bytes that decoding these ids gives.  memo: pieces and prefixes that a worker remembers."""
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent.value, pattern, memo)
        for x in chunks(batches):
            n, digests, plain, ids = [], [], [], []
            for text in x.column("text").to_pylist():
                own = coder.encode(text or "")
                n.append(own.count(b" ") + 1 if own else 0)
                digests.append(hashlib.sha256(own).hexdigest())
                plain.append(hashlib.sha256(coder.decode(own)).hexdigest())
                if emit_ids:
                    ids.append(np.array(own.split(), np.int32))
            out = [x.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(plain, pa.string())]
            if emit_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)
        coder.forget()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * emit_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * emit_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)

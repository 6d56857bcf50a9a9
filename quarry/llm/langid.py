"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the whole text in lower case from both ends and labels every byte, blanks, digits and punctuation
too, with a probability for each language; its state is carried across words.  A document's probabilities are the mean over
all its bytes.  Long texts are read in windows of WINDOW bytes, cut between characters; in each direction the state is
warmed up on the CONTEXT bytes before a window, whose labels belong to the window beside it.  So each byte is labelled
once, memory is bounded, and windows of many documents run side by side.

It is trained here, in numpy, by backpropagation through time, on a sample that is bounded: of each of the LANGUAGES most frequent languages
some PER_LANGUAGE documents (drawn by a 64-bit hash of the id, so it is the same every time, and each language on its
own, so a rare one is kept beside any number of others), and of each document a stretch of PIECE characters.  Everything else covers all rows.

Only documents with crc32(id as text) mod FOLDS other than HELD_OUT, with a language and an id are learned from.
A null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn from.
A null id is not held out.  Repeated rows stay.  Ties go to the first language by name.  Empty table: empty.  Ids are whole
numbers.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import chunks, col, id_and_text

FOLDS, HELD_OUT = 3, 1
PER_LANGUAGE = 200
PIECE = 4096
LANGUAGES = 512
HIDDEN = 8
#: Steps of training, windows of a step, their bytes.
STEPS, BATCH, STRETCH = 200, 128, 32
WINDOW, CONTEXT = 512, 24
#: Windows that run side by side.
LANES = 4096
UNKNOWN = "und"


def windows(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of a text's windows: what is read, and what of it is labelled.  All cuts are between characters."""
    n = len(text)

    def border(i: int) -> int:
        while 0 < i < n and text[i] & 0xC0 == 0x80:
            i -= 1
        return i

    cuts = [border(i) for i in range(0, n, WINDOW)] + [n]
    return [(border(max(0, a - CONTEXT)), border(min(n, b + CONTEXT)), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """One layer each way.  wx: the gates' input weights of each byte (reset, update, candidate); u: from the state;
    v, c: from both states to the languages."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 7, kind=np.float32):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(kind)
        self.h = hidden
        self.w = {}
        for d in ("f", "b"):
            self.w[f"wx{d}"], self.w[f"u{d}"] = draw(256, 3 * hidden), draw(hidden, 3 * hidden)
        self.w["v"], self.w["c"] = draw(2 * hidden, languages), np.zeros(languages, kind)

    def _run(self, x: np.ndarray, d: str) -> tuple[list, list]:
        """States before and after each step of one direction over words of one length (n, t)."""
        wx, u, k = self.w[f"wx{d}"], self.w[f"u{d}"], self.h
        h = np.zeros((len(x), k), u.dtype)
        states, inner = [h], []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            g, s = wx[x[:, t]], h @ u
            rz = _sigmoid(g[:, : 2 * k] + s[:, : 2 * k])
            r, z = rz[:, :k], rz[:, k:]
            m = s[:, 2 * k :]
            n = np.tanh(g[:, 2 * k :] + r * m)
            h = n + z * (h - n)
            states.append(h)
            inner.append((t, r, z, m, n))
        return states, inner

    def forward(self, x: np.ndarray) -> tuple:
        """Probabilities (t, n, languages) of each place."""
        f, fi = self._run(x, "f")
        b, bi = self._run(x, "b")
        both = np.concatenate([np.stack(f[1:]), np.stack(b[1:][::-1])], axis=2)
        z = both @ self.w["v"] + self.w["c"]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return p, both, f, fi, b, bi

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over places, and its gradients, back through time."""
        p, both, f, fi, b, bi = self.forward(x)
        n, t = x.shape
        loss = -float(np.log(np.maximum(p[:, np.arange(n), y], 1e-12)).mean())
        dz = p.copy()
        dz[:, np.arange(n), y] -= 1
        dz /= n * t
        flat = dz.reshape(n * t, -1)
        out = {"v": both.reshape(n * t, -1).T @ flat, "c": flat.sum(axis=0)}
        up = dz @ self.w["v"].T
        k = self.h
        for d, states, inner, part in (("f", f, fi, up[:, :, :k]), ("b", b, bi, up[:, :, k:])):
            u = self.w[f"u{d}"]
            du, dwx, dh = np.zeros_like(u), np.zeros_like(self.w[f"wx{d}"]), np.zeros_like(states[0])
            for i in range(t - 1, -1, -1):
                at, r, z, m, c = inner[i]
                before = states[i]
                dh = dh + part[at]
                dn = dh * (1 - z) * (1 - c * c)
                gate = np.concatenate([dn * m * r * (1 - r), dh * (before - c) * z * (1 - z), dn * r], axis=1)
                du += before.T @ gate
                dh = dh * z + gate @ u.T
                gate[:, 2 * k :] = dn
                np.add.at(dwx, x[:, at], gate)
            out[f"u{d}"], out[f"wx{d}"] = du, dwx
        return loss, out

    def fit(self, texts: list[bytes], steps: int = STEPS, batch: int = BATCH, stretch: int = STRETCH, seed: int = 7, rate: float = 0.02) -> list[float]:
        """Adam over stretches drawn from the languages' texts (one each, of one byte at least), alike from each language."""
        rng = np.random.default_rng(seed)
        data = [np.frombuffer(t * -(-stretch // len(t)) if len(t) < stretch else t, np.uint8) for t in texts]
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        losses, places = [], np.arange(stretch)
        for step in range(1, steps + 1):
            label = rng.integers(0, len(data), batch)
            start = (rng.random(batch) * np.array([len(data[k]) - stretch + 1 for k in label.tolist()])).astype(np.int64)
            x = np.stack([data[k][a + places] for k, a in zip(label.tolist(), start.tolist(), strict=True)])
            loss, grad = self.gradients(x, label)
            losses.append(loss)
            now = rate * (1 - step / (steps + 1)) + 1e-4
            for k, g in grad.items():
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                self.w[k] -= (now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(self.w[k].dtype)
        return losses

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the sum over its bytes of the languages' probabilities."""
        out = np.zeros((len(texts), len(self.w["c"])))
        cut = [(e - s, f - s, l - s, i, s) for i, t in enumerate(texts) for s, e, f, l in windows(t)]
        cut.sort(key=lambda x: -x[0])  # the longest first: those that a step is for are the first so many
        for some in (cut[i : i + LANES] for i in range(0, len(cut), LANES)):
            size, first, last, of, start = (np.array(c) for c in zip(*some, strict=True))
            x = np.zeros((size[0], len(some)), np.uint8)
            for lane, (n, _, _, i, s) in enumerate(some):
                x[:n, lane] = np.frombuffer(texts[i], np.uint8, n, s)
            np.add.at(out, of, self._lanes(x, size, first, last))
        return out

    def _lanes(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of the probabilities at places first to last of each lane; x (places, lanes), lanes by size, the longest first."""
        k, v, c = self.h, self.w["v"], self.w["c"]
        live = np.searchsorted(-size, -np.arange(len(x)), side="left").tolist()  # lanes longer than each place
        halves = {d: self.halved(d) for d in "fb"}

        def step(d: str, t: int, h: np.ndarray) -> np.ndarray:
            wx, u = halves[d]
            g, s = wx[x[t, : len(h)]], h @ u
            gate = np.tanh(g[:, : 2 * k] + s[:, : 2 * k])
            gate *= 0.5
            gate += 0.5
            n = np.tanh(g[:, 2 * k :] + gate[:, :k] * s[:, 2 * k :])
            h -= n
            h *= gate[:, k:]
            h += n
            return h

        ahead = np.zeros((len(x), x.shape[1], k), v.dtype)
        h = np.zeros((x.shape[1], k), v.dtype)
        for t, n in enumerate(live):
            h = step("f", t, h[:n])
            ahead[t, :n] = h
        h, total = np.zeros((x.shape[1], k), v.dtype), np.zeros((x.shape[1], len(c)), v.dtype)
        for t in range(len(x) - 1, -1, -1):
            n = live[t]
            back = step("b", t, h[:n])  # in place
            z = ahead[t, :n] @ v[:k] + back @ v[k:] + c
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z *= ((first[:n] <= t) & (t < last[:n]))[:, None] / z.sum(axis=1, keepdims=True)
            total[:n] += z
        return total

    def halved(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Weights with the two gates' inputs halved: sigmoid(x) is (1 + tanh(x / 2)) / 2."""
        scale = np.ones(3 * self.h, self.w["v"].dtype)
        scale[: 2 * self.h] = 0.5
        return self.w[f"wx{d}"] * scale, self.w[f"u{d}"] * scale


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], BiGru | None]:
    """The languages in order and the network (None: nothing to learn from)."""
    own = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).cast("string").alias("text"), col(docs, lang_col).cast("string").alias("lang"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    found = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not found:
        return [], None
    # a share of each language's hashes, as signed 64-bit numbers; half as many again, so that there are enough
    upto = {r.lang: -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, 1.5 * per_language / r.n))) for r in found}
    drawn = own.withColumn("drawn", F.xxhash64("doc_id")).where(F.col("drawn") <= F.create_map(*[F.lit(x) for item in upto.items() for x in item])[F.col("lang")])
    begin = 1 + F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - PIECE, F.lit(1)))
    pieces: dict[str, list] = {r.lang: [] for r in found}
    for r in drawn.select("lang", "drawn", F.lower(F.substring("text", begin.cast("int"), F.lit(PIECE))).alias("piece")).collect():
        pieces[r.lang].append((r.drawn, r.piece))
    texts = {lang: "\n".join(p for _, p in sorted(x)[:per_language] if p).encode() for lang, x in pieces.items()}
    languages = sorted(lang for lang, t in texts.items() if t)
    if not languages:
        return [], None
    model = BiGru(len(languages))
    model.fit([texts[lang] for lang in languages])
    return languages, model


def identify(docs: DataFrame, languages: list[str], model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, probabilities) of each row; probabilities in the languages' order."""
    sent = docs.sparkSession.sparkContext.broadcast((languages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, model = sent.value
        for x in chunks(batches):
            texts = x.column("text").to_pylist()
            fine = [model is not None and has_letter(t) for t in texts]
            read = [t.lower().encode() if f else b"" for t, f in zip(texts, fine, strict=True)]
            p = model.sums(read) / np.maximum([[len(t)] for t in read], 1) if model is not None else np.zeros((len(texts), 0))
            best = p.argmax(axis=1).tolist() if p.shape[1] else [0] * len(texts)
            pred = [languages[k] if f else UNKNOWN for k, f in zip(best, fine, strict=True)]
            score = [min(1.0, float(p[i, k])) if f else 0.0 for i, (k, f) in enumerate(zip(best, fine, strict=True))]
            each = [row if f else [] for row, f in zip(p.tolist(), fine, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(each, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "probabilities"])

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, probabilities array<double>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "probabilities")

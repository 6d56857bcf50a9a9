"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces in a text; for each place, dynamic programming carries the best score and the
number of pieces of the best way there, and nothing to trace it back.  Ties go as in the tokenizer: candidates for a place
come in the order of their start, and a later one must be better, not equal; a character that is no piece itself may
stand alone at the least score less PENALTY, and then counts as its UTF-8 bytes.

Spaces become the space mark, and one goes first, as the tokenizer does it.  No piece has a mark after another character
(checked when the vocabulary is read), so runs of marks with their word are counted on their own, exactly; workers remember recent
ones (a bounded memo).  Scores are added up in doubles, so the choice does not hang on a text's length.

Nulls: a null or empty text has no tokens.  Null ids and repeated rows stay.  Empty table: empty.  A long run holds as many places
as the longest piece has characters.  Ids are whole numbers.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import LONG, Recent
from .frames import chunks, id_and_text

MARK = "▁"
PENALTY = 10.0
MEMO = 400_000


def read_unigrams(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in own]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        inner = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        lines = any("\n" in p for p, _ in pieces)
        # runs that no piece reaches across
        self.runs = re.compile(r"(?s).+" if inner else r" *[^ ]+| +" if lines else r"\n| *[^ \n]+| +")
        self.memo = Recent(self.best, MEMO)

    def best(self, run: str) -> int:
        """The number of pieces of the best way through a run; only the places that a piece can reach back to are held."""
        text = run.replace(" ", MARK)
        n, worst, size = len(text), float("-inf"), self.longest + 1
        score, count = [worst] * size, [0] * size
        score[0] = 0.0
        done, fresh = 0, 0  # places up to done are settled, those up to fresh begun

        def alone(upto: int) -> None:
            nonlocal done, fresh
            for e in range(done, upto):
                here, then = e % size, (e + 1) % size
                if e == fresh:
                    score[then], fresh = worst, e + 1
                if text[e] not in self.single and score[here] + self.unknown > score[then]:
                    score[then] = score[here] + self.unknown
                    count[then] = count[here] + len(text[e].encode())
            done = max(done, upto)

        for end, (length, value) in self.machine.iter(text):  # of one end, the longest first
            alone(end)
            start, then = (end + 1 - length) % size, (end + 1) % size
            if end == fresh:
                score[then], fresh = worst, end + 1
            if score[start] + value > score[then]:
                score[then] = score[start] + value
                count[then] = count[start] + 1
        alone(n)
        return count[n % size]

    def count(self, text: str) -> int:
        text = (" " + text).replace(MARK, " ") if text else ""
        runs = self.runs.findall(text) if len(text) < LONG else (m[0] for m in self.runs.finditer(text))
        return sum(map(self.memo.__getitem__, runs))


@lru_cache(maxsize=2)
def _counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(list(pieces))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row.  The vocabulary is one file of fixed size, read by the driver and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(read_unigrams(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for x in chunks(batches):
            n = [counter.count(t or "") for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")

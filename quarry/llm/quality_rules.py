"""Quality rules with DataFrame functions only: counts of a text, and a hashed n-gram likelihood ratio.

Two multinomials over BUCKETS hashed n-grams (words and word pairs, unchanged): one of the trusted target (documents
labelled good), one of the whole corpus.  A document's score is the mean, over its n-grams, of the
logarithm of the ratio of the two probabilities (one added to each count).  The verdict is a fixed threshold: a score
of more than SPREAD standard deviations below the mean of the target's own scores fails.

Scale: counting explodes n-grams and adds them up in each task first, so BUCKETS rows a task are shuffled and BUCKETS
numbers reach the driver.  Scoring is one row at a time, and labels meet scores, not texts.  For the counts, labels are broadcast
if they are at most BROADCAST rows; more of them are joined with the texts once.  No step is more than n log n in a text's words.

Nulls: a null text has no words.  Null and repeated ids stay, each row judged on its own.  Labels may repeat; a null
quality is none.  No trusted document at all: the ratio is one and nothing fails by it.  Empty table: empty.  Ids are whole
numbers.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed, col, id_and_text
from .secret_scan import let

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 8192
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: At 6 a target whose scores are spread wide, as many copies make it, let two fifths of the bad documents through.
SPREAD = 3.0
#: Labelled documents up to so many are broadcast (about 60 bytes each).
BROADCAST = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP, -1), "")


def hashed(a: Column, *more: Column) -> Column:
    return F.pmod(F.xxhash64(a, *more), F.lit(BUCKETS)).cast("int")


def ngrams(w: Column) -> Column:
    """Buckets of all words and pairs; w is bound already."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: hashed(a, b))
    return F.concat(F.transform(w, lambda x: hashed(x)), pairs)


def repeat_words(w: Column) -> Column:
    """Words in windows of three that stand twice or more in the text; w is bound already."""

    def covered(t: Column) -> Column:
        order = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
        places = let(order, lambda s: F.filter(F.transform(s, lambda a, k: F.when((F.get(s, k + 1)["t"] == a["t"]) | (F.get(s, k - 1)["t"] == a["t"]), a["i"])), lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.sort_array(places), start, lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t))))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    own = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(own, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def symbols(text: Column) -> Column:
    n = F.length(text) * len(SYMBOLS)
    for s in SYMBOLS:
        n = n - F.length(F.replace(text, F.lit(s), F.lit("")))
    return n


def target_rows(text: DataFrame, labels: DataFrame | None, label_id: str, label: str) -> DataFrame:
    """text (or what else has a doc_id) with a column target: whether the document is labelled good."""
    if labels is None:
        return text.withColumn("target", F.lit(False))
    good = labels.filter(col(labels, label) == 1).select(col(labels, label_id).cast("long").alias("good_id")).filter("good_id is not null").distinct()
    if good.count() <= BROADCAST:
        good = F.broadcast(good)
    return text.join(good, text["doc_id"] == good["good_id"], "left").withColumn("target", F.col("good_id").isNotNull()).drop("good_id")


def ratios(text: DataFrame) -> list[float]:
    """The logarithm of target to corpus probability of each bucket; text has a column target."""
    grams = text.select("target", F.explode(let(words(F.col("text")), ngrams)).alias("g"))
    counts = {r.g: (r.target, r.corpus) for r in grams.groupBy("g").agg(F.sum(F.col("target").cast("long")).alias("target"), F.count(F.lit(1)).alias("corpus")).collect()}
    target, corpus = (sum(x[k] for x in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * BUCKETS
    base = math.log((corpus + BUCKETS) / (target + BUCKETS))
    return [base + math.log((t + 1) / (c + 1)) for t, c in (counts.get(g, (0, 0)) for g in range(BUCKETS))]


def score(w: Column, ratio: list[float]) -> Column:
    """The mean log ratio of the n-grams; 0 without words.  w is bound already."""
    table = F.array(*[F.lit(x) for x in ratio])
    total = F.aggregate(ngrams(w), F.lit(0.0), lambda a, g: a + table[g])
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(total / (2 * F.size(w) - 1))


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", spread: float = SPREAD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept) of each row."""
    text = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ratio = ratios(target_rows(text, labels, label_id, label))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words"), score(w, ratio).alias("score"))

    t = F.col("text")
    found = text.select("doc_id", symbols(t).cast("long").alias("n_symbols"), dup_lines(t).cast("long").alias("n_dup_lines"), let(words(t), counted).alias("c"))
    own = found.select("doc_id", *[F.col(f"c.{n}").cast("long").alias(n) for n in ("n_words", "word_chars")], "n_symbols", "n_dup_lines", F.col("c.n_repeat_words").cast("long").alias("n_repeat_words"), F.col("c.score").alias("score"))
    own = checkpointed(own.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))))
    # sums of whole numbers, so the threshold doesn't hang on the order of the rows
    whole = F.round(F.col("score") * 1_000_000).cast("long")
    sums = target_rows(own.filter("not base_failed"), labels, label_id, label).filter("target").agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("s"), F.sum((whole * whole).cast("decimal(38,0)")).alias("q")).first()
    if not sums.n:
        return own.withColumn("kept", ~F.col("base_failed"))
    mean = sums.s / sums.n
    deviation = math.sqrt(max(0.0, float(sums.q) / sums.n - mean * mean))
    least = (mean - spread * deviation) / 1_000_000
    return own.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))

"""Secret scans with DataFrame functions only.

Base kinds are patterns: assign (a keyword, then : or =, then a value), access (a key id), hex (a long run).  Places
come from the text between the matches: the k-th match starts after the first k gaps and k matches before it.

The method adds kind entropy: in each candidate (a run of characters of keys) a window slides over the characters with
their counts kept up to date: one count rises, one falls, and so does the sum of n log2 n, from which the
window's Shannon entropy follows.  A window counts if its entropy exceeds the threshold of its
character class: hex digits only, letters and digits, or any.  Windows that count and touch are one span.
Candidates on the allow list, and spans that a base span covers, are left out.

Scale: no shuffle, one row at a time; rows that hold nothing cost a scan for each kind's hint.  All folds
are linear in the text (running sums and what grows go by blocks), so long texts and many secrets are no problem.

Nulls: a null text is empty.  Null ids and repeated rows stay.  Empty table: empty.  Ids are whole numbers.  find_secrets reads
only the id and the text; redact keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import col, fresh, id_and_text, spread

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: What the first pattern may step over when a short value comes before.
ASSIGN_ANYWHERE = ASSIGN.replace("]+)", "]{%d,})" % ASSIGN_VALUE)
# a shorter run fails as a whole, so the least lengths can stand in the patterns
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidates, the window, and the entropy (bits a character) that a window of each class must exceed.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WIDTH = 20
LEAST = {"hex": 2.95, "alnum": 3.75, "any": 3.85}
#: Candidates that match are no secrets: without a digit or without a letter, UUIDs, placeholders, counting.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"0123456789|1234567890|(?i:abcdefgh)",
)
MASK = "[SECRET]"
_BLOCK = 256
_TEXT_BLOCK = 1024
_ARRAY = "array<struct<start: int, kind: int, end: int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """0 and the running sums (or what else join makes)."""
    return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))


def running(values: Column, join: Callable[[Column, Column], Column] = _plus) -> Column:
    """The sum of all values before each; values is bound already.  By blocks, so the copies stay small."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda j: _scan(F.slice(values, j * _BLOCK + 1, _BLOCK), join))
    shifted = let(blocks, lambda b: F.zip_with(b, _scan(F.transform(b, lambda x: F.element_at(x, -1)), join), lambda x, o: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: join(v, o))))
    return F.flatten(F.filter(shifted, lambda x: x.isNotNull()))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (start, end, size) of each match, in code points; size is the group's.  The text has a match."""
    found = F.struct(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("m"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)).alias("v"),
        F.transform(F.split(text, pattern, -1), lambda m: F.length(m)).alias("g"),
    )
    return let(
        found,
        lambda x: let(
            F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: m + g),
            lambda step: F.zip_with(
                F.zip_with(running(step), x["g"], lambda at, g: at + g),
                F.arrays_zip(x["m"], x["v"]),
                lambda at, s: F.struct(at.alias("start"), (at + s["m"]).alias("end"), s["v"].alias("size")),
            ),
        ),
    )


def _kind(kind: str, found: Column) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def _none() -> Column:
    return F.array().cast(_ARRAY)


def base_spans(text: Column) -> Column:
    """The base kinds' spans, unsorted."""
    assign = F.when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), _kind("assign", F.filter(_complete(matches(text, ASSIGN, 1)), lambda x: x["size"] >= ASSIGN_VALUE)))
    access = F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), _kind("access", _complete(matches(text, ACCESS))))
    hexes = F.when(text.rlike(HEX), _kind("hex", _complete(matches(text, HEX))))
    return F.concat(*[F.coalesce(x, _none()) for x in (assign, access, hexes)])


def _complete(found: Column) -> Column:
    """Without what zip_with fills up where the gaps outnumber the matches."""
    return F.filter(found, lambda x: x["start"].isNotNull() & x["size"].isNotNull())


def high_entropy(candidate: Column, width: int = WIDTH) -> Column:
    """array of (start, end) within a candidate (one byte a character, `width` long at least)."""
    top = {k: width * (math.log2(width) - v) for k, v in LEAST.items()}  # the sum of n log2 n must stay below
    nothing = F.array().cast("array<struct<start: int, end: int>>")
    nlog = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])

    def prepared(s: Column) -> Column:
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        return let(F.struct(chars.alias("c"), F.array_distinct(chars).alias("keys")), lambda x: F.struct(
            F.transform(x["c"], lambda c: (F.array_position(x["keys"], c) - 1).cast("int")).alias("p"),
            F.transform(x["c"], lambda c: c.rlike("[0-9a-fA-F]").cast("int")).alias("hex"),
            F.transform(x["c"], lambda c: c.rlike("[0-9A-Za-z]").cast("int")).alias("alnum"),
            F.transform(x["keys"], lambda c: F.lit(0)).alias("zero"),
            nlog.alias("f"),
        ))

    def fold(x: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            full = i >= width
            new, old = x["p"][i], F.when(full, x["p"][i - width]).otherwise(F.lit(-1))

            def moved(n: Column) -> Column:
                up = x["f"][a["n"][new] + 1] - x["f"][a["n"][new]]
                down = F.when(full, x["f"][a["n"][old] - 1] - x["f"][a["n"][old]]).otherwise(F.lit(0.0))
                s = a["s"] + F.when(new == old, F.lit(0.0)).otherwise(up + down)
                hexes = a["hex"] + x["hex"][i] - F.when(full, x["hex"][i - width]).otherwise(F.lit(0))
                alnum = a["alnum"] + x["alnum"][i] - F.when(full, x["alnum"][i - width]).otherwise(F.lit(0))
                return F.struct(n.alias("n"), s.alias("s"), hexes.alias("hex"), alnum.alias("alnum"))

            counts = F.transform(a["n"], lambda n, j: n + (j == new).cast("int") - (j == old).cast("int"))

            def judged(b: Column) -> Column:
                most = F.when(b["hex"] == width, F.lit(top["hex"])).when(b["alnum"] == width, F.lit(top["alnum"])).otherwise(F.lit(top["any"]))
                good = (i >= width - 1) & (b["s"] < most)
                first = i - (width - 1)
                more = good & (a["end"] >= first)
                return F.struct(
                    b["n"].alias("n"), b["s"].alias("s"), b["hex"].alias("hex"), b["alnum"].alias("alnum"),
                    F.when(more, a["start"]).when(good, first).otherwise(a["start"]).alias("start"),
                    F.when(good, i + 1).otherwise(a["end"]).alias("end"),
                    F.when(good & ~more & (a["end"] >= 0), F.concat(F.when(F.size(a["out"]) < _BLOCK, a["out"]).otherwise(nothing), F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["out"]).alias("out"),
                    F.when(good & ~more & (a["end"] >= 0) & (F.size(a["out"]) >= _BLOCK), F.concat(a["full"], F.array(a["out"]))).otherwise(a["full"]).alias("full"),
                )

            return let(moved(counts), judged)

        start = F.struct(x["zero"].alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("hex"), F.lit(0).alias("alnum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), nothing.alias("out"), F.array().cast("array<array<struct<start: int, end: int>>>").alias("full"))
        last = lambda a: F.when(a["end"] >= 0, F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(nothing)
        end = lambda a: F.concat(F.flatten(a["full"]), a["out"], last(a))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["p"]) - 1), start, step, end)

    return let(prepared(candidate), fold)


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Kind entropy's spans, before those that a base span covers are left out."""

    def found(x: Column) -> Column:
        listed = F.lit(False)
        for pattern in allow:
            listed = listed | x["s"].rlike(pattern)
        own = F.when(listed, _none()).otherwise(F.transform(high_entropy(x["s"]), lambda e: F.struct((x["start"] + e["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (x["start"] + e["end"]).alias("end"))))
        return own

    both = F.zip_with(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), _complete(matches(text, CANDIDATE)), lambda s, m: F.struct(s.alias("s"), m["start"].alias("start")))
    return F.coalesce(F.when(text.rlike(CANDIDATE), F.flatten(F.transform(both, found))), _none())


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, text, base, spans) of each row; base and spans: arrays of (start, kind, end), in order, kind a place
    in KINDS, code points, end exclusive; spans holds base."""
    own = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return own.withColumns(_columns(F.col("text"), allow)).select("doc_id", "text", "base", "spans")


def _columns(text: Column, allow: tuple[str, ...]) -> dict[str, Column]:
    def joined(x: Column) -> Column:
        more = F.filter(x["more"], lambda m: ~F.exists(x["base"], lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
        return F.struct(x["base"].alias("base"), F.array_sort(F.concat(x["base"], more)).alias("spans"))

    both = let(F.struct(F.array_sort(base_spans(text)).alias("base"), entropy_spans(text, allow).alias("more")), joined)
    return {"base": both["base"], "spans": both["spans"]}


def named(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the mask in place of each stretch of spans (one at least, in order).  The text is cut into blocks first,
    so that a piece of it costs no more than its size and a block."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _TEXT_BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / _TEXT_BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(some, a - first * _TEXT_BLOCK + 1, b - a)).otherwise(F.lit(""))

    def cut(x: Column) -> Column:
        # a span that begins inside those before only makes their stretch longer
        pieces = F.zip_with(x["spans"], x["upto"], lambda s, at: F.when(s["start"] >= at, F.concat(piece(x["blocks"], at, s["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), piece(x["blocks"], F.greatest(F.element_at(x["upto"], -1), F.element_at(x["spans"], -1)["end"]), x["n"]))

    ends = let(F.transform(spans, lambda s: s["end"]), lambda e: running(e, F.greatest))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _TEXT_BLOCK), F.lit(0))
    return let(F.struct(spans.alias("spans"), ends.alias("upto"), blocks.alias("blocks"), F.length(text).alias("n")), cut)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = MASK, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with each stretch of secrets in the text replaced by the mask; length_col, if docs has it, is renewed
    where a text changed.  Null texts stay null."""
    docs = spread(docs)
    text, tmp = col(docs, text_col), fresh(docs, "secrets")
    found = docs.withColumn(tmp, _columns(F.coalesce(text.cast("string"), F.lit("")), allow)["spans"])
    text, spans = col(found, text_col), F.col(tmp)
    clean = F.when(F.size(spans) > 0, _masked(text, spans, mask)).otherwise(text)
    clean = F.regexp_replace(clean, ASSIGN_ANYWHERE, mask)
    new = fresh(found, "clean")
    out = found.withColumn(new, clean)
    # a long value behind a short one has no span of its own
    changed = (F.size(spans) > 0) | ~F.col(new).eqNullSafe(text)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            columns.append(F.when(changed, F.length(F.col(new)).cast(kind)).otherwise(col(out, c)).alias(c))
        else:
            columns.append(col(out, c).alias(c))
    return out.select(*columns)

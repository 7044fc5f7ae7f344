"""Secret scans: patterns and sliding-window entropy (native DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.llm.util import pick

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")

#: kind -> candidate characters, bits a character that a window must reach.
CLASSES = {"entropy_hex": ("0-9A-Fa-f", 2.8), "entropy_base64": ("A-Za-z0-9+/_=-", 3.8)}
#: Dates are cut out of candidates.
DATE = r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"
#: Candidates that are no secrets: UUIDs, version-like numbers, and whatever has no digit or no letter.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]{1,4}$",
)
NONE = "array<struct<start:bigint,rank:int,end:bigint>>"
BLOCKS = f"array<struct<start:bigint,end:bigint,spans:{NONE}>>"


def occurrences(text: Column, pattern: str, each: Callable[[Column, Column], Column]) -> Column:
    """Leftmost non-overlapping matches as ``each(start, match)``, an array a match, all joined.

    Java gives no positions, but the parts between matches and the matches themselves do:
    their lengths add up to each match's code point offset.
    """
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(parts.alias("part"), hits.alias("hit"))
    empty = F.array().cast(NONE)

    def step(acc: Column, x: Column) -> Column:
        start, hit = acc["at"] + F.length(x["part"]), F.coalesce(x["hit"], F.lit(""))
        return F.struct(
            (start + F.length(hit)).alias("at"), F.when(hit != "", F.concat(acc["found"], each(start, hit))).otherwise(acc["found"]).alias("found")
        )

    folded = F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def span(start: Column, rank: int, length: Column) -> Column:
    return F.array(F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), (start + length).cast("bigint").alias("end")))


def in_blocks(spans: Column, size: int = 128) -> Column:
    """Spans, ordered by start, in blocks with the first start and the last end of each, so that those at a place are found without a look at all."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int")), lambda i: F.slice(spans, i * size + 1, size))
    told = F.transform(blocks, lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans")))
    return F.when(F.size(spans) > 0, told).otherwise(F.array().cast(BLOCKS))


def overlapping(blocks: Column, start: Column, end: Column) -> Column:
    meets = lambda c: (c["start"] < end) & (start < c["end"])
    return F.flatten(F.transform(F.filter(blocks, meets), lambda b: F.filter(b["spans"], meets)))


def remaining(start: Column, end: Column, inside: Column) -> Column:
    """The spans that the spans ``inside``, ordered by start, leave of the one from ``start`` to ``end``."""

    def step(acc: Column, c: Column) -> Column:
        left = F.when(acc["at"] < c["start"], F.concat(acc["found"], span(acc["at"], 0, c["start"] - acc["at"]))).otherwise(acc["found"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), left.alias("found"))

    state = F.struct(start.cast("bigint").alias("at"), F.array().cast(NONE).alias("found"))
    return F.aggregate(inside, state, step, lambda acc: F.when(acc["at"] < end, F.concat(acc["found"], span(acc["at"], 0, end - acc["at"]))).otherwise(acc["found"]))


def entropy_span(hit: Column, width: int, least: float) -> Column:
    """``from`` of the first and ``to`` of the last window of ``width`` characters with ``least`` bits a character or more; ``to`` 0 if none.

    With counts c in a window of w characters the entropy is log2(w) - sum(c log2 c) / w. The window moves by one character:
    one count grows and one shrinks, and the sum changes by those two terms. Only these two counts are taken, of the window at hand.
    """
    chars = F.transform(F.split(hit, ""), lambda c: F.ascii(c))
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    most = width * (math.log2(width) - least)

    def times(window: Column, x: Column) -> Column:
        return F.size(F.filter(window, lambda c: c == x))

    def window(x: Column, i: Column) -> Column:
        """The character, the one that leaves (-1 while the window fills) and the window that they are added to and taken from."""
        before = F.when(i > 0, F.slice(chars, F.greatest(i - width + 1, F.lit(1)), F.least(i, F.lit(width)))).otherwise(F.array().cast("array<int>"))
        return F.struct(x.alias("new"), F.when(i >= width, F.element_at(chars, F.greatest(i - width, F.lit(0)) + 1)).otherwise(-1).alias("old"), before.alias("window"))

    def change(m: Column) -> Column:
        left = F.when(m["old"] >= 0, F.get(term, m["leaves"] - 1) - F.get(term, m["leaves"])).otherwise(F.lit(0.0))
        return F.when(m["new"] == m["old"], F.lit(0.0)).otherwise(F.get(term, m["comes"] + 1) - F.get(term, m["comes"]) + left)

    moves = F.transform(chars, window)
    moves = F.transform(moves, lambda m: F.struct(m["new"].alias("new"), m["old"].alias("old"), times(m["window"], m["new"]).alias("comes"), times(m["window"], m["old"]).alias("leaves")))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("at"))

    def step(acc: Column, delta: Column) -> Column:
        total = acc["sum"] + delta
        full = (acc["at"] + 1 >= width) & (total <= most + 1e-9)
        return F.struct(
            total.alias("sum"), F.when(full & (acc["from"] < 0), acc["at"] + 1 - width).otherwise(acc["from"]).alias("from"),
            F.when(full, acc["at"] + 1).otherwise(acc["to"]).alias("to"), (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(F.transform(moves, change), state, step, lambda acc: F.struct(acc["from"].alias("from"), acc["to"].alias("to")))


def scan_secrets(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Find secrets in whole texts.

    Base spans come from three patterns (assignments, access keys, lower-case hexadecimal runs). The
    method adds spans: in runs of each character class of at least ``width`` characters, windows of
    ``width`` characters slide by one; from the first window whose Shannon entropy reaches the class's
    bits to the last is a span, unless the run is on the allow-list. Base spans and dates are cut out of
    a run, and each part left is a candidate by itself, allow-list (separators at its ends aside) and all.
    A hexadecimal run is one number, so that its windows run over base spans and what those leave
    of its span is found, however short.

    Returns ``doc_id``, the columns ``keep`` and ``spans``: an array of (start, kind, end) ordered by start and then by kind as listed,
    in code points, end exclusive.

    Nulls: a null text is empty; a document without spans has an empty array. Repeated rows
    are scanned alike. An empty table gives an empty result; further columns are ignored.
    """
    kinds = (*BASE_KINDS, *CLASSES)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = pick(docs, **{c: c for c in keep}, doc_id=id_col, text=text_col).withColumn("text", text)
    found = found.withColumns({
        "assign": occurrences(F.col("text"), ASSIGN, lambda at, hit: F.when(F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 12, span(at, 0, F.length(hit))).otherwise(F.array().cast(NONE))),
        "access": occurrences(F.col("text"), ACCESS, lambda at, hit: span(at, 1, F.length(hit))),
        "hex": occurrences(F.col("text"), HEX, lambda at, hit: span(at, 2, F.length(hit))),
    })
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    found = found.withColumn("blocks", in_blocks(F.col("base")))

    allowed = "|".join(ALLOW)

    def hot(at: Column, text: Column, rank: int, least: float) -> Column:
        part = F.transform(F.array(entropy_span(text, width, least)), lambda w: F.struct((at + w["from"]).alias("start"), F.lit(rank).alias("rank"), (at + w["to"]).alias("end")))
        return F.filter(part, lambda w: w["end"] > at).cast(NONE)

    def number(rank: int, least: float) -> Callable[[Column, Column], Column]:
        def each(at: Column, hit: Column) -> Column:
            left = F.flatten(F.transform(hot(at, hit, rank, least), lambda w: remaining(w["start"], w["end"], overlapping(F.col("blocks"), w["start"], w["end"]))))
            ranked = F.transform(left, lambda w: F.struct(w["start"].alias("start"), F.lit(rank).alias("rank"), w["end"].alias("end")))
            return F.when(hit.rlike(allowed), F.array().cast(NONE)).otherwise(ranked.cast(NONE))

        return each

    def parts(rank: int, least: float) -> Callable[[Column, Column], Column]:
        def each(at: Column, hit: Column) -> Column:
            dates = occurrences(hit, DATE, lambda start, date: span(at + start, 0, F.length(date)))
            end = at + F.length(hit)
            left = remaining(at, end, F.array_sort(F.concat(overlapping(F.col("blocks"), at, end), dates)))
            left = F.filter(left, lambda p: p["end"] - p["start"] >= width)

            def spans(p: Column) -> Column:
                size = (p["end"] - p["start"]).cast("int")
                part = F.substring(hit, (p["start"] - at).cast("int") + 1, size)
                bare = F.when(size < F.length(hit), F.regexp_replace(part, "^[+/_=-]+|[+/_=-]+$", "")).otherwise(part)
                return F.when(bare.rlike(allowed), F.array().cast(NONE)).otherwise(hot(p["start"], part, rank, least))

            return F.flatten(F.transform(left, spans))

        return each

    for i, (kind, (chars, least)) in enumerate(CLASSES.items()):
        each = number if kind == "entropy_hex" else parts
        found = found.withColumn(kind, occurrences(F.col("text"), f"[{chars}]{{{width},}}", each(len(BASE_KINDS) + i, least)))
    spans = F.array_sort(F.concat("base", *CLASSES))
    names = F.array(*[F.lit(k) for k in kinds])
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["rank"]).alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", *keep, spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as a string."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with each secret replaced by ``mark``; all columns stay.

    Spans that overlap are replaced as one. Texts without secrets stay as they are, null texts too;
    ``chars_col``, if there, becomes the new length where a text has changed.
    """
    columns = docs.columns
    whole = docs.select(F.lit(0).alias("doc_id"), docs[text_col].alias("text"), F.struct("*").alias("whole"))
    found = scan_secrets(whole, keep=("whole",)).withColumnRenamed("whole", "row")
    text = F.col("row")[text_col]

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    hit = F.size("spans") > 0
    out = {c: F.col("row")[c] for c in columns}
    found = found.withColumn("clean", F.when(hit, clean).otherwise(text))
    out[text_col] = F.col("clean")
    if chars_col in columns:
        out[chars_col] = F.when(hit, F.length("clean").cast(docs.schema[chars_col].dataType)).otherwise(out[chars_col])
    return found.select(*[v.alias(k) for k, v in out.items()])

"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsim.llm.util import pick

UNKNOWN = "und"
CHUNK = 1 << 18  # bytes worked on at a time
UNIT = 1 << 16  # code lengths are whole numbers of 1/UNIT bits, so that sums don't depend on their order
ORDER_SHIFT = np.uint64(56)
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def pieces(coded: list[bytes], order: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Blocks of about CHUNK bytes of (text's number, piece, bytes in front that are only context); long texts are cut."""
    block, size = [], 0
    for i, raw in enumerate(coded):
        for start in range(0, len(raw), CHUNK):
            lead = min(order, start)
            piece = raw[start - lead : start + CHUNK]
            block.append((i, piece, lead))
            size += len(piece)
            if size >= CHUNK:
                yield block
                block, size = [], 0
    if block:
        yield block


class Positions:
    """The bytes to code of a block: the window of the ``order`` bytes before each and itself as one number, and how long its context can be."""

    def __init__(self, block: list[tuple[int, bytes, int]], order: int):
        size = np.fromiter((len(p) for _, p, _ in block), np.int64, len(block))
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(p for _, p, _ in block), np.uint8).astype(np.uint64)
        offset = np.arange(len(raw)) - np.repeat(start, size)
        window = raw.copy()
        for back in range(1, order + 1):
            window[back:] |= raw[:-back] << np.uint64(8 * back)
        lead = np.repeat(np.fromiter((x for _, _, x in block), np.int64, len(block)), size)
        coded = offset >= lead
        self.window, self.order = window[coded], np.minimum(offset, order)[coded]
        own = size - np.fromiter((x for _, _, x in block), np.int64, len(block))
        self.start = np.cumsum(own) - own  # of each piece's coded bytes; no piece is without any
        self.text = [i for i, _, _ in block]


def keys(window: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for the byte and the ``order`` bytes before it."""
    bits = ((order + 1) * 8).astype(np.uint64)
    return (window & ((np.uint64(1) << bits) - np.uint64(1))) | ((order + 1).astype(np.uint64) << ORDER_SHIFT)


def context_of(key: np.ndarray) -> np.ndarray:
    """The context (its own key one order down) of an n-gram's key."""
    order = (key >> ORDER_SHIFT) - np.uint64(1)
    return ((key & ((np.uint64(1) << ORDER_SHIFT) - np.uint64(1))) >> np.uint64(8)) | (order << ORDER_SHIFT)


def shorter(key: np.ndarray) -> np.ndarray:
    """The n-gram without its first byte."""
    order = (key >> ORDER_SHIFT) - np.uint64(1)  # as many bytes are left
    return (key & ((np.uint64(1) << (order * np.uint64(8))) - np.uint64(1))) | (order << ORDER_SHIFT)


class Table:
    """Places of numbers (none of them 0) in an open-addressing table."""

    def __init__(self, numbers: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(numbers)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.place = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(numbers)), self._home(numbers)
        while len(left):
            free = self.slots[at] == 0
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[slot], self.place[slot] = numbers[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _home(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that aren't there."""
        at = self._home(asked)
        held = self.slots[at]
        found = np.where(held == asked, self.place[at], -1)
        open_ = np.flatnonzero((held != asked) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.slots[at[open_]]
            hit = held == asked[open_]
            found[open_[hit]] = self.place[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return found


@dataclass
class Model:
    """Context trees of all languages. ``cost``: code length of each n-gram's last byte after the bytes before it, escapes and all, for every
    n-gram that any language has seen; ``escape``: of leaving each context. Both a column a language, in 1/UNIT bits."""

    languages: list[str]
    order: int
    grams: Table
    cost: np.ndarray
    contexts: Table
    escape: np.ndarray

    @classmethod
    def of(cls, counts: pa.Table, order: int) -> "Model":
        """From ``lang, gram, n``. Method C: a context seen t times with q kinds of symbol gives n / (t + q) to a symbol and q / (t + q) to the escape."""
        coded = counts["lang"].combine_chunks().dictionary_encode()  # no Python string a row
        met = coded.dictionary.to_pylist()
        languages = sorted(met, key=lambda x: x.encode())
        column = np.array([languages.index(x) for x in met], np.int64)[coded.indices.to_numpy()]
        grams, row = np.unique(counts["gram"].to_numpy().astype(np.uint64), return_inverse=True)  # sorted by order first
        n = np.zeros((len(grams), len(languages)))
        np.add.at(n, (row, column), counts["n"].to_numpy())
        contexts, parent = np.unique(context_of(grams), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, parent, n)
        np.add.at(kinds, parent, (n > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(n > 0, np.log2((total + kinds)[parent] / n), 0.0)
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
        bits, escape = np.rint(bits * UNIT).astype(np.int32), np.rint(escape * UNIT).astype(np.int32)
        cost, lengths = np.zeros_like(bits), (grams >> ORDER_SHIFT).astype(np.int64)
        for length in range(1, order + 2):
            own = np.flatnonzero(lengths == length)
            below = 8 * UNIT if length == 1 else cost[np.searchsorted(grams, shorter(grams[own]))]
            cost[own] = np.where(n[own] > 0, bits[own], escape[parent[own]] + below)
        # the empty context's number is 0, which no slot may hold
        return cls(languages, order, Table(grams), cost, Table(contexts + np.uint64(1)), escape)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths of whole texts in 1/UNIT bits, a column a language."""
        coded = [x.encode("utf-8", "surrogatepass") for x in texts]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for block in pieces(coded, self.order):
            at = Positions(block, self.order)
            order, left = at.order, np.arange(len(at.order))
            cost = np.zeros((len(left), len(self.languages)), np.int32)
            while len(left):
                key = keys(at.window[left], order)
                place = self.grams.find(key)
                hit = place >= 0
                if len(left) == len(cost):
                    cost[hit] = self.cost[place[hit]]
                else:
                    cost[left[hit]] += self.cost[place[hit]]
                left, key, order = left[~hit], key[~hit], order[~hit]
                escape = self.contexts.find(context_of(key) + np.uint64(1))
                known = escape >= 0
                cost[left[known]] += self.escape[escape[known]]
                cost[left[order == 0]] += 8 * UNIT  # no context has seen the byte: all 256 are alike
                left, order = left[order > 0], order[order > 0] - 1
            np.add.at(out, at.text, np.add.reduceat(cost, at.start, axis=0, dtype=np.int64))
        return out


def verdict(model: Model, bits: np.ndarray) -> tuple[str, float]:
    """The language of the shortest code and its share of 2^-bits over the languages; ties to the first."""
    best = int(bits.argmin())
    return model.languages[best], float(1 / np.exp2(np.maximum((bits[best] - bits) / UNIT, -1000.0)).sum())


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def sample_of(known: DataFrame, sample_bytes: int, most_cells: int, order: int) -> DataFrame | None:
    """``lang, text``: distinct whole texts of each language in the order of a hash, about ``sample_bytes`` of them and one at least.

    With many languages it is fewer bytes, so that n-grams times languages are at most ``most_cells``. Sums of bytes by language and step of the hash (256 a
    language) tell where to stop; repeated texts count once.
    """
    hashed = known.select("lang", "text", F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(1 << 30)).alias("mark"))
    once = hashed.groupBy("lang", "mark").agg(F.max(F.octet_length("text")).alias("bytes"))
    step = F.floor(F.log2((F.col("mark") + 1).cast("double")) * 256 / 30)  # finer where few texts are
    sums = once.groupBy("lang", step.alias("step")).agg(F.sum("bytes").alias("bytes"), F.min("mark").alias("least"), F.max("mark").alias("most")).toPandas()
    if not len(sums):
        return None
    bound = min(sample_bytes, most_cells // ((order + 1) * sums["lang"].nunique() ** 2))
    picked = F.lit(-1).cast("long")
    for lang, own in sums.sort_values("step").groupby("lang"):
        inside = own[own["bytes"].cumsum() <= bound]
        picked = F.when(F.col("lang") == lang, int(inside["most"].max() if len(inside) else own["least"].iloc[0])).otherwise(picked)
    return hashed.filter(F.col("mark") <= picked).select("lang", "text").dropDuplicates()


def fit(docs: DataFrame, order: int, sample_bytes: int, most_cells: int = 200_000_000) -> Model | None:
    """Learn from ``doc_id, text, lang``, on a sample of whole texts; n-grams of the sample are gathered on the driver."""
    known = docs.filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 2))
    sample = sample_of(known, sample_bytes, most_cells, order)
    if sample is None:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                for block in pieces([x.encode("utf-8", "surrogatepass") for x in own["text"]], order):
                    at = Positions(block, order)
                    for o in range(order + 1):
                        has = at.order >= o
                        gram, n = np.unique(keys(at.window[has], np.full(has.sum(), o)), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    grams = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = grams.toArrow()  # n-grams of the bounded sample; as columns, for rows of Python objects take many times their memory
    return Model.of(counts, order) if len(counts) else None


def identify(docs: DataFrame, order: int = 4, sample_bytes: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of each document's whole text.

    For each language a tree of contexts of up to ``order`` bytes is counted on documents with a language whose crc32(doc_id) mod 4 is not
    2: on distinct whole texts, about ``sample_bytes`` a language (a bound of the fit alone; less with many languages, but one text at
    least). With the counts frozen, a text's code length under a language is the sum over all its bytes (case, blanks and all; contexts run
    across words) of the bits of the longest context that has seen the byte and of the escapes of the longer ones that have not. The
    shortest code wins, ties go by code point; the score is its share of 2^-bits over the languages. Texts are coded in chunks, however long.

    Returns ``doc_id, held_out, lang_pred, score``.

    Nulls: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was learned. A null id is neither held out nor
    learned from. Repeated rows are judged alike. An empty table gives an empty result; further columns are ignored.
    """
    if not 0 <= order <= 5:
        raise ValueError("order must be in 0..5")
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(docs, order, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            judged = [i for i, x in enumerate(texts) if model and x and has_letter(x)]
            for at in range(0, len(judged), 500):
                some = judged[at : at + 500]
                for i, bits in zip(some, model.bits([texts[i] for i in some])):
                    named[i], scores[i] = verdict(model, bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    judged = docs.select("doc_id", "text").mapInArrow(run, schema)
    return judged.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Quality classifier: a weak-label model of heuristic labellers and a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsim.llm.util import pick
from procsim.llm.words import Vocabulary
from procsim.storage import staged

#: Labellers: a measure, good up to and bad from (or the other way round); between them, or where the measure is NaN, they abstain.
LABELLERS = {
    "symbols": (0.07, 0.12),  # of visible characters, those neither letter nor digit
    "marked_words": (0.04, 0.20),  # words that end in a run of one symbol
    "stutter": (0.05, 0.20),  # words that repeat the one before
    "monotony": (0.45, 0.65),  # one less the share of distinct words in stretches of 100, the last of them counted from the end
    "separators": (0.03, 0.15),  # words without letter or digit
    "long_words": (0.80, 0.95),  # words of over three letters among words of letters
    "repeated_lines": (0.25, 0.60),  # lines seen before in the text
    "digits": (0.10, 0.35),  # of visible characters
}
BUCKETS = 24  # of measures from 0 to 1


def shape_of(word: str) -> str:
    """Letters to a (a capital first: A), digits to 0, runs of one kind to two at most."""
    kinds = ["a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    if word[:1].isupper():
        kinds[0] = "A"
    return re.sub(r"(.)\1+", r"\1\1", "".join(kinds), flags=re.S)


def bucket_of(name: str, dimensions: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % dimensions


class Measures:
    """Measures of whole texts and their hashed features."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.vocabulary = Vocabulary(self._learn)
        self.shapes: dict[str, int] = {}
        self.names = [[bucket_of(f"{m}:{b}", dimensions) for b in range(BUCKETS + 2)] for m in LABELLERS]

    def _learn(self, words: list[str]) -> np.ndarray:
        """Shape's bucket; characters, symbols and digits in the word; whether marked, a separator, of letters, of over three letters."""
        rows = np.zeros((len(words), 8), np.int32)
        for i, w in enumerate(words):
            if w.isalpha():
                shape = "A" if w[0].isupper() else "a"
                shape += "a" if len(w) > 1 else ""
                rows[i, 1], rows[i, 6], rows[i, 7] = len(w), 1, len(w) > 3
            else:
                shape, alnum, digits = shape_of(w), sum(map(str.isalnum, w)), sum(map(str.isdigit, w))
                bare = w.strip(".,;:!?\"'()")
                rows[i, 1:6] = len(w), len(w) - alnum, digits, len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum(), alnum == 0
                rows[i, 6], rows[i, 7] = bare.isalpha(), bare.isalpha() and len(bare) > 3
            if shape not in self.shapes:
                if len(self.shapes) > 100_000:
                    self.shapes = {}
                bucket = bucket_of(f"shape:{shape}", self.dimensions)
                if len(shape) <= 64:  # long ones hardly come again
                    self.shapes[shape] = bucket
            rows[i, 0] = self.shapes[shape] if len(shape) <= 64 else bucket
        return rows

    def measure(self, texts: list[str], featured: list[bool] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: the measures (NaN where there is too little), and places and values of its features (none where ``featured`` is false)."""
        words = [x.split() for x in texts]
        for i, (text, places) in enumerate(zip(texts, self.vocabulary.look_up(words))):
            n = len(places)
            got = np.full(len(LABELLERS), np.nan)
            if n:
                rows = self.vocabulary.table[places]
                sums = rows[:, 1:].sum(axis=0, dtype=np.int64)
                got[0], got[7] = sums[1] / sums[0], sums[2] / sums[0]
                got[1], got[4] = sums[3] / n, sums[4] / n
                if n >= 8:
                    got[2] = (places[1:] == places[:-1]).mean()
                if n >= 50:
                    full = places[: n - n % 100].reshape(-1, 100) if n >= 100 else places[None, :]
                    full = np.sort(np.vstack([full, places[-100:]]) if n > 100 and n % 100 else full, axis=1)
                    got[3] = 1 - ((np.diff(full, axis=1) != 0).sum() + len(full)) / full.size
                if sums[5] >= 10:
                    got[5] = sums[6] / sums[5]
                lines = [x for x in text.split("\n") if x.strip()]
                if len(lines) >= 4:
                    got[6] = 1 - len(set(lines)) / len(lines)
            if featured is not None and not featured[i]:
                yield got, np.empty(0, np.int32), np.empty(0)
                continue
            if n:
                shape, times = np.unique(rows[:, 0], return_counts=True)
                values = np.sqrt(times / n)
            else:
                shape, values = np.empty(0, np.int32), np.empty(0)
            bucket = np.where(np.isnan(got), BUCKETS + 1, np.minimum(np.nan_to_num(got) * BUCKETS, BUCKETS)).astype(int)
            named = np.array([self.names[m][b] for m, b in enumerate(bucket)])
            yield got, np.r_[shape, named], np.r_[values, np.ones(len(named))]


def votes_of(measures: np.ndarray) -> int:
    """The labellers' votes as digits to base 3: 0 abstains, 1 good, 2 bad."""
    pattern = 0
    for value, (good, bad) in zip(measures, LABELLERS.values()):
        pattern = 3 * pattern + (0 if np.isnan(value) else 1 if value <= good else 2 if value >= bad else 0)
    return pattern


@dataclass
class LabelModel:
    """P(vote | class) of each labeller and P(bad), by expectation-maximisation over counted vote patterns."""

    prior: float
    votes: np.ndarray  # labeller, class (good, bad), vote

    @staticmethod
    def digits(patterns: np.ndarray) -> np.ndarray:
        m = len(LABELLERS)
        return np.stack([patterns // 3 ** (m - 1 - i) % 3 for i in range(m)], axis=1)

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> "LabelModel":
        said, m = cls.digits(patterns), len(LABELLERS)
        start = np.array([[0.3, 0.6, 0.1], [0.3, 0.25, 0.45]])  # labellers are better than chance
        model = cls(0.1, np.repeat(start[None], m, axis=0))
        for _ in range(rounds):
            bad = model.posterior(patterns)
            old = model.prior
            weight = np.stack([counts * (1 - bad), counts * bad])
            votes = np.stack([[[weight[c][said[:, i] == v].sum() + start[c, v] for v in range(3)] for c in range(2)] for i in range(m)])
            model = cls(float((weight[1].sum() + 1) / (counts.sum() + 10)), votes / votes.sum(axis=2, keepdims=True))
            if abs(model.prior - old) < 1e-9:
                break
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(bad | votes). An abstention tells nothing."""
        said, ratio = self.digits(patterns), np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        share = self.votes[:, :, 1:] / self.votes[:, :, 1:].sum(axis=2, keepdims=True)
        log = np.log(share[:, 1] / share[:, 0])
        for i in range(len(LABELLERS)):
            ratio += np.where(said[:, i] > 0, log[i][np.maximum(said[:, i], 1) - 1], 0.0)
        return 1 / (1 + np.exp(-np.clip(ratio, -500, 500)))


def fit_linear(rows: list[tuple[list[int], list[float]]], bad: np.ndarray, dimensions: int, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on soft labels, by accelerated gradient steps over all rows."""
    if not rows:
        return np.zeros(dimensions + 1)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) + 1 for r in rows])
    place = np.concatenate([[*r[0], dimensions] for r in rows]).astype(np.int64)
    value = np.concatenate([[*r[1], 1.0] for r in rows])
    w = ahead = np.zeros(dimensions + 1)
    rate = 4.0 / np.bincount(at, weights=value**2).max()
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=ahead[place] * value, minlength=len(rows)), -500, 500)))
        slope = np.bincount(place, weights=(p - bad)[at] * value, minlength=dimensions + 1) / len(rows) + penalty * ahead
        new = ahead - rate * slope
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


def train(docs: DataFrame, dimensions: int, sample_rows: int) -> tuple[LabelModel, np.ndarray]:
    """Fit both models on ``text``: the votes of all documents are counted; the scorer learns from at most ``sample_rows`` distinct texts."""
    marked = docs.select("text", F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 40)).alias("mark"))
    kinds = marked.agg(F.approx_count_distinct("mark", 0.02)).first()[0]  # a tenth more than asked is marked, as this number is a little off
    marked = marked.withColumn("picked", F.col("mark") < int(min(1.0, 1.1 * sample_rows / max(1, kinds)) * (1 << 40)))
    schema = T.StructType([T.StructField("mark", T.LongType()), T.StructField("pattern", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = Measures(dimensions)
        for batch in batches:
            texts, picked = [x or "" for x in batch.column("text").to_pylist()], batch.column("picked").to_pylist()
            patterns, places, values = [], [], []
            for at in range(0, len(texts), 500):
                for use, (got, place, value) in zip(picked[at:], measures.measure(texts[at : at + 500], picked[at : at + 500])):
                    patterns.append(votes_of(got))
                    places.append(place.astype(np.int32) if use else None)
                    values.append(value.astype(np.float32) if use else None)
            arrays = [batch.column("mark"), pa.array(patterns, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    voted = staged(marked.mapInArrow(run, schema), "quality-votes")
    counted = voted.groupBy("pattern").count().toPandas()  # at most 3 to the number of labellers
    model = LabelModel.fit(counted["pattern"].to_numpy(np.int64), counted["count"].to_numpy(float))
    sample = voted.filter("places is not null").dropDuplicates(["mark"]).orderBy("mark").limit(sample_rows).collect()
    bad = model.posterior(np.array([r["pattern"] for r in sample], np.int64))
    return model, fit_linear([(r["places"], r["values"]) for r in sample], bad, dimensions)


def classify(docs: DataFrame, threshold: float = 0.5, dimensions: int = 4096, sample_rows: int = 10_000, text_col: str = "text") -> DataFrame:
    """Score the documents; their columns stay and ``_bad, _label, _keep`` are added.

    Heuristic labellers vote good or bad on each whole text or abstain. Expectation-maximisation over the vote patterns of all
    documents estimates the labellers' accuracies without any label. The posteriors of at most ``sample_rows`` distinct texts (picked by a hash; a bound of
    the fit alone) train a logistic scorer on hashed features: word shapes and bucketed measures. ``_bad`` is the scorer's
    probability of bad, ``_label`` the label model's posterior, ``_keep`` whether ``_bad`` is under ``threshold``.

    Nulls: a null text counts as empty; on empty texts all labellers abstain, so that the prior decides and, unless most documents are bad, they
    stay. Repeated rows are scored alike. An empty table gives an empty result. Columns named ``_bad``, ``_label`` or ``_keep`` are replaced.
    """
    docs = docs.drop("_bad", "_label", "_keep")
    model, weights = train(pick(docs, text=text_col), dimensions, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))
    added = [T.StructField("_bad", T.DoubleType()), T.StructField("_label", T.DoubleType()), T.StructField("_keep", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures, (model, weights) = Measures(dimensions), shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            bad, patterns = [], []
            for at in range(0, len(texts), 500):
                for got, place, value in measures.measure(texts[at : at + 500]):
                    patterns.append(votes_of(got))
                    bad.append(weights[-1] + float(weights[place] @ value))
            bad = 1 / (1 + np.exp(-np.clip(np.array(bad), -500, 500)))
            label = model.posterior(np.array(patterns, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bad), pa.array(label), pa.array(bad < threshold)], names=[*batch.schema.names, "_bad", "_label", "_keep"])

    return docs.mapInArrow(run, schema)


def good_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that ``classify`` keeps, all columns as they were, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return classify(plain, text_col=f"c{docs.columns.index(text_col)}", **options).filter("_keep").drop("_bad", "_label", "_keep").toDF(*docs.columns)

"""Jaccard self-join on word n-grams: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsim.llm.components import components
from procsim.llm.util import pick, shuffle_partitions
from procsim.llm.words import Vocabulary
from procsim.storage import staged

ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LETTERS = 8  # of a signature string, a byte each


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of whole texts: lower-case words between white space.

    A text with fewer words is one shingle; a text without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self.vocabulary = Vocabulary(self._learn)

    @staticmethod
    def _learn(words: list[str]) -> np.ndarray:
        coded = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words)
        return np.fromiter(coded, np.uint64, len(words))[:, None]

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        words = [x.lower().split() for x in texts]
        for places in self.vocabulary.look_up(words):
            n = len(places)
            if not n:
                yield np.empty(0, np.uint64)
                continue
            word = self.vocabulary.table[places, 0]
            width = min(n, self.width)
            shingle = np.full(n - width + 1, width, np.uint64)
            for i in range(width):
                shingle = mixed(shingle * ODD[0] + word[i : n - width + 1 + i])
            yield np.unique(shingle)


class Forest:
    """Signatures: for each tree a string of ``LETTERS`` letters, each the last byte of a minimum hash; a string is held as a long, first letter first."""

    def __init__(self, trees: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.trees = trees
        self.times = draw.integers(0, 2**32, trees * LETTERS, dtype=np.uint32) | np.uint32(1)
        self.plus = draw.integers(0, 2**32, trees * LETTERS, dtype=np.uint32)

    def strings(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row a set (none of them empty), a column a tree."""
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        start, base = np.cumsum(size) - size, (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(sets), self.trees), np.uint64)
        for t in range(self.trees):
            for p in range(t * LETTERS, (t + 1) * LETTERS):
                least = np.minimum.reduceat(base * self.times[p] + self.plus[p], start)
                out[:, t] = (out[:, t] << np.uint64(8)) | ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24))
        return out.view(np.int64)


def missed(similarity: float, trees: int, length: int) -> float:
    """Probability that two sets of a similarity share no prefix of ``length`` letters in any tree (at most: letters may agree by chance as well)."""
    return (1 - similarity**length) ** trees


def shortest_prefix(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix that finds a pair just at the threshold with probability ``recall``: no shorter one is ever needed (1 at least)."""
    length = LETTERS
    while length > 1 and missed(threshold, trees, length) > 1 - recall:
        length -= 1
    return length


def tagged(docs: DataFrame, text_col: str, width: int, trees: int) -> DataFrame:
    """``row`` (a struct of the document's columns), ``rid`` (a number of the row), ``digest`` (of the shingle set, null without words) and ``strings``."""
    given = docs.select(F.struct("*").alias("row"), docs[text_col].alias("text"))
    added = [T.StructField("rid", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("strings", T.ArrayType(T.LongType()))]
    schema = T.StructType([*given.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, forest, rid = Shingles(width), Forest(trees), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, digests, strings = [x or "" for x in batch.column("text").to_pylist()], [], []
            for at in range(0, len(texts), 500):
                sets = list(shingles.of(texts[at : at + 500]))
                full = [x for x in sets if len(x)]
                found = iter(forest.strings(full) if full else ())
                for x in sets:
                    digests.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    strings.append(next(found) if len(x) else None)
            rids = pa.array(np.arange(rid, rid + len(texts)))
            rid += len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, rids, pa.array(digests, pa.binary()), pa.array(strings, pa.list_(pa.int64()))], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)


def letters_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    differ = (a ^ b).view(np.uint64)
    return sum((differ >> np.uint64(8 * (LETTERS - d)) == 0).astype(np.int64) for d in range(1, LETTERS + 1))


def sorted_tries(classes: DataFrame, shortest: int) -> DataFrame:
    """``tree, string, rid`` of the strings that share a prefix of ``shortest`` letters or more with a neighbour in their tree's sorted order.

    All trees' strings are sorted together, dealt out in ranges of (tree, string, rid), so that the strings of a large node are split
    too. A string's longest match stands beside it. Ends of ranges stay, as their neighbours lie in another range.
    """
    strings = classes.select("rid", F.posexplode("strings").alias("tree", "string"))
    dealt = strings.select("tree", "string", "rid").repartitionByRange(shuffle_partitions(classes.sparkSession), "tree", "string", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None  # the tree and string before the batch; the batch's last row and its match so far
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, string = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            match = np.zeros(len(tree), np.int64)
            if len(tree) > 1:
                near = np.where(tree[1:] == tree[:-1], letters_alike(string[1:], string[:-1]), 0)
                match[1:] = near
                match[:-1] = np.maximum(match[:-1], near)
            if before is not None and before[0] == tree[0]:
                over = int(letters_alike(string[:1], np.array([before[1]]))[0])
                match[0] = max(match[0], over)
                held = (held[0], max(held[1], over))
            if held is not None and held[1] >= shortest:
                yield held[0]
            if first:  # the neighbour before it is in another range
                match[0] = LETTERS
            keep = match >= shortest
            keep[-1] = False
            yield batch.filter(pa.array(keep))
            first, before, held = False, (tree[-1], string[-1]), (batch.slice(len(tree) - 1), int(match[-1]))
        if held is not None:
            yield held[0]

    return dealt.sortWithinPartitions("tree", "string", "rid").mapInArrow(run, "tree int, string long, rid long")


def prefix(length: int):
    return F.shiftrightunsigned("string", 8 * (LETTERS - length))


def candidates(classes: DataFrame, shortest: int, crowd_from: int) -> tuple[DataFrame, DataFrame]:
    """``a, b, longest``: pairs under a small node of ``shortest`` letters of some tree, with their longest common prefix in any tree; and
    ``rid, crowd``: what meets under nodes of ``crowd_from`` strings or more, joined over all trees."""
    met = staged(sorted_tries(classes, shortest), "join-tries").withColumn("node", prefix(shortest))
    nodes = staged(met.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("low")).filter("n > 1"), "join-nodes")
    met = staged(met.join(nodes, ["tree", "node"]), "join-met")
    few = met.filter(F.col("n") < crowd_from)
    one = few.select("tree", "node", F.col("rid").alias("a"), F.col("string").alias("string_a"))
    two = few.select("tree", "node", F.col("rid").alias("b"), F.col("string").alias("string_b"))
    differ = F.col("string_a").bitwiseXOR(F.col("string_b"))
    length = F.lit(0)
    for d in range(1, LETTERS + 1):
        length = F.when(F.shiftrightunsigned(differ, 8 * (LETTERS - d)) == 0, d).otherwise(length)
    pairs = one.join(two, ["tree", "node"]).filter("a < b").groupBy("a", "b").agg(F.max(length).alias("longest"))
    crowds = components(met.filter(F.col("n") >= crowd_from).select(F.col("low").alias("a"), F.col("rid").alias("b")), "join-crowds")
    crowds = staged(crowds.select(F.col("node").alias("rid"), F.col("root").alias("crowd")), "join-crowd")
    of_a, of_b = (crowds.select(F.col("rid").alias(x), F.col("crowd").alias(f"crowd_{x}")) for x in "ab")
    pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    pairs = pairs.filter("crowd_a is null or crowd_b is null or crowd_a <> crowd_b").select("a", "b", "longest")
    return staged(pairs, "join-pairs"), crowds


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``rid, size, shingles`` of ``rid, text``: the sets as bytes, worked out once for all comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            rid, text = batch.column("rid"), batch.column("text").to_pylist()
            for at in range(0, len(text), 500):
                sets = list(shingles.of([x or "" for x in text[at : at + 500]]))
                yield pa.RecordBatch.from_arrays(
                    [rid.slice(at, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rid", "size", "shingles"]
                )

    return texts.mapInArrow(run, "rid long, size long, shingles binary")


def verified_pairs(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """``a, b`` in; those of them with the similarity, with ``shared`` and ``whole`` (shingles of both and of either), out."""
    of_a, of_b = (sets.select(F.col("rid").alias(x), F.col("size").alias(f"size_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(of_b, "b").join(of_a, "a")
    both = both.filter(F.least("size_a", "size_b") * threshold.denominator >= F.greatest("size_a", "size_b") * threshold.numerator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = (batch.column(i).to_pylist() for i in range(4))
            out: list[list[int]] = [[], [], [], []]
            for i in range(len(a)):
                x, y = np.frombuffer(one[i], np.uint64), np.frombuffer(two[i], np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - shared
                if shared * threshold.denominator >= threshold.numerator * whole:
                    for column, v in zip(out, (a[i], b[i], shared, whole)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "shared", "whole"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, shared long, whole long")


def ascend(pairs: DataFrame, sets: DataFrame, threshold: Fraction, trees: int, shortest: int, recall: float) -> tuple[DataFrame, int]:
    """Verify pairs from the longest common prefix down, all trees together, until the target recall is met; returns the links and the length reached.

    With links of similarities s found at a prefix length, 1 / (1 - missed(s)) of them are expected for each, so that the links missed
    are estimated by the sum of missed / (1 - missed), one more link just at the threshold included. As long as that is over 1 - ``recall`` of
    the links, prefixes are shortened by a letter. At ``shortest`` letters the threshold alone grants the recall.
    """
    found = []
    for length in range(LETTERS, shortest - 1, -1):
        links = staged(verified_pairs(pairs.filter(F.col("longest") == length), sets, threshold), f"join-links-{length}")
        found.append(links)
        if length == shortest:
            break
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        lost = F.pow(1 - F.pow(F.col("shared") / F.col("whole"), float(length)), float(trees))
        n, lacking = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(lost / (1 - lost)), F.lit(0.0))).first()
        at_threshold = missed(float(threshold), trees, length)
        if lacking + at_threshold / (1 - at_threshold) <= (1 - recall) * n:
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, length


def crowd_links(crowds: DataFrame, sets: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """Links inside crowds, without listing them: ``node, degree`` (links) and ``node, other`` (links that span what is linked).

    ``crowds``: rid, crowd. Similar sets have similar sizes: a crowd is cut by the logarithm of size into classes, of which only neighbouring
    ones are compared, and each class into blocks of about ``block`` rows or as many shingles as that makes at 4096 a row. Each two
    blocks meet in one task, which finds all similarities by products of shingle incidence matrices.
    """
    scale = (1 - 1e-9) / -math.log(float(threshold)) if threshold < 1 else 1e6
    members = crowds.join(sets, "rid").withColumn("own", F.floor(F.log("size") * scale))
    members = staged(members, "join-members")
    sizes = members.groupBy("crowd", "own").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / (4096 * block))).alias("blocks"))
    # a crowd has as many size classes as the logarithm of the largest size
    sizes = staged(sizes.groupBy("crowd").agg(F.map_from_entries(F.collect_list(F.struct("own", "blocks"))).alias("blocks")), "join-sizes")
    dealt = members.join(sizes, "crowd").withColumn("at", F.pmod(F.xxhash64("rid"), F.element_at("blocks", F.col("own"))))

    def across(step: int):
        there = F.element_at("blocks", F.col("own") + step)
        mine, other = F.struct(F.col("own"), F.col("at")), lambda j: F.struct((F.col("own") + step).alias("own"), j.alias("at"))
        every = F.transform(F.sequence(F.lit(0).cast("long"), there - 1), lambda j: F.struct(F.least(mine, other(j)).alias("i"), F.greatest(mine, other(j)).alias("j")))
        return F.when(there.isNotNull(), every).otherwise(F.array().cast(KEYS))

    dealt = dealt.withColumn("key", F.explode(F.concat(across(-1), across(0), across(1))))
    dealt = dealt.select("crowd", "rid", "shingles", (F.struct("own", "at") == F.col("key.i")).alias("left"), (F.struct("own", "at") == F.col("key.j")).alias("right"), "key")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        left, right = np.flatnonzero(rows["left"]), np.flatnonzero(rows["right"])
        rids, sets = rows["rid"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, use = np.repeat(np.arange(len(sets)), size), times[place] > 1
        place, owner = np.unique(place[use], return_inverse=True)[1], owner[use]
        shared, order = np.zeros((len(left), len(right)), np.float64), np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            lo, hi = np.searchsorted(place, (at, at + 4096))
            held = np.zeros((len(sets), 4096), np.float32)
            held[owner[lo:hi], place[lo:hi] - at] = 1
            shared += held[left] @ held[right].T
        whole = size[left][:, None] + size[right][None, :] - shared
        same = bool(rows["left"].iloc[0] and rows["right"].iloc[0])
        linked = (shared * threshold.denominator >= threshold.numerator * whole) & (left[:, None] < right[None, :] if same else True)
        degree = np.zeros(len(rids), np.int64)
        np.add.at(degree, left, linked.sum(axis=1))
        np.add.at(degree, right, linked.sum(axis=0))
        root = list(range(len(rids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        spanning = []
        for x, y in zip(*np.nonzero(linked)):
            p, q = top(left[x]), top(right[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                spanning.append((rids[left[x]], rids[right[y]], 0))
        mine = np.flatnonzero(degree)
        return pd.DataFrame([*((rids[x], None, degree[x]) for x in mine), *spanning], columns=["node", "other", "degree"]).astype({"node": "int64", "other": "Int64", "degree": "int64"})

    return dealt.groupBy("crowd", "key").applyInPandas(run, "node long, other long, degree long")


KEYS = "array<struct<i:struct<own:bigint,at:bigint>,j:struct<own:bigint,at:bigint>>>"


def judged_rows(docs: DataFrame, threshold: float, width: int, trees: int, recall: float, crowd_from: int, block: int,
                id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The staged rows with ``rid``; ``rid, id, class, keep, links, copies`` of each; and the prefix length that was reached."""
    exact = Fraction(str(threshold))
    if not 0 < exact <= 1 or width < 1:
        raise ValueError("threshold must be in (0, 1] and width >= 1")
    rows = staged(tagged(docs, text_col, width, trees).drop("text"), "join-rows")
    owned = rows.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"))
    owned = staged(owned, "join-classes")
    classes = staged(rows.select("rid", "strings").join(owned.select("rid"), "rid"), "join-strings")
    shortest = shortest_prefix(float(exact), trees, recall)
    pairs, crowds = candidates(classes, shortest, crowd_from)
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("rid")).union(crowds.select("rid")).distinct(), "join-wanted")
    texts = rows.select("rid", F.col("row")[text_col].alias("text"))
    sets = staged(shingle_sets(texts.join(wanted, "rid"), width), "join-sets")
    linked, reached = ascend(pairs, sets, exact, trees, shortest, recall)
    crowd = staged(crowd_links(crowds, sets, exact, block), "join-crowd-links")
    roots = components(linked.select("a", "b").unionByName(crowd.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "join-groups")
    ends = linked.select(F.explode(F.array("a", "b")).alias("rid"), F.lit(1).cast("long").alias("degree"))
    degrees = ends.union(crowd.filter("other is null").select("node", "degree")).groupBy("rid").agg(F.sum("degree").alias("links"))
    known = owned.join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(degrees, "rid", "left").select("digest", "copies", "links", F.coalesce("root", "rid").alias("root"))
    light = rows.select("rid", "digest", F.col("row")[id_col].alias("id"))
    judged = light.join(known, "digest", "left").withColumn("root", F.coalesce("root", "rid"))
    judged = staged(judged.drop("digest"), "join-judged")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    # written, so that the join below is one of two plain exchanges, which Spark can split at a large class
    first = staged(judged.groupBy("root").agg(F.min(order).alias("first")), "join-firsts")
    return rows, judged.join(first, "root").select(
        "rid", "id", F.col("first.id").alias("class"), (F.col("rid") == F.col("first.rid")).alias("keep"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    ), reached


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 32, recall: float = 0.99999,
                    crowd_from: int = 32, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of similar texts: Jaccard similarity of their sets of ``width``-word shingles at or above ``threshold``.

    Documents of one shingle set form a class, which its first row stands for. The classes' signatures make an LSH forest: in each of ``trees``
    trees a string of 8 letters, which are minimum hashes. Each tree's strings are sorted, and a string's neighbours show its longest matching
    prefix. Pairs are verified on their whole shingle sets from the longest common prefix in any tree downwards. After each
    length the links still missed are estimated from the similarities of those found; all trees' prefixes are shortened by a letter
    until the estimate is within 1 - ``recall`` of the links, at most down to the length that finds a pair just at the threshold with
    probability ``recall``. What meets under nodes of ``crowd_from`` strings or more of that shortest length is joined over the trees into crowds and
    verified all with all, block by block, without listing pairs. No node is cut short.

    Returns one row a document: ``doc_id, class_id`` (the id of the first document, by id and row, of all that are linked directly or
    through others), ``n_links`` (other shingle sets linked directly), ``n_copies`` (documents of the own set) and ``keep`` (whether the row is that first one).

    Nulls: texts that are null or have no word are in no class with others and have no links; null ids come last in a class. Texts of under
    ``width`` words are one shingle. Repeated rows are copies. An empty table gives an empty result; further columns are ignored.
    """
    chosen = pick(docs, doc_id=id_col, text=text_col)
    _, judged, _ = judged_rows(chosen, threshold, width, trees, recall, crowd_from, block, "doc_id", "text")
    return judged.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("links").alias("n_links"), F.col("copies").alias("n_copies"), "keep")


def deduplicate(docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = 32, recall: float = 0.99999,
                crowd_from: int = 32, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class of ``near_duplicates`` left, all columns as they were, whatever their names."""
    rows, judged, _ = judged_rows(docs, threshold, width, trees, recall, crowd_from, block, id_col, text_col)
    return rows.join(judged.filter("keep").select("rid"), "rid", "left_semi").select("row.*")

"""Approximate nearest neighbours: a forest of sorted hash strings a shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.llm.vectors import best, in_shards, search_shards, usable

BLOCK = 64  # queries that ascend together


class PrefixForest:
    """``trees`` sorted arrays of hash strings of ``bits`` signs of random projections.

    A query descends in each tree to its longest matching prefix. Then all trees ascend together, one bit at a time, until the rows under the
    common prefix length are ``collect`` times the shard's rows over all trees. Each row is counted once for each tree and length at which
    it is met. A bit agrees with probability 1 - angle / pi, so that the count tells the angle, and the row's norm makes an
    inner product of it: the rows of the largest, ``share`` of the shard and ``least`` at least, are scored on the original vectors.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, trees: int, bits: int, collect: float, share: float, least: int, seed: int):
        self.ids, self.rows, self.k, self.bits = ids, rows, k, bits
        self.repeated = len(np.unique(ids)) < len(ids)
        self.scale = np.abs(rows).max(initial=0.0) or 1.0
        self.norm = np.sqrt(((rows / self.scale) ** 2).sum(axis=1))
        self.planes = np.random.default_rng(seed).standard_normal((trees, bits, rows.shape[1]))
        codes = self._codes(rows)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)
        self.enough = collect * len(ids)
        self.most = min(len(ids), max(int(share * len(ids)), least))
        self.cosines: dict[int, np.ndarray] = {}
        self.scored = 0  # rows, over all queries

    def _codes(self, rows: np.ndarray) -> np.ndarray:
        place = (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)).astype(np.float64)
        return np.stack([((rows / self.scale @ p.T) > 0) @ place for p in self.planes]).astype(np.int64)

    def _cosine(self, length: int) -> np.ndarray:
        """The cosine for which a count is to be expected if trees ascend to a length, by count."""
        if length not in self.cosines:
            agree = np.linspace(0.0, 1.0, 2049)
            count = len(self.planes) * (agree[:, None] ** np.arange(length, self.bits + 1)).sum(axis=1)
            every = np.arange(len(self.planes) * (self.bits - length + 1) + 1)
            self.cosines[length] = -np.cos(np.pi * np.interp(every, count, agree))
        return self.cosines[length]

    def _promise(self, queries: np.ndarray) -> np.ndarray:
        """For each query and row, the inner product that their count lets expect, up to the query's norm."""
        codes = self._codes(queries)
        promise, open_ = np.empty((len(queries), len(self.ids))), np.arange(len(queries))
        for length in range(self._longest(codes), -1, -1):
            left = self.bits - length
            start = (codes[:, open_] >> left) << left
            low = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, start)])
            high = np.stack([np.searchsorted(s, x + (1 << left)) for s, x in zip(self.sorted, start)])
            done = ((high - low).sum(axis=0) >= self.enough) | (length == 0)
            for at in np.flatnonzero(done):
                q, size = open_[at], high[:, at] - low[:, at]
                spans = list(enumerate(zip(low[:, at].tolist(), high[:, at].tolist())))
                differ = np.concatenate([self.sorted[t, a:b] for t, (a, b) in spans]) ^ np.repeat(codes[:, q], size)
                lengths = self.bits - np.frexp(differ.astype(np.float64))[1] - length + 1  # from this one up to the row's own
                count = np.bincount(np.concatenate([self.order[t, a:b] for t, (a, b) in spans]), weights=lengths, minlength=len(self.ids))
                promise[q] = self._cosine(length)[count.astype(np.int64)] * self.norm
            open_ = open_[~done]
            if not len(open_):
                break
        return promise

    def _longest(self, codes: np.ndarray) -> int:
        """The longest prefix that any query shares with a row in any tree: a neighbour in the sorted array has it."""
        longest = 0
        for rows, asked in zip(self.sorted, codes):
            at = np.searchsorted(rows, asked)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(rows) - 1)):
                longest = max(longest, self.bits - int(np.frexp((rows[near] ^ asked).astype(np.float64))[1].min(initial=self.bits)))
        return longest

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray):
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for block in range(0, len(queries), BLOCK):
            for q, promise in enumerate(self._promise(queries[block : block + BLOCK]), block):
                some = np.arange(len(promise)) if self.most == len(promise) else np.argpartition(-promise, self.most - 1)[: self.most]
                some = np.sort(some[self.ids[some] != ids[q]])
                self.scored += len(some)
                own = self.rows[some]
                rough = own @ queries[q]
                if len(some) > self.k and not self.repeated:  # a margin for rounding; the kept ones are summed in the order of components
                    kth = np.partition(rough, len(rough) - self.k)[len(rough) - self.k]
                    some = some[rough >= kth - 1e-9 * (1 + abs(kth))]
                score = np.zeros(len(some))
                for d in range(self.rows.shape[1]):
                    score += self.rows[some, d] * queries[q, d]
                keep = np.lexsort((self.ids[some], -score))
                if self.repeated:  # the best row of each id
                    keep = keep[np.sort(np.unique(self.ids[some[keep]], return_index=True)[1])]
                keep = keep[: self.k]
                for column, x in zip(out, (np.full(len(keep), q), self.ids[some[keep]], score[keep])):
                    column.append(x)
        return tuple(np.concatenate(x) for x in out)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 96, bits: int = 24, collect: float = 10.0, share: float = 0.25, least: int = 400,
            shard_rows: int = 8192, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """About the ``k`` rows of largest inner product for each row for which ``is_query`` (a condition on ``vec_id``) holds.

    Rows are dealt evenly into shards, each with its prefix forest over all its rows; hashes are signs of random projections drawn from
    ``seed``, the same in all shards, and need no fit. In each shard the trees ascend until they hold ``collect`` times the
    shard's rows (rows that several trees hold count as often). How often and by how long prefixes a row was met,
    and its norm, tell the ``share`` of the shard's rows, ``least`` of them at least, that are scored on the original vectors; the shards' best are merged.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id; fewer than ``k`` candidates: all.

    Nulls: rows with null id, null, empty or zero vector, or null or non-finite components take no part. Rows with the
    query's id are no candidates for it; other rows of one id count once. Vectors of different lengths aren't compared. An empty table gives
    an empty result; further columns are ignored.
    """
    if not 1 <= bits <= 52:
        raise ValueError("bits must be in 1..52")
    rows, shards = in_shards(usable(vectors, id_col, vector_col, zero=False), vectors.count(), shard_rows, "ann-rows")
    asked = rows.filter(is_query).select("vec_id", "vector").dropDuplicates()
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("floor", F.lit(None).cast("double"))

    def build(ids: np.ndarray, own: np.ndarray) -> PrefixForest:
        return PrefixForest(ids, own, k, trees, bits, collect, share, max(least, k + 1), seed)

    return best(search_shards(rows, asked, shards, build, "double"), k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner product: a ball tree a shard, branch and bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.llm.vectors import best, in_shards, search_shards, usable
from procsim.storage import staged

EXACT = 2.0**53
LEAST, EMPTY = np.int64(-(2**63)), np.int64(2**63 - 1)


class BallTree:
    """Nodes are balls; q.c + |q| r bounds the inner product of q with any row in the ball of centre c and radius r."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, leaf: int = 64):
        self.ids, self.rows, self.k = ids, rows, k
        self.repeated = len(np.unique(ids)) < len(ids)
        self.largest = np.abs(rows).max(initial=0.0)
        self.centre, self.radius, self.children, self.members = [], [], [], []
        self._grow(np.arange(len(rows)), leaf)

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        at, part = len(self.radius), self.rows[own]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(away.max() * (1 + 1e-9))
        self.children.append(None)
        self.members.append(None)
        if len(own) <= leaf or away.max() == 0:
            self.members[at] = own
        else:  # split half and half along the line between two distant rows
            a = part[away.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            along = np.argsort(part @ (b - a), kind="stable")
            half = len(own) // 2
            self.children[at] = (self._grow(own[along[:half]], leaf), self._grow(own[along[half:]], leaf))
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray):
        n, k = len(ids), self.k
        self.q_ids, self.queries, self.norm = ids, queries, np.sqrt((queries**2).sum(axis=1))
        self.floor = np.where(np.isnan(floor), -np.inf, floor)
        self.kth = self.floor.copy()
        # exact scores, the empty places last of all
        self.top, self.top_ids = np.full((n, k), LEAST), np.full((n, k), EMPTY)
        self.big = self.largest * np.abs(queries).max(initial=0.0) * queries.shape[1] >= EXACT
        self._visit(0, np.arange(n))
        q, rank = np.nonzero((self.top_ids != EMPTY) & (self.top >= self.floor[:, None]))
        return q, self.top_ids[q, rank], self.top[q, rank]

    def _bound(self, node: int, own: np.ndarray) -> np.ndarray:
        reach = self.norm[own] * self.radius[node]
        inner = self.queries[own] @ self.centre[node]
        return inner + reach + 1e-9 * (self.norm[own] * np.sqrt((self.centre[node] ** 2).sum()) + reach) + 1e-9

    def _visit(self, node: int, own: np.ndarray) -> None:
        own = own[self._bound(node, own) >= self.kth[own]]
        if not len(own):
            return
        if self.members[node] is not None:
            return self._leaf(self.members[node], own)
        left, right = self.children[node]
        first = self._bound(left, own) >= self._bound(right, own)
        for child, part in ((left, own[first]), (right, own[~first]), (right, own[first]), (left, own[~first])):
            if len(part):
                self._visit(child, part)

    def _leaf(self, members: np.ndarray, own: np.ndarray) -> None:
        for at in range(0, len(members), 4096):  # a ball of equal rows may hold many
            some = members[at : at + 4096]
            if self.big:  # too large for whole numbers in doubles: exact integers, held to the range of a long
                exact = whole(self.queries[own]) @ whole(self.rows[some]).T
                scores = np.clip(exact, int(LEAST), -int(LEAST) - 1).astype(np.int64)
            else:
                scores = (self.queries[own] @ self.rows[some].T).astype(np.int64)
            found = np.broadcast_to(self.ids[some], scores.shape)
            mine_too = found == self.q_ids[own][:, None]
            hit = ((scores >= self.kth[own][:, None]) & ~mine_too).any(axis=1)
            if not hit.any():
                continue
            mine, scores, found = own[hit], np.where(mine_too, LEAST, scores)[hit], np.where(mine_too, EMPTY, found)[hit]
            scores, found = np.hstack([self.top[mine], scores]), np.hstack([self.top_ids[mine], found])
            if self.repeated:  # of the rows of one id the best counts
                order = np.lexsort((-1 - scores, found), axis=-1)
                scores, found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
                again = np.hstack([np.zeros((len(mine), 1), bool), found[:, 1:] == found[:, :-1]])
                scores, found = np.where(again, LEAST, scores), np.where(again, EMPTY, found)
            order = np.lexsort((found, -1 - scores), axis=-1)[:, : self.k]
            self.top[mine], self.top_ids[mine] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
            full = self.top_ids[mine, -1] != EMPTY
            self.kth[mine] = np.maximum(self.floor[mine], np.where(full, self.top[mine, -1], -np.inf))


def whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers, which don't overflow."""
    return np.array([[int(x) for x in row] for row in values], object)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, kept as whole doubles."""
    return F.transform(vector, lambda x: F.when(F.abs(x) < 2.0**43, F.floor(x * float(scale)).cast("double")).otherwise(x * float(scale)))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 8192,
                id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest integer inner product for each row for which ``is_query`` (a condition on ``vec_id``) holds.

    Components become floor(scale * x). Rows are dealt evenly into shards, each with a ball tree that is searched for blocks
    of queries, nodes in the order of their inner-product bound. Shards share the k-th score: first each query's
    own shard is searched, then its k-th score there goes with the query to the others, which prune by it from the start.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id; fewer than ``k`` candidates: all.

    Nulls: rows with null id, null or empty vector, or null or non-finite components take no part. Rows with the
    query's id are no candidates for it; other rows of one id count once, with the best score. Vectors of different lengths aren't compared. Scores are exact
    integers; those beyond the range of a long are held to it. An empty table gives an empty result; further columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col, zero=True).withColumn("vector", scaled(F.col("vector"), scale))
    rows, shards = in_shards(rows, vectors.count(), shard_rows, "topk-rows")
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "shard", "vector"])

    def build(ids: np.ndarray, own: np.ndarray) -> BallTree:
        return BallTree(ids, own, k)

    home = staged(search_shards(rows, asked.withColumn("floor", F.lit(None).cast("double")), shards, build, "long"), "topk-home")
    kth = best(home, k).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    away = asked.withColumnRenamed("shard", "home").join(kth, asked["vec_id"] == kth["query_id"], "left")
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    found = home.unionByName(search_shards(rows, away, shards, build, "long")) if shards > 1 else home
    return best(found, k).select("query_id", "rank", "vec_id", "score")

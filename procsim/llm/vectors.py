"""Sharded vector search: the frame that exact and approximate search share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsim.llm.util import pick
from procsim.storage import staged


class Index(Protocol):
    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, row ids and scores of the best rows, none of them below its query's floor."""


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """Rows that take part: ``vec_id, vector`` (doubles), ids and vectors not null, all components finite."""
    fine = pick(vectors, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    fine = fine.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(finite)
    return fine if zero else fine.filter(F.exists("vector", lambda x: x != 0))


def in_shards(rows: DataFrame, count: int, shard_rows: int, name: str) -> tuple[DataFrame, int]:
    """Deal rows evenly into shards, whatever their ids; the staged rows carry their ``shard``."""
    shards = max(1, -(-count // shard_rows))
    return staged(rows.repartition(shards).withColumn("shard", F.spark_partition_id()), name), shards


def search_shards(rows: DataFrame, asked: DataFrame, shards: int, build: Callable[[np.ndarray, np.ndarray], Index], score: str) -> DataFrame:
    """Search each shard for the queries sent to it.

    ``rows``: vec_id, vector, shard; ``asked``: vec_id, vector, shard, floor. A shard's rows and the queries that come
    to it meet in one task, rows first, and each shard has a task of its own; a task holds its shard's rows and one batch of queries at a time.
    Vectors are compared with vectors of the same length only.
    """
    both = rows.select("shard", F.lit(0).alias("kind"), "vec_id", "vector", F.lit(None).cast("double").alias("floor"))
    both = both.unionByName(asked.select("shard", F.lit(1).alias("kind"), "vec_id", "vector", "floor"))
    dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, built = None, [], None
        for batch in batches:
            for at, part in batch.groupby("shard", sort=True):
                if at != shard:
                    shard, held, built = at, [], None
                kind = part["kind"].to_numpy()
                if (kind == 0).any():
                    held.append(part[kind == 0][["vec_id", "vector"]])
                queries = part[kind == 1]
                if not len(queries):
                    continue
                if built is None:
                    built, held = {size: build(*same) for size, same in by_size(held)}, []
                for size, own in queries.groupby(queries["vector"].map(len)):
                    if size not in built:
                        continue
                    ids = own["vec_id"].to_numpy(np.int64)
                    q, found, scores = built[size].search(ids, np.stack(own["vector"].to_numpy()), own["floor"].to_numpy(np.float64))
                    yield pd.DataFrame({"query_id": ids[q], "vec_id": found, "score": scores})

    return dealt.mapInPandas(run, f"query_id long, vec_id long, score {score}")


def by_size(held: list[pd.DataFrame]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    if held:
        rows = pd.concat(held)
        for size, same in rows.groupby(rows["vector"].map(len)):
            ids, vectors = same["vec_id"].to_numpy(np.int64), np.stack(same["vector"].to_numpy())
            if len(np.unique(ids)) < len(ids):  # repeated rows count once
                once = np.unique(np.column_stack([ids.view(np.float64), vectors + 0.0]).view(f"V{8 * (size + 1)}").ravel(), return_index=True)[1]
                ids, vectors = ids[np.sort(once)], vectors[np.sort(once)]
            yield size, (ids, vectors)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller id, ranked from 1; a row found twice counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

"""Common tokens of pairs of models, by joining tokens rather than pairs (behind O-25 to O-30, O-54, O-55, O-65)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsim.storage import staged


def is_dense(pairs: DataFrame, part: float = 0.125) -> bool:
    """Whether the pairs are a good part of all pairs of their models."""
    n, a, b = pairs.agg(F.count(F.lit(1)), F.approx_count_distinct("model_a"), F.approx_count_distinct("model_b")).first()
    return n >= part * a * b


def many_matches(sets: DataFrame, pairs: DataFrame) -> bool:
    """Whether most pairs have so many tokens in common that going through both sets costs less than making each match a row (16 times as much as a step)."""
    n, models = pairs.count(), sets.select("model_id").distinct().count()
    often = sets.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tokens, matches = often.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    return bool(n and models) and 16 * matches > 2 * n * tokens / models


def shared_tokens(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``model_a, model_b, shared`` of the distinct ``model_id, token``.

    Where models have most tokens in common, tokens are numbered, a model's numbers become one array, and a pair's arrays are
    intersected where they meet. Elsewhere models meet at their tokens.
    """
    if not many_matches(sets, pairs):
        return shared_counts(sets.withColumn("n", F.lit(1).cast("long")), pairs, ["token"], [])
    numbers = staged(sets.select("token").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    arrays = staged(sets.join(numbers, "token").groupBy("model_id").agg(F.collect_list("number").alias("own")), "arrays")
    of_a, of_b = (arrays.select(F.col("model_id").alias(f"model_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    met = pairs.select("model_a", "model_b").join(of_a, "model_a").join(of_b, "model_b")
    return met.select("model_a", "model_b", F.size(F.array_intersect("own_a", "own_b")).cast("long").alias("shared"))


def shared_counts(counts: DataFrame, pairs: DataFrame, token: list[str], by: list[str], block: int = 1024) -> DataFrame:
    """``model_a, model_b, *by, shared``: for each pair the sum of least(n_a, n_b) over the tokens of both.

    ``counts``: model_id, the columns ``token`` and ``n``, a row for each token of a model; ``by``: those of the columns ``token`` that the sums are kept apart by.
    Where the pairs are a good part of all, models meet at their tokens and only real matches are made: a token of one model alone makes no row, and
    one of more than ``block`` models is dealt out in pairs of blocks of them. Matches are added up before they are shuffled. A thin list of pairs
    leads to its tokens instead.
    """
    if not is_dense(pairs):
        of_a = counts.select(F.col("model_id").alias("model_a"), *token, F.col("n").alias("n_a"))
        of_b = counts.select(F.col("model_id").alias("model_b"), *token, F.col("n").alias("n_b"))
        met = pairs.select("model_a", "model_b").join(of_a, "model_a").join(of_b, ["model_b", *token])
        return met.groupBy("model_a", "model_b", *by).agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    often = counts.groupBy(*token).agg(F.count(F.lit(1)).alias("models")).filter("models > 1")
    met = counts.join(often, token).withColumn("blocks", F.ceil(F.col("models") / block)).withColumn("own", F.pmod(F.xxhash64("model_id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = met.select(*token, F.col("model_id").alias("low"), F.col("n").alias("n_low"), F.col("own").alias("i"), other.alias("j"))
    second = met.select(*token, F.col("model_id").alias("high"), F.col("n").alias("n_high"), F.col("own").alias("j"), other.alias("i"))
    sums = first.join(second, [*token, "i", "j"]).filter("low < high").groupBy("low", "high", *by).agg(F.sum(F.least("n_low", "n_high")).alias("shared"))
    alone = counts.groupBy(F.col("model_id").alias("low"), F.col("model_id").alias("high"), *by).agg(F.sum("n").alias("shared"))
    sides = pairs.select("model_a", "model_b", F.least("model_a", "model_b").alias("low"), F.greatest("model_a", "model_b").alias("high"))
    same = sides.filter("model_a = model_b").join(alone, ["low", "high"])
    return sides.join(sums, ["low", "high"]).unionByName(same).select("model_a", "model_b", *by, "shared")

"""Structural similarity: families, groups, categories, overall (O-30 to O-39)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.functions.metrics import blend, check_method, pair_weight, set_metric, weighted_mean
from procsim.operators.items import KEYS, item_counts
from procsim.operators.matching import shared_counts
from procsim.storage import staged

# Weights of families in groups, and of categories.
GROUPS = {
    "activities": {"activity_names": 0.5, "activity_types": 0.5},
    "events": {"event_names": 0.5, "event_types": 0.5},
    "gateways": {"gateway_names": 0.5, "gateway_types": 0.5},
    "flows": {"seq_flows_str": 0.7, "mes_flows_str": 0.3},
    "pools": {"lane_names": 0.5, "lane_with_refs": 0.5},
    "subprocesses": {"subprocess_names": 0.2, "subprocess_elemrefs": 0.3, "subprocess_flows": 0.5},
}
CATEGORIES = ("elements", "flows", "organizational", "subprocess")
FLAT = {"elements": 0.3, "flows": 0.5, "organizational": 0.2, "subprocess": 0.0}
NESTED = {"elements": 0.3, "flows": 0.5, "organizational": 0.15, "subprocess": 0.05}


def all_pairs(models: DataFrame) -> DataFrame:
    """Unordered pairs of different models: ``model_a < model_b``. The result is quadratic in the models, whatever the plan."""
    ids = models.select("model_id").distinct()
    return ids.select(F.col("model_id").alias("model_a")).join(ids.select(F.col("model_id").alias("model_b")), F.col("model_a") < F.col("model_b"))


def fine_scores(items: DataFrame, pairs: DataFrame, method: str = "dice") -> DataFrame:
    """``model_a, model_b, key, n1, n2, shared, score, weight, present``: a row for each pair and family.

    Multisets are joined as counts: a common item of a pair counts least(n_a, n_b) times. The counts, far fewer than the items, are
    written in the shared folder once and read for all uses.
    """
    check_method(method)
    counts = staged(item_counts(items), "items")
    sizes = counts.groupBy("model_id", "key").agg(F.sum("n").alias("n"))
    common = shared_counts(counts, pairs, ["key", "item"], ["key"])
    every = pairs.select("model_a", "model_b", F.explode(F.array(*[F.lit(k) for k in KEYS])).alias("key"))
    every = every.join(sizes.select(F.col("model_id").alias("model_a"), "key", F.col("n").alias("n1")), ["model_a", "key"], "left")
    every = every.join(sizes.select(F.col("model_id").alias("model_b"), "key", F.col("n").alias("n2")), ["model_b", "key"], "left")
    every = every.join(common, ["model_a", "model_b", "key"], "left")
    n1, n2, shared = (F.coalesce(c, F.lit(0)) for c in ("n1", "n2", "shared"))
    return every.select(
        "model_a", "model_b", "key", n1.alias("n1"), n2.alias("n2"), shared.alias("shared"),
        set_metric(shared, n1, n2, method).alias("score"), pair_weight(n1, n2).alias("weight"), (n1 + n2 > 0).alias("present"),
    )


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) != set(CATEGORIES):
        raise ValueError(f"weights must have exactly these keys: {', '.join(CATEGORIES)}")
    if not 0.99 <= sum(weights.values()) <= 1.01:
        raise ValueError(f"weights must sum to 1.0, not {sum(weights.values())}")
    return weights


def roll_up(fine: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a pair: family scores and presence, group scores, category scores, weights used, overall.

    Absent families (empty on both sides) don't count in groups, null groups not in categories, null categories not
    overall; the weights of the others are scaled up. Without ``weights``, pairs with an expanded subprocess on either side
    use the nested default, others the flat one.
    """
    if weights is not None:
        check_weights(weights)

    def of(key: str, column: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col(column)))

    wide = fine.groupBy("model_a", "model_b").agg(
        *[of(k, "score").alias(k) for k in KEYS],
        *[of(k, "present").alias(f"has_{k}") for k in KEYS],
    )
    for group, parts in GROUPS.items():
        wide = wide.withColumn(f"group_{group}", weighted_mean([(w, F.when(F.col(f"has_{k}"), F.col(k))) for k, w in parts.items()]))
    wide = wide.withColumn("has_expanded_subprocess", F.col("has_subprocess_elemrefs"))
    wide = wide.withColumns({
        "high_elements": weighted_mean([(1.0, F.col(f"group_{g}")) for g in ("activities", "events", "gateways")]),
        "high_flows": F.col("group_flows"), "high_organizational": F.col("group_pools"), "high_subprocess": F.col("group_subprocesses"),
    })
    for c in CATEGORIES:
        used = F.lit(float(weights[c])) if weights else F.when(F.col("has_expanded_subprocess"), NESTED[c]).otherwise(FLAT[c])
        wide = wide.withColumn(f"weight_{c}", used)
    return wide.withColumn("overall", weighted_mean([(F.col(f"weight_{c}"), F.col(f"high_{c}")) for c in CATEGORIES]))


def structural_similarity(items: DataFrame, pairs: DataFrame, method: str = "dice", weights: dict[str, float] | None = None) -> DataFrame:
    """Structural similarity of pairs of models (O-38): ``fine_scores`` and ``roll_up`` in one plan."""
    return roll_up(fine_scores(items, pairs, method), weights)


def hybrid(structural: DataFrame, behavioral: DataFrame, structural_weight: float = 0.5, among: DataFrame | None = None, few: int = 100_000) -> DataFrame:
    """Blend ``overall`` of one side with ``score`` of the other (O-39); pairs that one side lacks have null there.

    ``among``: the models of whose pairs ``model_a < model_b``, all of them, ``behavioral`` has a row each. Its rows then stay where they are, if ``structural``
    has at most ``few``: these are sent to them, and the pairs that only ``structural`` has are told by their models.
    """
    score, ws, wb = blend(F.col("structural"), F.col("behavioral"), structural_weight)
    left = structural.select("model_a", "model_b", F.col("overall").alias("structural"))
    right = behavioral.select("model_a", "model_b", F.col("score").alias("behavioral"))
    if among is not None:
        left = staged(left, "structural")
    if among is None or left.count() > few:
        both = left.join(right, ["model_a", "model_b"], "full")
    else:
        ids = among.select("model_id").distinct()
        known = [left.select(f"model_{x}").distinct().join(ids.select(F.col("model_id").alias(f"model_{x}")), f"model_{x}").withColumn(f"known_{x}", F.lit(True)) for x in "ab"]
        alone = left.join(known[0], "model_a", "left").join(known[1], "model_b", "left").filter(~(F.col("model_a") < F.col("model_b")) | F.col("known_a").isNull() | F.col("known_b").isNull())
        firsts = [r["model_a"] for r in left.select("model_a").filter("model_a is not null").distinct().limit(1001).collect()]
        own = F.col("model_a") if len(firsts) > 1000 else F.when(F.col("model_a").isin(firsts), F.col("model_a"))  # a null key is not looked up
        sent = F.broadcast(left.select(F.col("model_a").alias("key_a"), F.col("model_b").alias("key_b"), "structural"))
        met = right.join(sent, (own == F.col("key_a")) & (right["model_b"] == F.col("key_b")), "left").select("model_a", "model_b", "structural", "behavioral")
        both = met.unionByName(alone.select("model_a", "model_b", "structural", F.lit(None).cast("double").alias("behavioral")))
    return both.select(
        "model_a", "model_b", "structural", "behavioral", score.alias("hybrid"), ws.alias("structural_weight"), wb.alias("behavioral_weight")
    )

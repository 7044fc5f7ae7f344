"""Tables behind a comparison dashboard (O-60 to O-64, O-66, O-68)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsim.functions.metrics import weighted_mean
from procsim.models import Models
from procsim.operators.items import KEYS
from procsim.operators.rollup import CATEGORIES

#: The category of each item family.
CATEGORY_OF = {
    "activity_names": "elements", "activity_types": "elements", "event_names": "elements", "event_types": "elements",
    "gateway_names": "elements", "gateway_types": "elements", "seq_flows_str": "flows", "mes_flows_str": "flows",
    "lane_names": "organizational", "lane_with_refs": "organizational", "subprocess_names": "subprocess",
    "subprocess_elemrefs": "subprocess", "subprocess_flows": "subprocess",
}


def rescale_to_100(weights: DataFrame, pin: str | None = None) -> DataFrame:
    """Whole percentages that add up to 100 in each group (O-60).

    ``weights``: group, idx, name, weight, live. Dead names get 0. The pinned name, if live, keeps its value without its fraction, held to 0..100; the other
    live ones share the rest by weight, evenly if all weigh 0. Remainders go to the largest fractions, ties to the
    smaller idx. A pinned name that alone is live keeps its value all the same.
    """
    pinned = F.coalesce(F.col("name") == F.lit(pin), F.lit(False)) & F.col("live")
    rows = weights.withColumns({"pinned": pinned, "free": F.col("live") & ~pinned})
    group = Window.partitionBy("group")
    whole = F.least(F.greatest(F.when(F.col("weight") < 0, F.ceil("weight")).otherwise(F.floor("weight")).cast("double"), F.lit(0.0)), F.lit(100.0))
    rows = rows.withColumns({
        "others": F.sum(F.when(F.col("free"), 1).otherwise(0)).over(group), "sum": F.sum(F.when(F.col("free"), F.col("weight")).otherwise(0.0)).over(group),
        "kept": F.coalesce(F.max(F.when(F.col("pinned"), whole)).over(group), F.lit(0.0)),
    })
    rows = rows.withColumn("rest", 100 - F.col("kept"))
    share = F.when(F.col("sum") > 0, F.try_divide(F.col("weight"), F.col("sum"))).otherwise(F.try_divide(F.lit(1.0), F.col("others")))
    rows = rows.withColumn("exact", F.when(F.col("free"), F.col("rest") * share).otherwise(0.0)).withColumn("down", F.floor(F.round("exact", 9)))
    rows = rows.withColumn("missing", F.col("rest") - F.sum("down").over(group))
    order = Window.partitionBy("group").orderBy(F.col("free").desc(), F.round(F.col("exact") - F.col("down"), 9).desc(), "idx")
    extra = (F.row_number().over(order) <= F.col("missing")) & F.col("free")
    percent = F.when(F.col("pinned"), F.col("kept")).when(F.col("free"), F.col("down") + F.when(extra, 1).otherwise(0)).otherwise(0)
    return rows.select("group", "idx", "name", percent.cast("int").alias("percent"))


def live_categories(rolled: DataFrame) -> DataFrame:
    """``live_<category>``: whether it has a score and, for subprocesses, one is expanded (O-61)."""
    live = {c: F.col(f"high_{c}").isNotNull() for c in CATEGORIES}
    live["subprocess"] = live["subprocess"] & F.col("has_expanded_subprocess")
    return rolled.withColumns({f"live_{c}": x for c, x in live.items()})


def user_overall(rolled: DataFrame, percents: dict[str, float]) -> DataFrame:
    """Overall by given percentages and by equal weights (O-62)."""
    scores = {c: F.col(f"high_{c}") for c in CATEGORIES}
    return rolled.withColumns({
        "user_overall": weighted_mean([(percents[c] / 100, s) for c, s in scores.items()]),
        "equal_overall": weighted_mean([(1.0, s) for s in scores.values()]),
    })


def weighted_contributions(rolled: DataFrame, percents: dict[str, float]) -> DataFrame:
    """Each category's part in the overall score by the given and by equal weights (O-63); a row a pair and category that has a score."""
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("category"), F.col(f"high_{c}").alias("score"), F.lit(percents[c] / 100).alias("weight")) for i, c in enumerate(CATEGORIES)])
    long = rolled.select("model_a", "model_b", F.inline(rows)).filter("score is not null")
    pair = Window.partitionBy("model_a", "model_b")
    used = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(pair)), F.lit(0.0))
    even = 1 / F.count(F.lit(1)).over(pair)
    return long.select("model_a", "model_b", "category", "score", (used * F.col("score")).alias("contribution"), (even * F.col("score")).alias("equal_contribution"))


def element_breakdown(rolled: DataFrame) -> DataFrame:
    """13 rows a pair: family, category, score (0 if absent), presence (O-64)."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("family"), F.lit(CATEGORY_OF[k]).alias("category"), F.when(F.col(f"has_{k}"), F.col(k)).otherwise(0.0).alias("score"), F.col(f"has_{k}").alias("present"))
        for k in KEYS
    ])
    return rolled.select("model_a", "model_b", F.inline(rows))


def behavioral_score(compared: DataFrame, ngram: bool) -> Column:
    """The score in use: that of n-grams or that of whole traces (O-66)."""
    return compared["ngram_score"] if ngram else compared["trace_score"]


def count_elements(models: Models) -> DataFrame:
    """Activities, events, gateways, flows, pools and lanes of each model (O-68)."""
    parts = models.node.select("model_id", F.col("kind").alias("part"))
    parts = parts.unionByName(models.flow.filter("flow_kind <> 'subprocess'").select("model_id", F.concat("flow_kind", F.lit("_flow")).alias("part")))
    parts = parts.unionByName(models.pool.select("model_id", F.lit("pool").alias("part"))).unionByName(models.lane.select("model_id", F.lit("lane").alias("part")))
    wanted = ("activity", "event", "gateway", "sequence_flow", "message_flow", "pool", "lane")
    return parts.groupBy("model_id").agg(*[F.count(F.when(F.col("part") == p, 1)).alias(f"{p}_count") for p in wanted])

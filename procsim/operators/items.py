"""Items: what a model is compared by, as strings in 13 families (O-20 to O-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsim.functions.vocabulary import activity_type
from procsim.models import KNOWN, Models
from procsim.storage import staged

KEYS = (
    "activity_names", "activity_types", "event_names", "event_types", "gateway_names", "gateway_types", "seq_flows_str",
    "mes_flows_str", "lane_names", "lane_with_refs", "subprocess_names", "subprocess_elemrefs", "subprocess_flows",
)


def blank(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def name_or_type() -> Column:
    return F.when(blank("name") != "", F.col("name")).otherwise(blank("type"))


def node_items(models: Models) -> DataFrame:
    """Names and types of all nodes, those inside subprocesses too; a missing name is the item ''."""
    kind = F.when(F.col("kind") == "activity", activity_type(F.col("type"))).otherwise(F.col("type"))
    pairs = F.array(
        F.struct(F.concat("kind", F.lit("_names")).alias("key"), blank("name").alias("item")),
        F.struct(F.concat("kind", F.lit("_types")).alias("key"), blank(kind).alias("item")),
    )
    return models.node.select("model_id", F.inline(pairs))


def looked_up(models: Models) -> DataFrame:
    """``model_id, id, ends, contained``: what an id counts as at a flow's end and inside a lane or subprocess, one row an id.

    At ends: names of activities, events and pools, name or else type of gateways. Inside: name or else type, of gateways the type; pools don't count there.
    An id that several elements share means the first activity, else event, else pool, else gateway, in the order of the document.
    """
    gateway = F.col("kind") == "gateway"
    rank = F.when(F.col("kind") == "activity", 0).when(F.col("kind") == "event", 1).otherwise(3)
    nodes = models.node.select(
        "model_id", "id", F.when(gateway, name_or_type()).otherwise(blank("name")).alias("ends"), F.when(gateway, blank("type")).otherwise(name_or_type()).alias("contained"), rank.alias("rank"), "seq"
    )
    pools = models.pool.select("model_id", F.col("pool_id").alias("id"), blank("name").alias("ends"), F.lit(None).cast("string").alias("contained"), F.lit(2).alias("rank"), "seq")
    place = lambda c: F.struct("rank", "seq", c)
    return nodes.unionByName(pools).groupBy("id", "model_id").agg(
        F.min_by("ends", place("ends")).alias("ends"), F.min_by("contained", F.when(F.col("contained").isNotNull(), place("contained"))).alias("contained")
    )


def with_values(flows: DataFrame, values: DataFrame) -> DataFrame:
    """Add ``source`` and ``target``: the values of the flow's ends, null where an end is unknown."""
    for end in ("source", "target"):
        own = values.select("model_id", F.col("id").alias(f"{end}_ref"), F.col("value").alias(end))
        flows = flows.join(own, ["model_id", f"{end}_ref"], "left")
    return flows


def rank_of(*kinds: str) -> Column:
    """The place of a node's kind in the order in which ids are looked up."""
    rank = F.lit(len(kinds))
    for i, kind in enumerate(kinds):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    return rank


def knows(table: DataFrame, name: str) -> bool:
    """Whether the table itself says what the ids it names count as."""
    return set(KNOWN[name]) <= set(table.columns)


def flow_items(models: Models, values: DataFrame | None) -> DataFrame:
    """``source|target`` of top-level flows, '' for unknown ends."""
    flows = models.flow.filter(F.col("flow_kind").isin("sequence", "message"))
    key = F.when(F.col("flow_kind") == "sequence", "seq_flows_str").otherwise("mes_flows_str")
    ends = flows if knows(flows, "flow") else with_values(flows, values.select("model_id", "id", F.col("ends").alias("value")))
    return ends.select("model_id", key.alias("key"), F.concat(blank("source"), F.lit("|"), blank("target")).alias("item"))


def members(table: DataFrame, name: str, contained: DataFrame | None) -> DataFrame:
    """The members with their ``value``; those without any are left out."""
    own = table if knows(table, name) else table.join(contained, ["model_id", "ref_id"])
    return own.filter("value <> ''")


def lane_items(models: Models, contained: DataFrame | None) -> DataFrame:
    pools = models.pool.select("model_id", "pool_id", blank("name").alias("pool"))
    lanes = models.lane.select("model_id", "pool_id", "lane_id", blank("name").alias("lane"))
    bare = pools.join(lanes.select("model_id", "pool_id"), ["model_id", "pool_id"], "left_anti").filter("pool <> ''")
    groups = lanes.join(pools, ["model_id", "pool_id"])
    named = groups.filter("pool <> '' or lane <> ''")
    refs = groups.join(members(models.lane_member, "lane_member", contained), ["model_id", "pool_id", "lane_id"])
    out = bare.select("model_id", F.lit("lane_names").alias("key"), F.col("pool").alias("item"))
    out = out.unionByName(named.select("model_id", F.lit("lane_names").alias("key"), F.concat("pool", F.lit("|"), "lane").alias("item")))
    return out.unionByName(refs.select("model_id", F.lit("lane_with_refs").alias("key"), F.concat("pool", F.lit("|"), "lane", F.lit("|"), "value").alias("item")))


def subprocess_scopes(models: Models) -> DataFrame:
    """Expanded subprocesses and their scope: the trimmed name, or ``__sp`` and the place among the model's unnamed ones."""
    expanded = models.node.filter((F.col("kind") == "activity") & F.col("type").isin("Subprocess", "EventSubprocess") & F.col("expanded"))
    own = expanded.select("model_id", F.col("id").alias("subprocess_id"), "seq", F.trim(blank("name")).alias("name"))
    order = Window.partitionBy("model_id", F.col("name") == "").orderBy("seq")
    place = (F.row_number().over(order) - 1).cast("string")
    return own.withColumn("scope", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("__sp"), place)))


def subprocess_items(models: Models, values: DataFrame | None) -> DataFrame:
    scopes = subprocess_scopes(models)
    names = scopes.filter("name <> ''").select("model_id", F.lit("subprocess_names").alias("key"), F.col("name").alias("item"))
    own = scopes.select("model_id", "subprocess_id", "scope")
    refs = members(models.subprocess_member, "subprocess_member", values).join(own, ["model_id", "subprocess_id"])
    refs = refs.select("model_id", F.lit("subprocess_elemrefs").alias("key"), F.concat("scope", F.lit("|"), "value").alias("item"))
    flows = models.flow.filter("flow_kind = 'subprocess'").withColumnRenamed("owner", "subprocess_id")
    flows = flows if knows(flows, "flow") else with_values(flows, values.withColumnRenamed("ref_id", "id"))
    flows = flows.filter("source <> '' and target <> ''").join(own, ["model_id", "subprocess_id"])
    flows = flows.select("model_id", F.lit("subprocess_flows").alias("key"), F.concat("scope", F.lit("|"), "source", F.lit("|"), "target").alias("item"))
    return names.unionByName(refs).unionByName(flows)


def extract_items(models: Models) -> DataFrame:
    """``model_id, key, item``: one row for each item of each family; items repeat. What ids stand for is written once, as five joins read it, unless the tables know it."""
    values = contained = None
    if not all(knows(getattr(models, name), name) for name in KNOWN):
        values = staged(looked_up(models), "values")
        contained = values.filter("contained is not null").select("model_id", F.col("id").alias("ref_id"), F.col("contained").alias("value"))
    return node_items(models).unionByName(flow_items(models, values)).unionByName(lane_items(models, contained)).unionByName(subprocess_items(models, contained))


def item_counts(items: DataFrame) -> DataFrame:
    """``model_id, key, item, n``: multisets as counts; they shrink the data before any join."""
    return items.groupBy("model_id", "key", "item").agg(F.count(F.lit(1)).alias("n"))


def index_items(items: DataFrame) -> DataFrame:
    """The k-th occurrence of x in a model's family becomes the string xk, so that a multiset becomes a set (O-24)."""
    copies = item_counts(items).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return copies.select("model_id", "key", F.concat("item", F.col("k").cast("string")).alias("indexed"))

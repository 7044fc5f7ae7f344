"""Model files to relational models (O-01 to O-03, O-16 to O-19e)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsim.models import SCHEMAS, Models
from procsim.sources.parse import parse
from procsim.storage import staged

#: Fixed value: characters of an error that are kept.
ERROR_CHARS = 220
COLUMNS = (
    "model_id string, table string, kind string, id string, name string, type string, parent_subprocess string, expanded boolean, seq long, "
    "flow_kind string, source_ref string, target_ref string, label string, owner string, pool_id string, lane_id string, ref_id string, subprocess_id string"
)


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``model_id, content, sha``: the model files (``.bpmn``, ``.xml``, ``.json``) under a path; the id is the file's path (O-19d)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{bpmn,xml,json,BPMN,XML,JSON}").load(path)
    return found.select(F.col("path").alias("model_id"), "content", F.sha2("content", 256).alias("sha"))


def rows_of(documents: DataFrame) -> DataFrame:
    """Parse ``model_id, content`` (text or bytes) into rows of all tables; a document that fails gives one row of table ``error``."""
    columns = [c.strip().split()[0] for c in COLUMNS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for model, content in zip(batch["model_id"], batch["content"]):
                try:
                    rows = [("model", {}), *parse(model, content if isinstance(content, str) else bytes(content))]
                except Exception as e:  # the document's fault, whatever it is; the others go on
                    rows = [("error", {"label": f"{type(e).__name__}: {e}"[:ERROR_CHARS]})]
                out += [(model, table, *[row.get(c) for c in columns[2:]]) for table, row in rows]
            yield pd.DataFrame(out, columns=columns).astype({"expanded": "boolean", "seq": "Int64"})

    return documents.select("model_id", "content").mapInPandas(run, COLUMNS)


@dataclass
class Loaded:
    """``models``, the ``ids`` of all documents that were read, and per model ``errors``, ``warnings`` and ``crossings`` (flows that cross a subprocess's boundary)."""

    models: Models
    ids: DataFrame
    errors: DataFrame
    warnings: DataFrame
    crossings: DataFrame


def sourced(flows: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Fill sources: a flow starts at the last element (activities, events, gateways, pools, each in document order) that lists it as outgoing (O-16)."""
    last = outgoing.groupBy("model_id", F.col("ref_id").alias("id")).agg(F.max_by(F.col("id"), F.struct("rank", "seq")).alias("found"))
    return flows.join(last, ["model_id", "id"], "left").withColumn("source_ref", F.coalesce("source_ref", "found")).drop("found")


def placed(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Add ``in_s`` and ``in_t``: the subprocesses that hold the flow's ends."""
    held = members.groupBy("model_id", "ref_id").agg(F.max("subprocess_id").alias("sub"))
    flows = flows.join(held.select("model_id", F.col("ref_id").alias("source_ref"), F.col("sub").alias("in_s")), ["model_id", "source_ref"], "left")
    return flows.join(held.select("model_id", F.col("ref_id").alias("target_ref"), F.col("sub").alias("in_t")), ["model_id", "target_ref"], "left")


def finish(rows: DataFrame, strict: bool = False) -> Loaded:
    """Join parsed rows into models (O-16 to O-19).

    Top-level sequence flows with both ends in one subprocess become its own. Flows of diagram-editor documents that cross a subprocess's
    boundary are listed, or with ``strict`` stop the job that reads the flows.
    """

    def of(name: str, schema: str | None = None) -> DataFrame:
        own = rows.filter(F.col("table") == name)
        return own.select(*[c.strip().split()[0] for c in (schema or SCHEMAS[name]).split(",")])

    node, pool, lane = of("node"), of("pool"), of("lane")
    outgoing = of("outgoing", "model_id string, id string, ref_id string, seq long")
    ranks = node.select("model_id", "id", F.when(F.col("kind") == "activity", 0).when(F.col("kind") == "event", 1).otherwise(2).alias("rank"))
    ranks = ranks.unionByName(pool.select("model_id", F.col("pool_id").alias("id"), F.lit(3).alias("rank"))).groupBy("model_id", "id").agg(F.min("rank").alias("rank"))
    flow = sourced(of("flow"), outgoing.join(ranks, ["model_id", "id"]))
    members = of("subprocess_member")
    at = placed(flow, members)
    moves = (F.col("flow_kind") == "sequence") & F.col("in_s").isNotNull() & (F.col("in_s") == F.col("in_t"))
    at = at.withColumn("owner", F.when(moves, F.col("in_s")).otherwise(F.col("owner")))
    at = at.withColumn("flow_kind", F.when(moves, "subprocess").otherwise(F.col("flow_kind")))
    ends = F.coalesce(F.col("source_ref"), F.lit("")) != ""
    editor = ~F.lower(F.element_at(F.split("model_id", r"\."), -1)).isin("xml", "bpmn")
    crosses = (F.col("flow_kind") == "sequence") & editor & ends & F.col("target_ref").isNotNull() & ~F.col("in_s").eqNullSafe(F.col("in_t"))
    text = F.concat(F.lit("Process structure error: flow "), F.coalesce("id", F.lit("")), F.lit(" crosses a subprocess boundary"))
    if strict:
        at = at.withColumn("owner", F.when(crosses, F.raise_error(text)).otherwise(F.col("owner")))
    if not strict:
        at = staged(at.withColumn("crosses", crosses), "flows")
        crosses = F.col("crosses")
    lane_member = of("lane_member", "model_id string, lane_id string, ref_id string").distinct()
    lane_member = lane_member.join(lane.select("model_id", "pool_id", "lane_id"), ["model_id", "lane_id"])
    models = Models(
        node, at.select(*[c.strip().split()[0] for c in SCHEMAS["flow"].split(",")]), pool, lane,
        lane_member.select("model_id", "pool_id", "lane_id", "ref_id"), members,
    )
    said = lambda name: rows.filter(F.col("table") == name).select("model_id", "id", F.col("label").alias("message"))
    return Loaded(models, of("model", "model_id string"), said("error"), said("warning"), at.filter(crosses).select("model_id", "id", "source_ref", "target_ref", text.alias("message")))


def load_models(spark: SparkSession, path: str, strict: bool = False) -> Loaded:
    """All model files under a path, parsed once into a table in the shared folder."""
    return finish(staged(rows_of(scan(spark, path)), "parsed"), strict)


def load_texts(spark: SparkSession, documents: dict[str, str], strict: bool = False) -> Loaded:
    """Models from texts by name; names end as files would."""
    given = spark.createDataFrame(sorted(documents.items()), "model_id string, content string")
    return finish(staged(rows_of(given), "parsed"), strict)


def to_json(models: Models) -> DataFrame:
    """``model_id, document``: each model as one JSON document of its nodes, flows, pools and lanes (O-19b)."""
    parts = {
        "activities": models.node.filter("kind = 'activity'"), "events": models.node.filter("kind = 'event'"), "gateways": models.node.filter("kind = 'gateway'"),
        "sequenceFlows": models.flow.filter("flow_kind = 'sequence'"), "messageFlows": models.flow.filter("flow_kind = 'message'"),
    }
    out = models.node.select("model_id").union(models.pool.select("model_id")).distinct()
    members = models.subprocess_member.groupBy("model_id", F.col("subprocess_id").alias("id")).agg(F.sort_array(F.collect_list("ref_id")).alias("elemRefs"))
    inner = models.flow.filter("flow_kind = 'subprocess'").groupBy("model_id", F.col("owner").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("id", F.col("source_ref").alias("sourceRef"), F.col("target_ref").alias("targetRef"), F.col("label").alias("condition")))).alias("subprocessSequenceFlows")
    )
    for name, table in parts.items():
        if name == "activities":
            table = table.join(members, ["model_id", "id"], "left").join(inner, ["model_id", "id"], "left")
            columns = ["id", "name", "type", "parent_subprocess", "elemRefs", "subprocessSequenceFlows"]
        elif name.endswith("Flows"):
            table = table.select("model_id", F.lit(0).alias("seq"), "id", F.col("source_ref").alias("sourceRef"), F.col("target_ref").alias("targetRef"), F.col("label").alias("condition" if name[0] == "s" else "label"))
            columns = table.columns[2:]
        else:
            columns = ["id", "name", "type", "parent_subprocess"]
        listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
        out = out.join(table.groupBy("model_id").agg(listed.alias(name)), "model_id", "left")
    refs = models.lane_member.groupBy("model_id", "pool_id", "lane_id").agg(F.sort_array(F.collect_list("ref_id")).alias("elemRefs"))
    lanes = models.lane.join(refs, ["model_id", "pool_id", "lane_id"], "left").groupBy("model_id", "pool_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("lane_id").alias("id"), "name", "elemRefs"))), lambda x: x.dropFields("seq")).alias("lanes")
    )
    pools = models.pool.join(lanes, ["model_id", "pool_id"], "left").groupBy("model_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("pool_id").alias("id"), "name", "lanes"))), lambda x: x.dropFields("seq")).alias("pools")
    )
    out = out.join(pools, "model_id", "left")
    order = ("activities", "events", "gateways", "pools", "sequenceFlows", "messageFlows")
    return out.select("model_id", F.to_json(F.struct(*[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in order])).alias("document"))


def different_files(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose files differ in content (O-19e)."""
    of_a, of_b = (documents.select(F.col("model_id").alias(f"model_{x}"), F.col("sha").alias(f"sha_{x}")) for x in "ab")
    return pairs.join(of_a, "model_a").join(of_b, "model_b").filter("sha_a <> sha_b").select("model_a", "model_b")

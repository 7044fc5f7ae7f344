"""The relational form of a corpus of process models."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Tables and their columns. ``kind``: activity, event or gateway; ``expanded``: a subprocess whose content is given;
#: ``seq``: place in the document; ``flow_kind``: sequence, message or subprocess (then ``owner`` is the subprocess).
SCHEMAS = {
    "node": "model_id string, kind string, id string, name string, type string, parent_subprocess string, expanded boolean, seq long",
    "flow": "model_id string, flow_kind string, id string, source_ref string, target_ref string, label string, owner string",
    "pool": "model_id string, pool_id string, name string, seq long",
    "lane": "model_id string, pool_id string, lane_id string, name string, seq long",
    "lane_member": "model_id string, pool_id string, lane_id string, ref_id string",
    "subprocess_member": "model_id string, subprocess_id string, ref_id string",
}
#: Further columns that a table may have: what the ids it names count as, where the table's maker has the elements at hand. Items then take these and look
#: nothing up: at ends of top-level flows the name (of gateways name or else type), inside lanes and subprocesses name or else type (of gateways the type).
KNOWN = {"flow": ("source", "target"), "lane_member": ("value",), "subprocess_member": ("value",)}


@dataclass
class Models:
    """One DataFrame a table; each row belongs to the model ``model_id``."""

    node: DataFrame
    flow: DataFrame
    pool: DataFrame
    lane: DataFrame
    lane_member: DataFrame
    subprocess_member: DataFrame

    def map(self, change) -> "Models":
        return Models(**{f.name: change(f.name, getattr(self, f.name)) for f in fields(self)})

    def union(self, other: "Models") -> "Models":
        return self.map(lambda name, df: df.unionByName(getattr(other, name)))

    def write(self, folder: str) -> None:
        """Store the tables as Parquet, so that later queries prune and push down instead of parsing again."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "Models":
        return cls(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})

    @classmethod
    def of_rows(cls, spark: SparkSession, **rows: list[tuple]) -> "Models":
        """From Python rows; tables not given are empty."""
        return cls(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})

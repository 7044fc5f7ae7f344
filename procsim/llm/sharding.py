"""Sharding by global byte-size prefix sums (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsim.llm.util import expanded, pick, prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in the order of their ids, into contiguous shards of equal bytes.

    A document's size is the UTF-8 length of its text plus 1 (the line end). Totals of ranges
    of ids give every document its global start; the shard is the one of the ``shards`` equal
    targets that holds the document's middle byte, so a shard differs from its target by less
    than one document.

    Returns ``doc_id, size, text_crc32, shard, slot``: slot is the place in the shard, gapless from 0.

    Nulls: a null text has size 1 and CRC 0; null ids come first. Repeated rows are counted, ranged
    once and then dealt out in blocks, so a hot row is no hot task; rows of equal id are ordered by size and
    CRC. An empty table gives an empty result. Columns beside the two are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be >= 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    counted = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(counted, ["doc_id", "size", "text_crc32"], {"rows": "n", "bytes": F.col("size") * F.col("n")}, "shard")
    placed = expanded(placed)
    start = F.col("bytes_before") + F.col("copy") * F.col("size")
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor((2 * start + F.col("size")) * shards / (2 * F.col("bytes_total")))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("copy")).alias("place"),
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )

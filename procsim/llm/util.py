"""Helpers shared by the operators: choice of columns, copies of rows, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsim.storage import staged


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select the named columns under the given names; all others, clashing or not, go."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def expanded(counted: DataFrame, copies: str = "n", number: str = "copy", block: int = 4096) -> DataFrame:
    """A row for each of the ``copies`` (1 or more) that a row stands for, numbered from 0.

    Copies are dealt out in blocks, so that those of a hot row are made by many tasks.
    """
    n, size = F.col(copies), F.lit(block).cast("long")
    blocks = counted.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, size)))
    blocks = blocks.repartition(shuffle_partitions(counted.sparkSession))
    return blocks.withColumn(number, F.explode(F.sequence(F.col("_first"), F.least(n, F.col("_first") + size) - 1))).drop("_first")


def prefix_sums(df: DataFrame, keys: list[str], sums: dict[str, str | Column], name: str) -> DataFrame:
    """Add, for each entry of ``sums``, the total over all rows before this one in the order of ``keys``
    (``<entry>_before``) and the total over all rows (``<entry>_total``).

    Rows are dealt into ranges of the keys; each range's totals (one row a range) give the
    start of the next range, and a window inside the range does the rest, so that no task
    sees more than its range. ``keys`` should be unique; rows that tie in them share a range.
    """
    spark = df.sparkSession
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranged = df.withColumns({k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()})
    ranged = ranged.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, name)
    totals = ranged.groupBy("_range").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}_ahead") for k in sums],
        *[F.sum(f"_{k}").over(every).alias(f"{k}_total") for k in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"_{k}_inside": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in sums})
    # one row a range: as many as there are shuffle partitions
    out = out.join(F.broadcast(totals), "_range")
    out = out.withColumns({f"{k}_before": F.col(f"_{k}_ahead") + F.col(f"_{k}_inside") for k in sums})
    return out.drop("_range", *[f"_{k}_{x}" for k in sums for x in ("ahead", "inside")])

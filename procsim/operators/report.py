"""Analytics over a table of compared pairs (O-70 to O-83)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsim.storage import staged

RUN_SCHEMA = (
    "pair_id string, model_a string, model_b string, size_a int, size_b int, t_semantic double, t_structural double, "
    "t_behavioral double, t_total double, behavioral_timed_out_a string, behavioral_timed_out_b string, error string"
)
STAGES = ("t_semantic", "t_structural", "t_behavioral", "t_total")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table from CSV with a header (O-19c); numbers that can't be read become null (O-81)."""
    strings = ", ".join(f"{c.strip().split()[0]} string" for c in RUN_SCHEMA.split(","))
    raw = spark.read.schema(strings).csv(path, header=True)
    kinds = dict(c.strip().split() for c in RUN_SCHEMA.split(","))
    return raw.select(*[F.expr(f"try_cast({c} as {k})").alias(c) for c, k in kinds.items()])


def with_flags(runs: DataFrame) -> DataFrame:
    """Add ``ok`` (no error) and ``timed_out`` (either side; anything but 'true' is false) (O-70, O-71)."""
    said = lambda c: F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))
    return runs.withColumns({"ok": F.coalesce(F.col("error"), F.lit("")) == "", "timed_out": said("behavioral_timed_out_a") | said("behavioral_timed_out_b")})


def ok_runs(runs: DataFrame) -> DataFrame:
    """The pairs without an error; all numbers but the run's health are about these."""
    return runs.filter(F.coalesce(F.col("error"), F.lit("")) == "")


def times(runs: DataFrame) -> Column:
    """How many pairs a row stands for: its ``pairs`` in a table of counted pairs, else one."""
    return F.col("pairs") if "pairs" in runs.columns else F.lit(1).cast("long")


def run_health(runs: DataFrame) -> DataFrame:
    """Pairs in all, fine, failed and timed out; failed in percent of all, timed out in percent of the fine ones (O-72)."""
    flagged = with_flags(runs)
    count = lambda c: F.coalesce(F.sum(F.when(c, times(runs))), F.lit(0).cast("long"))
    out = flagged.agg(count(F.lit(True)).alias("total"), count(F.col("ok")).alias("fine"), count(~F.col("ok")).alias("failed"), count(F.col("ok") & F.col("timed_out")).alias("timed_out"))
    share = lambda c, of: F.coalesce(F.try_divide(100.0 * F.col(c), F.col(of)), F.lit(0.0)).alias(f"{c}_percent")
    return out.select("*", share("failed", "total"), share("timed_out", "fine"))


def both_sides(runs: DataFrame, *more: str) -> DataFrame:
    """``model, size, pairs`` and the columns ``more``: two rows a pair, of one pass over the pairs; a table counted by model has them already."""
    if "model" in runs.columns:
        return runs.select("model", "size", times(runs).alias("pairs"), *more)
    side = lambda x: F.struct(F.col(f"model_{x}").alias("model"), F.col(f"size_{x}").alias("size"))
    return runs.select(F.inline(F.array(side("a"), side("b"))), times(runs).alias("pairs"), *more)


def model_sizes(runs: DataFrame) -> DataFrame:
    """``model, size``: each model of the fine pairs once, with its least size if rows disagree (O-73)."""
    return both_sides(ok_runs(runs)).groupBy("model").agg(F.min("size").alias("size"))


def ranked_quantiles(values: DataFrame, by: list[str], value: str, points: dict[str, float], times: str | None = None) -> DataFrame:
    """Exact interpolated quantiles ``points`` (name -> share) of ``value`` in each group of ``by``, nulls left out; a row counts ``times`` times.

    Equal values are counted, the counts dealt out in ranges of (group, value) and numbered by prefix sums over the ranges' totals, so that no task
    holds more than its range of a group; of each range only the rows at the wanted ranks go on.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    partitions = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(counts.repartitionByRange(partitions, *by, "v").withColumn("range", F.spark_partition_id()), "quantiles")
    totals = ranged.groupBy(*by, "range").agg(F.sum("n").alias("of_range"))  # a row a group and range
    ahead = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"ahead": F.coalesce(F.sum("of_range").over(ahead), F.lit(0)), "total": F.sum("of_range").over(Window.partitionBy(*by))}).drop("of_range")
    inside = Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(totals), [*by, "range"])
    first = F.col("ahead") + F.col("inside")
    out = []
    for name, share in points.items():
        at = F.lit(share) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda rank: (first <= rank) & (rank < first + F.col("n"))
        out += [F.max(F.when(holds(low), F.col("v"))).alias(f"{name}_low"), F.max(F.when(holds(high), F.col("v"))).alias(f"{name}_high"), F.max(at - low).alias(f"{name}_part")]
    wide = placed.groupBy(*by).agg(*out)
    return wide.select(*by, *[(F.col(f"{p}_low") + (F.col(f"{p}_high") - F.col(f"{p}_low")) * F.col(f"{p}_part")).alias(p) for p in points])


def size_quantiles(sizes: DataFrame) -> DataFrame:
    """Least, median, 95th percentile and greatest size, interpolated (O-74)."""
    return sizes.agg(F.min("size").alias("min_size"), F.percentile("size", 0.5).alias("median_size"), F.percentile("size", 0.95).alias("p95_size"), F.max("size").alias("max_size"))


def stage_statistics(runs: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Median, mean, 95th and 99th percentile, greatest and sum of each stage's numbers (O-75); of the fine pairs, if the table has errors."""
    if "error" in runs.columns:
        runs = ok_runs(runs)
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("t")) for s in stages])
    long = runs.select(F.inline(rows), times(runs).alias("pairs")).filter("t is not null")
    counted = staged(long.groupBy("stage", "t").agg(F.sum("pairs").alias("n")), "counted")
    if "pairs" in runs.columns:
        total = F.sum(F.col("t") * F.col("n"))
        sums = counted.groupBy("stage").agg((total / F.sum("n")).alias("mean_t"), F.max("t").alias("max_t"), total.alias("sum_t"))
    else:  # added up row by row, as means near a tie of the last digit depend on it
        sums = long.groupBy("stage").agg(F.avg("t").alias("mean_t"), F.max("t").alias("max_t"), F.sum("t").alias("sum_t"))
    quantiles = ranked_quantiles(counted, ["stage"], "t", {"median_t": 0.5, "p95_t": 0.95, "p99_t": 0.99}, "n")
    return sums.join(F.broadcast(quantiles), "stage").select("stage", "median_t", "mean_t", "p95_t", "p99_t", "max_t", "sum_t")  # a row a stage


def stage_shares(runs: DataFrame, stages: tuple[str, ...] = STAGES[:-1]) -> DataFrame:
    """Each stage's part, in percent, of the sum of all ``stages`` over the fine pairs (O-76)."""
    sums = ok_runs(runs).agg(*[F.coalesce(F.sum(F.col(s) * times(runs)), F.lit(0.0)).alias(s) for s in stages])
    total = sum((F.col(s) for s in stages), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("sum_t"), F.try_divide(100.0 * F.col(s), total).alias("percent")) for s in stages])
    return sums.select(F.inline(rows))


def size_buckets(runs: DataFrame, time: str = "t_behavioral", width: int = 4, least: int = 30) -> DataFrame:
    """Median and 95th percentile of a time by the larger size, of the fine pairs in buckets of ``width``, right-closed from the least size, with ``least`` pairs or more (O-77, O-78)."""
    sized = ok_runs(runs).groupBy(F.greatest("size_a", "size_b").alias("size_max"), F.col(time).alias("t")).agg(F.sum(times(runs)).alias("pairs"))
    sized = staged(sized, "sized")  # the only pass over the pairs
    low = sized.agg(F.min("size_max").alias("low"))  # one row
    place = F.greatest(F.ceil((F.col("size_max") - F.col("low")) / width), F.lit(1))
    found = sized.crossJoin(F.broadcast(low)).withColumn("bucket", place)
    counts = found.groupBy("bucket", "low").agg(F.sum("pairs").alias("n")).filter(F.col("n") >= least)
    found = counts.join(ranked_quantiles(found, ["bucket"], "t", {"median_t": 0.5, "p95_t": 0.95}, "pairs"), "bucket", "left")
    return found.select("bucket", (F.col("low") + (F.col("bucket") - 0.5) * width).alias("middle"), "median_t", "p95_t", "n")


def per_model(runs: DataFrame, time: str = "t_behavioral") -> DataFrame:
    """Each model's size, mean time and pairs, of the fine pairs, slowest first (O-79)."""
    mean = F.try_divide(F.sum(F.col(time) * F.col("pairs")), F.sum(F.when(F.col(time).isNotNull(), F.col("pairs"))))
    rows = both_sides(ok_runs(runs), time).groupBy("model").agg(F.min("size").alias("size"), mean.alias("mean_t"), F.sum("pairs").alias("pairs"))
    return rows.orderBy(F.desc("mean_t"), "model")


def slowest_model(runs: DataFrame, time: str = "t_behavioral") -> DataFrame:
    return per_model(runs, time).limit(1)


def slowest_pairs(runs: DataFrame, n: int = 10, time: str = "t_total") -> DataFrame:
    """The ``n`` fine pairs of the greatest time, ties by pair_id (O-80)."""
    return ok_runs(runs).filter(F.col(time).isNotNull()).orderBy(F.desc(time), "pair_id").limit(n)


def size_histogram(sizes: DataFrame, bins: int = 30) -> DataFrame:
    """Models in each of ``bins`` equal bins of size, empty bins too (O-82)."""
    sizes = staged(sizes, "sizes")  # read twice
    ends = sizes.agg(F.min("size").alias("low"), F.max("size").alias("high"))  # one row
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col("size") - F.col("low")) * F.lit(float(bins)), F.col("high") - F.col("low")), F.lit(0.0))) + 1, F.lit(bins))
    counts = sizes.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("models"))
    every = sizes.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("models", F.lit(0)).cast("long").alias("models"))

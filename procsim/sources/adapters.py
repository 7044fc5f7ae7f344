"""Stand-in corpora from order and event tables, so that every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsim.models import SCHEMAS, Models
from procsim.storage import staged


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_models(spark: SparkSession, sf_dir: str) -> Models:
    """A model a nation: order lines are activities, orders events, suppliers gateways, the nation is the pool and market segments its lanes.

    Lines of an order are linked in a row, orders of a customer by message flows. Finished orders whose key is divisible by 50 are also subprocesses.

    Orders and lines with their successors are written once, as all tables are made of them: each line is dealt out twice (by part, by order), whatever is read.
    What the ends of flows and the members count as stands in the same rows, so that nothing needs to be looked up by id.
    """
    nation, customer, orders = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    model = F.col("c_nationkey").cast("string").alias("model_id")
    of_order = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(model, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "c_mktsegment")
    later = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    of_order = of_order.withColumns({"next_order": F.lead("o_orderkey").over(later), "next_priority": F.lead("o_orderpriority").over(later)})
    of_order = staged(of_order.drop("o_custkey", "o_orderdate"), "orders", "zstd")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    nested = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 50 == 0)
    slim = of_order.select("model_id", "o_orderkey", nested.alias("nested"))
    lines = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(slim, lines["l_orderkey"] == slim["o_orderkey"]).drop("o_orderkey", "p_partkey")
    row = Window.partitionBy("model_id", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = staged(lines.withColumn("next", F.lead(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_type")).over(row)), "lines", "zstd")
    key = lambda of: F.concat_ws("-", F.lit("L"), "l_orderkey", *[f"{of}{c}" for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    named = lambda of: F.coalesce(f"{of}p_brand", F.lit(""))
    value = lambda of: F.when(named(of) != "", named(of)).otherwise(F.coalesce(f"{of}p_type", F.lit("")))
    lines = lines.withColumns({"id": key(""), "o_orderkey": F.col("l_orderkey")})
    order_id = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    sub_id = F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))
    none, no, zero = F.lit(None).cast("string"), F.lit(False), F.lit(0).cast("long")
    columns = lambda kind, id_, name, type_, parent, expanded, seq: ["model_id", F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"), type_.alias("type"), parent.alias("parent_subprocess"), expanded.alias("expanded"), seq.alias("seq")]
    node = lines.select(*columns("activity", F.col("id"), F.col("p_brand"), F.col("p_type"), F.when(F.col("nested"), sub_id), no, zero))
    node = node.unionByName(of_order.select(*columns("event", order_id, F.col("o_orderpriority"), F.col("o_orderstatus"), none, no, zero)))
    supplier = read(spark, sf_dir, "supplier").withColumn("model_id", F.col("s_nationkey").cast("string"))
    gate = F.element_at(F.array(F.lit("Exclusive"), F.lit("Parallel"), F.lit("Inclusive")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    node = node.unionByName(supplier.select(*columns("gateway", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")), gate, none, no, zero)))
    subs = of_order.filter(nested)
    node = node.unionByName(subs.select(*columns("activity", sub_id, F.when(F.col("o_orderkey") % 100 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("Subprocess"), none, F.lit(True), F.col("o_orderkey"))))
    flow = lines.filter("next is not null").select(
        "model_id", F.when(F.col("nested"), "subprocess").otherwise("sequence").alias("flow_kind"), F.concat(F.lit("F"), F.col("id")).alias("id"),
        F.col("id").alias("source_ref"), key("next.").alias("target_ref"), none.alias("label"), F.when(F.col("nested"), sub_id).alias("owner"),
        *[F.when(F.col("nested"), value(of)).otherwise(named(of)).alias(end) for end, of in (("source", ""), ("target", "next."))],
    )
    ends = [F.coalesce(c, F.lit("")).alias(end) for end, c in (("source", "o_orderpriority"), ("target", "next_priority"))]
    sent = of_order.filter("next_order is not null").select("model_id", order_id.alias("source_ref"), F.concat(F.lit("O"), F.col("next_order").cast("string")).alias("target_ref"), *ends)
    flow = flow.unionByName(sent.select("model_id", F.lit("message").alias("flow_kind"), F.concat(F.lit("M"), "source_ref").alias("id"), "source_ref", "target_ref", none.alias("label"), none.alias("owner"), "source", "target"))
    pool = nation.select(F.col("n_nationkey").cast("string").alias("model_id"), F.lit("N").alias("pool_id"), F.col("n_name").alias("name"), zero.alias("seq"))
    segments = of_order.select("model_id", "c_mktsegment").distinct()
    lane = segments.select("model_id", F.lit("N").alias("pool_id"), F.col("c_mktsegment").alias("lane_id"), F.col("c_mktsegment").alias("name"), zero.alias("seq"))
    event_value = F.when(F.coalesce("o_orderpriority", F.lit("")) != "", F.col("o_orderpriority")).otherwise(F.coalesce("o_orderstatus", F.lit("")))
    member = of_order.select("model_id", F.lit("N").alias("pool_id"), F.col("c_mktsegment").alias("lane_id"), order_id.alias("ref_id"), event_value.alias("value"))
    inside = lines.filter("nested").select("model_id", sub_id.alias("subprocess_id"), F.col("id").alias("ref_id"), value("").alias("value"))
    return Models(node, flow, pool, lane, member, inside)


def customer_models(spark: SparkSession, sf_dir: str) -> Models:
    """A small model a customer, of four kinds by the key: a choice, a parallel part, a parallel part that never joins, a loop.

    Each has a start, a row of one to four tasks A1, A2, ..., two to four branches B1, B2, ... (the loop has none) and an end.
    """
    c = F.col("c_custkey")
    given = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), c.cast("string")).alias("model_id"), (c % 4).alias("kind"), (F.floor(c / 4) % 4 + 1).cast("int").alias("row"), (F.floor(c / 16) % 3 + 2).cast("int").alias("wide")
    ).distinct()
    none, kind = F.lit(None).cast("string"), F.col("kind")
    many = lambda n, build: F.transform(F.sequence(F.lit(1), n), build)
    named = lambda mark: lambda i: F.concat(F.lit(mark), i.cast("string"))
    node = lambda of, key, name, type_: F.struct(F.lit(of).alias("kind"), key.alias("id"), name.alias("name"), F.lit(type_).alias("type") if isinstance(type_, str) else type_.alias("type"))
    task = lambda mark: lambda i: node("activity", named(mark)(i), named(mark)(i), "Task")
    gate = F.when(kind.isin(0, 3), "Exclusive").otherwise("Parallel")
    nodes = F.concat(
        F.array(node("event", F.lit("s"), F.lit("Begin"), "StartNoneEvent"), node("event", F.lit("e"), F.lit("Done"), "EndNoneEvent"), node("gateway", F.lit("g"), F.lit(""), gate)),
        many(F.col("row"), task("A")), F.when(kind < 3, many(F.col("wide"), task("B"))).otherwise(F.array()), F.when(kind < 2, F.array(node("gateway", F.lit("h"), F.lit(""), gate))).otherwise(F.array()),
    )
    edge = lambda s, t: F.struct(s.alias("source_ref"), t.alias("target_ref"))
    last, after = named("A")(F.col("row")), F.when(kind < 2, "h").otherwise("e")
    edges = F.concat(
        F.array(edge(F.lit("s"), F.lit("A1")), edge(last, F.lit("g"))), F.when(F.col("row") > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.col("row"), F.lit(2))), lambda i: edge(named("A")(i - 1), named("A")(i)))).otherwise(F.array()),
        F.when(kind < 3, F.concat(many(F.col("wide"), lambda i: edge(F.lit("g"), named("B")(i))), many(F.col("wide"), lambda i: edge(named("B")(i), after)))).otherwise(F.array(edge(F.lit("g"), F.lit("A1")), edge(F.lit("g"), F.lit("e")))),
        F.when(kind < 2, F.array(edge(F.lit("h"), F.lit("e")))).otherwise(F.array()),
    )
    node = given.select("model_id", F.inline(nodes)).select("model_id", "kind", "id", "name", "type", none.alias("parent_subprocess"), F.lit(False).alias("expanded"), F.lit(0).cast("long").alias("seq"))
    flow = given.select("model_id", F.inline(edges)).select("model_id", F.lit("sequence").alias("flow_kind"), F.concat_ws("-", "source_ref", "target_ref").alias("id"), "source_ref", "target_ref", none.alias("label"), none.alias("owner"))
    return Models.of_rows(spark).union(Models(node, flow, *[spark.createDataFrame([], SCHEMAS[t]) for t in ("pool", "lane", "lane_member", "subprocess_member")]))


def user_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_id, trace``: a model a user, a case a day, its trace the event types in order of time."""
    events = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    cases = events.groupBy(F.col("user_id").cast("string").alias("model_id"), day.alias("day")).agg(steps.alias("steps"))
    return cases.select("model_id", F.transform("steps", lambda s: s["event_type"]).alias("trace"))


def conversation_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_id, trace``: a model a conversation, its one trace the roles by turn."""
    turns = read(spark, sf_dir, "conversations")
    steps = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return turns.groupBy(F.col("conv_id").cast("string").alias("model_id")).agg(F.transform(steps, lambda s: s["role"]).alias("trace"))


def labelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, label, vector``: names with vectors, as an embedding table gives them."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "label", F.col("embedding").alias("vector"))

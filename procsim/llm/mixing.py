"""Mixing sources to target weights (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.llm.util import expanded, pick, prefix_sums
from procsim.storage import staged

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"


def draw(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: list[int], most: float) -> DataFrame:
    """Targets of sources: ``source, source_size`` in, ``source, source_size, target`` out.

    Sources in code point order, null last, take the weights in turn and share all words by
    weight; a target stops at ``most`` times the source's size and the excess goes to the others
    by weight, again and again. That ends where target = min(cap, level * weight), and the
    level follows from prefix sums in the order of cap / weight.
    """
    ordered = sizes.withColumn("last", F.col("source").isNull())
    ordered = prefix_sums(ordered, ["last", "source"], {"index": F.lit(1)}, "mix-order")
    turn = (F.col("index_before") % len(weights)).cast("int")
    weighed = ordered.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long").alias("weight"),
        (F.col("source_size") * most).cast("double").alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = prefix_sums(weighed, ["ratio", "source"], {"caps": "cap", "weights": "weight", "words": "source_size"}, "mix-level")
    level = (F.col("words_total") - F.col("caps_before")) / (F.col("weights_total") - F.col("weights_before"))
    ranked = ranked.withColumn("level", level)
    reached = ranked.filter(F.col("level") <= F.col("ratio")).agg(F.min_by("level", "ratio").alias("at"))
    return ranked.crossJoin(F.broadcast(reached)).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at"), F.lit(0.0)) * F.col("weight")).alias("target")
    )


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_copies(rows: DataFrame, goals: DataFrame, most: int, seed: int) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to ``doc_id, source, size, copy``: floor(rate), and one more if the row's draw is under the fraction."""
    joined = rows.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    lucky = draw(F.col("doc_id"), F.col("source"), F.col("size"), F.col("copy"), seed=seed) < F.col("rate") - F.floor("rate")
    joined = joined.withColumn("rate", rate)
    return joined.withColumn("copies", (F.floor("rate") + F.when(lucky, 1).otherwise(0)).cast("long")).drop("rate")


def mix(docs: DataFrame, weights: list[int] = (1, 2, 3), most: int = 3, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is repeated so that the sources come to their target words.

    A source's repetition rate is target / size. Each document is taken floor(rate) times, and once
    more by a Bernoulli draw with the rate's fraction f as probability: the hash of seed, id, source, size and
    number among equal rows, as a number in [0, 1), is under f. Draws depend on no other document, so
    that a source's taken words spread around its target with the variance f (1 - f) times the sum of squared sizes.

    Returns ``doc_id, source, size, source_size, target, copies, taken``, one row a document.

    Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id is drawn for as an id.
    Documents without words are taken as their draw says and add nothing. A source without words has target 0.
    Repeated rows are counted and then dealt out in blocks, each with a draw of its own. An empty table gives an
    empty result. Columns beside the three are ignored. Reruns give the same result.
    """
    sized = pick(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", words(F.col("text")).alias("size"))
    counted = staged(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    goals = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), list(weights), most)
    taken = with_copies(expanded(counted), goals, most, seed)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[int] = (1, 2, 3), most: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as ``mix`` takes it, all columns as they were.

    Documents stay where they are; only the sources' sizes are gathered. Rows of equal id, source and
    size share one draw here. Nulls, empty texts and tables as in ``mix``; columns may have any names.
    """
    row = F.struct("*")
    held = docs.select(row.alias("row"), docs[id_col].alias("doc_id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), F.lit(0).cast("long").alias("copy"))
    held = staged(held, "mix-documents")
    goals = staged(targets(held.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), most), "mix-goals")
    taken = with_copies(held, goals, most, seed).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.withColumn("times", times).select("row.*")

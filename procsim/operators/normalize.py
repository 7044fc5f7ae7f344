"""Alignment of names: similarity join and greedy one-to-one matching (O-40 to O-45, O-67)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.models import KNOWN, Models
from procsim.storage import staged

SCOPES = ("activity", "event", "gateway", "pool", "lane")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the Levenshtein distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def gram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Dice similarity of the sets of character n-grams of the lower-cased names between blanks."""
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) + 3 - n, F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), F.lower(x), F.lit(" ")), i, n)))
    x, y = grams(a), grams(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def atomic_names(models: Models, inside: bool = False) -> DataFrame:
    """``model_id, scope, name``: distinct names that aren't empty of activities, events, gateways, pools and lanes.

    Nodes inside subprocesses are left out, or with ``inside`` are all there is, in scopes ``<kind>__subprocess``.
    """
    within = F.coalesce(F.col("parent_subprocess"), F.lit("")) != ""
    scope = F.concat("kind", F.lit("__subprocess")) if inside else F.col("kind")
    out = models.node.filter(within if inside else ~within).select("model_id", scope.alias("scope"), "name")
    if not inside:
        out = out.unionByName(models.pool.select("model_id", F.lit("pool").alias("scope"), "name"))
        out = out.unionByName(models.lane.select("model_id", F.lit("lane").alias("scope"), "name"))
    return out.filter("name <> ''").distinct()


def greedy_mapping(candidates: DataFrame, by: list[str], most: int = 4096) -> DataFrame:
    """One-to-one matches of each group: by falling (score, name2, name1), a pair is taken if neither name is yet.

    Groups of up to ``most`` candidates (those over the threshold) are folded in order inside one expression. Larger ones are matched by rounds of joins: what
    is the best of both its names is taken, and all else of those names goes, which takes the same pairs, as the order is total.
    """
    columns = [*by, "score", "name2", "name1"]
    given = staged(candidates.select(*columns), "names")
    sizes = given.groupBy(*by).agg(F.count(F.lit(1)).alias("of_group"))
    small = given.join(sizes.filter(F.col("of_group") <= most), by, "left_semi")
    groups = small.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("score", "name2", "name1")), asc=False).alias("ranked"))

    def step(taken: Column, c: Column) -> Column:
        used = F.exists(taken, lambda t: (t["name1"] == c["name1"]) | (t["name2"] == c["name2"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(c)))

    none = F.slice("ranked", 1, 0)
    out = groups.select(*by, F.inline(F.aggregate("ranked", none, step))).select(*by, "name2", "name1", "score")
    left = given.join(sizes.filter(F.col("of_group") > most), by, "left_semi")
    while not left.isEmpty():
        rank = F.struct("score", "name2", "name1")
        first, second = (left.groupBy(*by, name).agg(F.max(rank).alias("best")).select(*by, "best") for name in ("name1", "name2"))
        taken = staged(first.join(second, [*by, "best"]).select(*by, "best.name2", "best.name1", "best.score"), "taken")
        out = out.unionByName(taken)
        for name in ("name1", "name2"):
            left = left.join(taken.select(*by, name), [*by, name], "left_anti")
        left = staged(left, "names")
    return out


def build_mapping(names1: DataFrame, names2: DataFrame, by: list[str], similarity: Callable[[Column, Column], Column], threshold: float = 0.7) -> DataFrame:
    """Map names of the second side to names of the first (O-40). Both have the columns ``by`` and ``name``; ``similarity`` builds the score."""
    left, right = names1.select(*by, F.col("name").alias("name1")), names2.select(*by, F.col("name").alias("name2"))
    scored = left.join(right, by).withColumn("score", similarity(F.col("name1"), F.col("name2")).cast("double"))
    return greedy_mapping(scored.filter(F.col("score") >= threshold), by)


def embedded(vectors: DataFrame) -> Callable[[DataFrame, DataFrame, list[str], float], DataFrame]:
    """Mapping by precomputed vectors: ``vectors`` has ``name, vector``, a row for each distinct name (O-45)."""

    def build(names1: DataFrame, names2: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
        v1, v2 = (vectors.select(F.col("name").alias(f"name{i}"), F.col("vector").alias(f"vector{i}")) for i in (1, 2))
        left = names1.select(*by, F.col("name").alias("name1")).join(v1, "name1")
        right = names2.select(*by, F.col("name").alias("name2")).join(v2, "name2")
        scored = left.join(right, by).withColumn("score", cosine(F.col("vector1"), F.col("vector2")))
        return greedy_mapping(scored.filter(F.col("score") >= threshold).select(*by, "name1", "name2", "score"), by)

    return build


Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def vectors_of(names: DataFrame, embed: Embed) -> DataFrame:
    """``name, vector`` of the distinct names: ``embed`` gives a vector for each string of a list and sees every distinct name once, in Arrow batches (O-45)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [[float(x) for x in v] for v in embed(batch.column("name").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(vectors, pa.list_(pa.float64()))], names=["name", "vector"])

    return staged(names.select("name").filter("name is not null").distinct().mapInArrow(run, "name string, vector array<double>"), "vectors")


def all_mappings(models: Models, pairs: DataFrame, similarity: Callable[[Column, Column], Column] = gram_similarity, threshold: float = 0.7, embed: Embed | None = None) -> DataFrame:
    """``model_a, model_b, scope, name2, name1, score`` for all scopes of all pairs in one plan (O-42); ``model_a`` gives the words.

    ``embed``, if given, takes the place of ``similarity``: names are compared by the cosine of its vectors.
    """
    names = atomic_names(models).unionByName(atomic_names(models, inside=True))
    by = ["model_a", "model_b", "scope"]
    first = pairs.join(names.withColumnRenamed("model_id", "model_a"), "model_a")
    second = pairs.join(names.withColumnRenamed("model_id", "model_b"), "model_b")
    if embed is not None:
        return embedded(vectors_of(names, embed))(first, second, by, threshold)
    return build_mapping(first, second, by, similarity, threshold)


def apply_mapping(models: Models, mapping: DataFrame) -> Models:
    """The second models of the pairs, renamed into the first ones' words (O-43). Model ids become ``model_a|model_b``."""
    pairs = mapping.select("model_a", "model_b").distinct()
    return rename(models, pairs, mapping)


def rename(models: Models, pairs: DataFrame, mapping: DataFrame) -> Models:
    keyed = pairs.select("model_a", "model_b", F.col("model_b").alias("model_id"))

    def change(name: str, table: DataFrame) -> DataFrame:
        own = table.join(keyed, "model_id")
        if name in ("node", "pool", "lane"):
            inside = F.coalesce(F.col("parent_subprocess"), F.lit("")) != "" if name == "node" else None
            scope = F.when(inside, F.concat("kind", F.lit("__subprocess"))).otherwise(F.col("kind")) if name == "node" else F.lit(name)
            words = mapping.select("model_a", "model_b", "scope", F.col("name2").alias("name"), "name1")
            own = own.withColumn("scope", scope).join(words, ["model_a", "model_b", "scope", "name"], "left").withColumn("name", F.coalesce("name1", "name"))
        return own.withColumn("model_id", F.concat("model_a", F.lit("|"), "model_b")).select(*[c for c in table.columns if c not in KNOWN.get(name, ())])  # those have the old words

    return models.map(change)


def normalize(models: Models, pairs: DataFrame, similarity: Callable[[Column, Column], Column] = gram_similarity, threshold: float = 0.7, embed: Embed | None = None) -> tuple[Models, DataFrame]:
    """Renamed second models (also of pairs without any match) and the mapping (O-44)."""
    mapping = all_mappings(models, pairs, similarity, threshold, embed)
    return rename(models, pairs, mapping), mapping


def mapping_summary(mapping: DataFrame) -> DataFrame:
    """Matches a pair and category; scopes inside subprocesses count with their category (O-67)."""
    category = F.regexp_replace("scope", "__subprocess$", "")
    return mapping.groupBy("model_a", "model_b", category.alias("category")).agg(F.count(F.lit(1)).alias("matches"))

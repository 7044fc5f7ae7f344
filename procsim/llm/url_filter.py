"""URL filters: host rules, then a path-template tree (native DataFrame operations only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsim.llm.util import pick
from procsim.storage import staged

#: (verdict, rule) with rule = host/path; the longest rule that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    url, form = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, form, 1), UPPER, LOWER), F.regexp_extract(url, form, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (ties to the code point order) and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        if said not in ("allow", "block") or "/" not in text:
            raise ValueError(f"not a rule: {said} {text}")
        of_host, _, rest = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments with numbers and identifiers made wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), F.regexp_replace(s, "^[0-9]+", "{n}"))
        .when(s.rlike("[0-9]") & s.rlike(r"^[0-9A-Za-z_-]{6,}(\.[A-Za-z]{1,5})?$"), F.regexp_replace(s, "^[0-9A-Za-z_-]+", "{id}"))
        .otherwise(s),
    )


def template_verdicts(counts: DataFrame, spread: int, z: float, prior: float, purity: float) -> DataFrame:
    """Verdicts of templates: ``host, parts, n, labelled, bad`` in, ``host, parts, template, block`` out.

    The tree is walked down one level at a time, until no row has a further segment. Rows leave the walk
    where they end, and where a single row goes on under a node, which takes its own segments. At a node, children that are many and thin
    (over ``spread`` of them with under two rows each on average) are a variable segment; else children
    whose labelled share of bad rows is within ``z`` standard errors of that of their siblings merge
    into the wildcard branch ``*``. Those clearly under it merge into ``*-``, and those clearly over it into ``*+``, if their
    shares spread no more than chance would have it (chi-squared). A template's share is smoothed by ``prior`` rows at the
    host's share, itself smoothed towards the global share; ``purity`` or more rejects it.
    """
    level = staged(counts.withColumns({"tree": F.lit(""), "more": F.size("parts") > 0}), "url-level")
    deepest = level.agg(F.max(F.size("parts"))).first()[0] or 0
    ended = [level.filter("not more").drop("more")]
    for at in range(1, deepest + 1):
        child = level.filter("more").withColumn("own", F.get(F.col("parts"), F.lit(at - 1)))
        if child.isEmpty():
            break
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        children = child.groupBy("host", "tree", "own").agg(F.count(F.lit(1)).alias("rows"), *sums)
        parents = children.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("rows", "n", "labelled", "bad")])
        rest_n, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide(F.col("all_bad"), F.col("all_labelled"))
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("labelled")) + F.try_divide(F.lit(1), rest_n)))
        off = F.try_divide(F.col("bad"), F.col("labelled")) - F.try_divide(rest_bad, rest_n)
        alike = (F.col("labelled") == 0) | (rest_n == 0) | (F.abs(off) <= z * error)
        children = children.join(parents, ["host", "tree"]).withColumn("side", F.when(alike, "*").when(off < 0, "*-").otherwise("*+"))
        square = F.try_divide(F.col("bad") * F.col("bad"), F.col("labelled"))
        sides = children.groupBy("host", "tree", "side").agg(F.count(F.lit(1)).alias("of_side"), F.sum("labelled").alias("side_labelled"), F.sum("bad").alias("side_bad"), F.sum(square).alias("side_square"))
        share, free = F.try_divide(F.col("side_bad"), F.col("side_labelled")), F.col("of_side") - 1
        spreading = F.try_divide(F.col("side_square") - F.col("side_bad") * share, share * (1 - share))
        even = (share == 0) | (share == 1) | (spreading <= free + z * F.sqrt(2 * free))
        thin = (F.col("kinds") > spread) & (F.col("all_n") < 2 * F.col("kinds"))
        step = F.when(thin, "*").when(F.col("side") == "*", F.when(F.col("kinds") > 1, "*").otherwise(F.col("own")))
        step = step.when((F.col("of_side") > 1) & even, F.col("side")).otherwise(F.col("own"))
        merged = children.join(sides, ["host", "tree", "side"]).select("host", "tree", "own", ((F.col("all_rows") == 1) & F.lit(spread > 0)).alias("alone"), step.alias("step"))
        step = F.when(F.col("alone"), F.array_join(F.slice("parts", at, deepest), "/")).otherwise(F.col("step"))
        level = child.join(merged, ["host", "tree", "own"]).select(
            "host", "parts", "n", "labelled", "bad", F.concat("tree", F.lit("/"), step).alias("tree"), (~F.col("alone") & (F.size("parts") > at)).alias("more")
        )
        level = staged(level, "url-level")
        ended.append(level.filter("not more").drop("more"))
    level = reduce(DataFrame.unionByName, ended)
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    whole = level.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"whole_{c}") for c in ("labelled", "bad")])
    hosts = level.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    trees = level.groupBy("host", "tree").agg(*sums).join(hosts, "host").crossJoin(F.broadcast(whole))
    base = F.when(F.col("whole_labelled") > 0, (F.col("whole_bad") + 1) / (F.col("whole_labelled") + 2)).otherwise(F.lit(0.0))
    of_host = (F.col("host_bad") + prior * base) / (F.col("host_labelled") + prior)
    share = (F.col("bad") + prior * of_host) / (F.col("labelled") + prior)
    trees = trees.select("host", "tree", share.alias("bad_share"), (share >= purity).alias("block"))
    return level.select("host", "parts", "tree").join(trees, ["host", "tree"]).withColumnRenamed("tree", "template")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, spread: int = 20,
                z: float = 2.58, prior: float = 5.0, purity: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge URLs by host rules, and where none fits by the labelled purity of their path template.

    ``labels`` (``doc_id, bad``: 0 or 1, null for unlabelled) label URLs by the document number
    that is the first all-digit segment of the path (an ending such as ``.html`` aside).

    Returns ``page_id, host, path, rule, verdict, template, bad_share``; template and bad_share are those of
    the tree even where a rule decides.

    Nulls: a null URL, or one without ``://``, has empty host and path and the template of the
    empty host. Without any labels all shares are 0, so that only rules block; a label
    repeated for a document counts once, as its largest value. Repeated rows are judged alike. An empty table gives an empty result; further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    base = pick(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("parts", segments(F.col("path")))
    number = F.expr(r"try_cast(regexp_extract(path, '(?:^|/)([0-9]+)(?:[.][A-Za-z]{1,5})?(?:/|$)', 1) AS bigint)")
    marks = pick(labels, number="doc_id", bad="bad").filter("number is not null and bad is not null").groupBy("number").agg(F.max("bad").cast("long").alias("bad"))
    labelled = base.withColumn("number", number).join(marks, "number", "left")
    counts = labelled.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    verdicts = template_verdicts(counts, spread, z, prior, purity)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("block"), "block").otherwise("allow")
    return base.join(verdicts, ["host", "parts"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"), "template", "bad_share"
    )

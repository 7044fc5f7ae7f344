"""All pairs of models block by block: against brute force, and without a row a pair in any shuffle."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from procsim.operators import allpairs, rollup, traces
from procsim.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def draws(models):
    draw = random.Random(5)
    return {m: {f"t{min(draw.randint(0, 60), draw.randint(0, 60))}" for _ in range(draw.randint(1, 15))} for m in models}


@pytest.mark.parametrize("block", [3, 16, 100])
def test_overlaps_of_all_pairs(spark, block, monkeypatch):
    """Hot and rare tokens, models without any, two kinds of tokens in a row."""
    monkeypatch.setattr(allpairs, "ROWS", 20)
    models = [f"m{i}" for i in range(30)]
    one, two = draws(models), {m: {"x"} for m in models[:7]}
    table = lambda sets: spark.createDataFrame(sorted((m, t) for m in sets for t in sets[m]) * 2, "model_id string, token string")
    ids = spark.createDataFrame([(m,) for m in [*models, "zz", models[0], None]], "model_id string")
    got = allpairs.all_overlaps({"one": table(one), "two": table(two)}, ids, block).collect()
    size = lambda a, sets: len(sets.get(a, ()))
    both = lambda a, b, sets: len(sets.get(a, set()) & sets.get(b, set()))
    every = sorted([*models, "zz"])
    want = [(a, b, *[x for s in (one, two) for x in (size(a, s), size(b, s), both(a, b, s))]) for i, a in enumerate(every) for b in every[i + 1 :]]
    assert sorted(map(tuple, got)) == want


def test_slices_of_matches_and_lanes(monkeypatch):
    """Matches and lanes cut anywhere give the same counts."""
    draw = np.random.default_rng(1)
    lists = [[np.unique(draw.integers(0, 40, 12) ** 2 // 30 + (1 << 40)).tolist() if i % 5 else [] for i in range(n)] for n in (23, 17)]
    a, b = (allpairs.Sets(pa.array(x, pa.list_(pa.int64()))) for x in lists)
    want = [[len(set(x) & set(y)) for y in lists[1]] for x in lists[0]]
    assert allpairs.common(a, b).tolist() == want
    monkeypatch.setattr(allpairs, "LANES", 2)
    monkeypatch.setattr(allpairs, "MATCHES", 5)
    assert allpairs.common(a, b).tolist() == want


def test_first_traces_of_all_pairs(spark):
    draw = random.Random(3)
    models = [f"m{i}" for i in range(12)]
    rows = [(m, [draw.choice("aäb") for _ in range(draw.randint(1, 3))]) for m in models for _ in range(6)]
    cases = spark.createDataFrame(rows, "model_id string, trace array<string>")
    ids = cases.select("model_id")
    listed = traces.shared_firsts(cases, rollup.all_pairs(ids)).select("model_a", "model_b", "side", "n", "first_trace").collect()
    for block in (5, None):
        got = allpairs.first_texts(cases.withColumnRenamed("trace", "token"), ids, F.array_join("token", ">"), block).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, listed))


def test_first_traces_in_slices(spark, monkeypatch):
    """More traces than a number has bits, few pairs a message and few matches at a time; models without traces, a null trace and one model alone."""
    draw = random.Random(7)
    rows = [(f"m{i:02}", [draw.choice("aäbcd") for _ in range(draw.randint(0, 3))]) for i in range(14) for _ in range(i * i * 4)]
    cases = spark.createDataFrame(rows, "model_id string, trace array<string>")
    ids = cases.select("model_id").unionByName(spark.createDataFrame([("m00",), ("zz",), (None,)], "model_id string"))
    first = lambda ids, cases=cases, block=5: allpairs.first_texts(cases.withColumnRenamed("trace", "token"), ids, F.array_join("token", ">"), block)
    whole = first(ids)
    assert whole.columns == ["model_a", "model_b", "side", "n", "first"]
    want = sorted(map(tuple, whole.collect()))
    listed = traces.shared_firsts(cases, rollup.all_pairs(ids)).select("model_a", "model_b", "side", "n", "first_trace").collect()
    assert want == sorted(map(tuple, listed)) and want
    assert first(ids.filter("model_id = 'm03'")).count() == 0
    null = spark.createDataFrame([("a", None), ("b", None), ("b", ["x"])], "model_id string, trace array<string>")
    assert sorted(map(tuple, first(null.select("model_id"), null).collect())) == [("a", "b", "1", 1, None), ("a", "b", "2", 2, "x")]
    assert max(r["n"] for r in whole.filter("side = 'both'").select("n").collect()) > allpairs.BITS
    monkeypatch.setattr(allpairs, "CODED", 7)
    monkeypatch.setattr(allpairs, "MATCHES", 40)
    assert sorted(map(tuple, first(ids).collect())) == want


def test_least_places(monkeypatch):
    monkeypatch.setattr(allpairs, "BITS", 2)
    draw = np.random.default_rng(2)
    for most in range(8):
        every = draw.random((50, most)) < 0.6
        pair, at = np.nonzero(every)
        bits = allpairs.held(pair, at, 50, most)
        for of in (True, False):
            want = [next((k for k in range(most) if row[k] == of), most) for row in every]
            assert np.broadcast_to(allpairs.least(bits, most, of), 50).tolist() == want


def test_texts_are_sent_once_a_message(spark, monkeypatch):
    """What Python hands over of a pair is some numbers; ids and texts go once a message."""
    caught = {}

    def tiled(blocks, schema, work):
        caught.update(blocks=[pa.ipc.open_stream(r["payload"]).read_all() for r in blocks.orderBy("key").collect()], work=work)
        return made(blocks, schema, work)

    made = allpairs.tiled
    monkeypatch.setattr(allpairs, "tiled", tiled)
    long = "y" * 200
    cases = spark.createDataFrame([(f"m{i:03}", [long, f"{i % (j + 2)}"]) for i in range(120) for j in range(4)], "model_id string, token array<string>")
    rows = allpairs.first_texts(cases, cases.select("model_id"), F.array_join("token", ">"), 60).count()
    first, second = caught["blocks"]
    sent = sum(b.nbytes for x, y in ((first, first), (first, second), (second, second)) for b in caught["work"](x.combine_chunks(), y.combine_chunks(), x is y))
    assert rows > 120 * 119 // 2 and sent < 24 * rows


@pytest.mark.parametrize("name", ["shared_variants", "ngram_sim_2_recall", "ngram_sim_3_jaccard", "behavioral_active_3", "trace_compare"])
def test_pairs_are_not_shuffled(spark, name):
    """Nothing but projections and lookups stands between the blocks' pairs and the result."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in above for x in ("SortMergeJoin", "ShuffledHashJoin", "CartesianProduct", "NestedLoop", "Aggregate", "Exchange"))


@pytest.mark.parametrize("codes", [1 << 62, 1])
def test_counted_pairs(spark, monkeypatch, codes):
    """Pairs counted by their numbers, by model and not, are those listed; so are the pairs of some numbers."""
    from collections import Counter

    monkeypatch.setattr(allpairs, "CODES", codes)
    models = [f"m{i}" for i in range(30)]
    kinds = {k: spark.createDataFrame(sorted((m, t) for m, ts in draws(models).items() for t in ts if t < most), "model_id string, token string") for k, most in (("p", "t3"), ("q", "t9"))}
    ids = spark.createDataFrame([(m,) for m in models], "model_id string")
    pairs = allpairs.all_overlaps(kinds, ids, 7).collect()
    numbers = ["n1_p", "n2_p", "shared_p", "n1_q", "n2_q", "shared_q"]
    got, want = Counter(), Counter(tuple(r[c] for c in numbers) for r in pairs)
    for r in allpairs.all_overlap_counts(kinds, ids, numbers, block=7).collect():
        got[tuple(r[c] for c in numbers)] += r["pairs"]
    assert got == want
    got = Counter()
    for r in allpairs.all_overlap_counts(kinds, ids, ["n1_p", "shared_p"], True, 7).collect():
        got[tuple(r)[:-1]] += r["pairs"]
    assert got == Counter((r[f"model_{x}"], r[f"n{i}_p"], r[f"n{i}_q"], r["n1_p"], r["shared_p"]) for r in pairs for i, x in enumerate("ab", 1))
    only = [dict(zip(numbers, x)) for x in sorted(want)[::5]]
    assert sorted(map(tuple, allpairs.all_overlaps(kinds, ids, 7, only).collect())) == sorted(tuple(r) for r in pairs if {c: r[c] for c in numbers} in only)


@pytest.mark.parametrize("name", ["report_size_buckets", "report_slowest_model", "report_stage_stats", "report_size_hist", "report_top_pairs", "report_per_model"])
def test_reports_read_counted_pairs(spark, name, monkeypatch):
    """No report has a table of all pairs made; only the slowest pairs are, by their numbers."""
    from procsim.plans import queries

    kept, made = [], queries.all_overlaps
    monkeypatch.setattr(queries, "all_overlaps", lambda *a, only, **k: kept.append(only) or made(*a, only=only, **k))
    monkeypatch.setattr(traces, "all_overlaps", None)
    assert QUERIES[name](spark, FOLDER).count() and len(kept) == (name == "report_top_pairs")


@pytest.mark.parametrize("few", [0, 100_000])
def test_hybrid_of_all_pairs(spark, few):
    """Pairs of either side or both, listed and unlisted models, nulls: the blend of sent rows is that of the full join."""
    s = [("a", "b", 0.5), ("a", "c", None), ("b", "zz", 0.25), ("yy", "a", 1.0), ("c", "a", 0.75), (None, "a", 0.1)]
    b = [("a", "b", 0.1), ("a", "c", 0.2), ("a", "d", 0.3), ("b", "c", 0.4), ("b", "d", None), ("c", "d", 0.6)]
    structural, behavioral = spark.createDataFrame(s, "model_a string, model_b string, overall double"), spark.createDataFrame(b, "model_a string, model_b string, score double")
    among = spark.createDataFrame([(m,) for m in "abcd"], "model_id string")
    of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert of(rollup.hybrid(structural, behavioral, 0.25, among, few)) == of(rollup.hybrid(structural, behavioral, 0.25))


def test_hybrid_looks_up_few(spark):
    """Only pairs whose first model has structural scores have a key to look up; doubles are rounded without text."""
    plan = QUERIES["hybrid_0"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN model_a" in plan.split("Join LeftOuter", 1)[1].split("\n")[0] and "rint" in plan.lower()

"""Exact and approximate search against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procsim.llm.ann import PrefixForest, nearest
from procsim.llm.topk import exact_top_k


@pytest.fixture(scope="module")
def given(spark):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((6, 12))
    vectors = [list(map(float, centres[i % 6] + 0.6 * draw.standard_normal(12))) for i in range(500)]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(i, rows[7][1], 1) for i in range(500, 560)]  # many ties
    odd = [(600, None, 1), (700, [], 1), (None, rows[0][1], 1), (800, [None] * 12, 1), (900, [float("nan")] * 12, 1), (1000, [float("inf")] * 12, 1), (1100, [1.0, 2.0], 1), (1101, [3.0, 4.0], 1), (1200, [0.0] * 12, 1)]
    return rows, spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>, score long").repartition(4)


def best(rows, score, k, every):
    out = {}
    for q, v, _ in rows:
        if q % every == 0:
            found = sorted((-score(v, x), i) for i, x, _ in rows if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [64, 10_000])
def test_exact(given, shard_rows):
    rows, frame = given
    whole = [(i, np.floor(1024 * np.array(v)).astype(np.int64), 0) for i, v, _ in rows] + [(1200, np.zeros(12, np.int64), 0)]
    expected = best(whole, lambda a, b: int(a @ b), 10, 100)
    got = {}
    for r in exact_top_k(frame, F.col("vec_id") % 100 == 0, k=10, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.pop(1100) == [(1101, 3 * 1024 * 1024 + 8 * 1024 * 1024)]
    assert got == expected


def test_recall(given):
    rows, frame = given
    expected = best(rows, lambda a, b: sum(x * y for x, y in zip(a, b)), 20, 20)
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, k=20, shard_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert 1200 not in got and 1100 in got
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in e}) for q, e in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    vectors = {i: v for i, v, _ in rows}
    for q in expected:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and len(got[q]) == 20
        for i, s in got[q]:
            exact = 0.0
            for x, y in zip(vectors[i], vectors[q]):
                exact += x * y
            assert s == exact


def test_nothing(given):
    frame = given[1].limit(0)
    assert exact_top_k(frame, F.col("vec_id") % 100 == 0).count() == 0
    assert nearest(frame, F.col("vec_id") % 20 == 0).count() == 0


def test_huge_components(spark):
    rows = [(0, [3e30, 1.0]), (1, [2e30, 1.0]), (2, [-1e30, 5.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    assert [r["score"] for r in got] == [2**63 - 1, -(2**63)]


def test_scores_beyond_doubles_are_exact(spark):
    """Sums over 2^53 come out to the last digit, and differ where doubles would tie."""
    rows = [(0, [2.0**17, 1.0]), (1, [2.0**22, 0.0]), (2, [2.0**22, 1 / 1024]), (3, [-(2.0**22), -1 / 1024])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2**59 + 1024), (1, 2**59), (3, -(2**59) - 1024)]


def test_many_vectors_of_one_id(spark):
    """Rows of one id count once, with the best score, however many there are."""
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((400, 8))
    rows = [(0, [1.0] * 8)] + [(7 if i < 300 else i, [float(x) for x in v]) for i, v in enumerate(vectors, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    score = {}
    for i, v in rows[1:]:
        s = int((np.floor(1024 * np.array(v))).sum() * 1024)
        score[i] = max(score.get(i, s), s)
    expected = sorted(((-s, i) for i, s in score.items()))[:10]
    for shard_rows in (50, 1000):
        got = exact_top_k(frame, F.col("vec_id") == 0, k=10, shard_rows=shard_rows).orderBy("rank").collect()
        assert [(-r["score"], r["vec_id"]) for r in got] == expected
    near = nearest(frame, F.col("vec_id") == 0, k=10).collect()
    assert len(near) == len({r["vec_id"] for r in near}) == 10


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_and_share_on_embeddings(spread):
    """A quarter of the rows is scored and nine tenths of the nearest are found, with equal and with unequal norms."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, rows = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    rows = rows * np.exp(spread * np.random.default_rng(3).standard_normal(len(rows)))[:, None]
    asked = np.flatnonzero(ids % 20 == 0)
    forest = PrefixForest(ids, rows, 20, 96, 24, 10.0, 0.25, 400, 7)
    q, found, _ = forest.search(ids[asked], rows[asked], np.full(len(asked), np.nan))
    hits = 0
    for n, at in enumerate(asked):
        score = rows @ rows[at]
        score[at] = -np.inf
        hits += len(set(ids[np.argsort(-score)[:20]]) & set(found[q == n]))
    assert hits >= 0.9 * 20 * len(asked)
    assert forest.scored <= 0.25 * len(ids) * len(asked)

"""Nearest neighbours against a scan of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.llm import polytope, queries

SCHEMA = "vec_id long, embedding array<double>, dim int, code long"


def scan(rows, k):
    """{query: [(id, distance)]} over all usable rows; equal ids count once, with their least distance."""
    fine = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in fine:
        if i % 100 == 0:
            best = out.setdefault(i, {})
            for j, x in fine:
                if j != i and len(x) == len(q):
                    d = float(np.sqrt(((x - q) ** 2).sum()))
                    best[j] = min(best.get(j, d), d)
    return {q: sorted(b.items(), key=lambda e: (e[1], e[0]))[:k] for q, b in out.items() if b}


def found(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = {}
    for r in polytope.nearest_neighbours(df, df.where("vec_id % 100 = 0"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=64) for _ in range(120)]
    rows = [(i, v.tolist(), 1, None) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[5].tolist(), 1, 2) for i in range(40)]  # exact copies: ties by id
    rows += [(3000 + 100 * i, rng.normal(size=3).tolist(), 1, 2) for i in range(4)] + [(5000, [1.0], 1, 1), (5001, [-2.0], 1, 1)]
    rows += [(200, None, 1, 1), (300, [0.0] * 64, 1, 1), (400, [None] + [1.0] * 63, 1, 1), (500, [float("nan")] + [1.0] * 63, 1, 1), (600, [float("inf")] * 64, 1, 1), (700, [], 1, 1), (None, [1.0] * 64, 1, 1)]
    return rows + [rows[5], rows[100], rows[100]]


def test_awkward_rows(spark, awkward):
    got, want, every = found(spark, awkward), scan(awkward, 10), scan(awkward, 10**6)
    assert got.keys() == want.keys() and len(got[0]) == 10
    assert [i for i, _ in got[1000]] == [5, *range(1001, 1010)]  # ties by id
    assert [i for i, _ in got[3000]] == [i for i, _ in want[3000]] and len(got[3000]) == 3  # all rows of three components
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    for q in want:
        exact = dict(every[q])
        assert all(d == pytest.approx(exact[i], rel=1e-12) for i, d in got[q]) and got[q] == sorted(got[q], key=lambda e: (e[1], e[0]))


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 2.0], 1, 1), (1, [1.5, 2.0], 1, 1), (2, [9.0, 0.1], 1, 1)]
    assert [i for i, _ in found(spark, rows)[0]] == [1, 2]
    assert found(spark, rows[:1]) == {} and found(spark, []) == {}


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[:2000] = x[0] + rng.normal(size=(2000, 64)) * 0.01  # one cell holds a third of the rows
    rows = [(i, v.tolist(), 1, None) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).astype(float))]
    got, want = found(spark, rows), scan(rows, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert len(got) == 60 and all(len(v) == 10 for v in got.values())
    assert hits / 600 >= 0.95
    exact = {q: dict(v) for q, v in scan(rows, len(rows)).items()}
    assert all(d == pytest.approx(exact[q][i], rel=1e-12) for q, v in got.items() for i, d in v)


def test_a_large_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(polytope, "CELL_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist(), 1, None) for i in range(400)]
    got, want = found(spark, rows), scan(rows, 10)
    assert all(len(got[q]) == 10 for q in want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 36


def test_query_on_the_given_table(spark):
    out = queries.QUERIES["op13_nearest_neighbours"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.groupBy("query_id").agg(F.count("*").alias("n")).where("n <> 10").count() == 0

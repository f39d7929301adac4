"""Neighbours: ties, unequal norms, 64-bit vectors, cells, and recall against brute force."""

import numpy as np
import pytest

from tidewater.llm import neighbours


def truth(ids, x, k=20, every=20):
    """For each query the ids of its k best rows, and their scores: ties to the smaller id."""
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        score = {}
        for v in x[ids == q]:
            for i, s in zip(ids.tolist(), (x * v).sum(axis=1).tolist()):
                if i != q:
                    score[i] = max(score.get(i, -np.inf), s)
        out[q] = sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def found(spark, ids, x, kind="double", **more):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"vec_id long, embedding array<{kind}>")
    out = {}
    for r in sorted(neighbours.nearest(df, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("case", ["norms", "clusters", "plain"])
def test_recall(spark, case):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 24))
    if case == "norms":
        x *= np.exp(rng.normal(size=(4000, 1)))
    if case == "clusters":
        x = 0.2 * x + rng.normal(size=(40, 24))[rng.integers(0, 40, 4000) % rng.integers(1, 40, 4000)]
    ids = rng.permutation(4000)
    got, want = found(spark, ids, x), truth(ids, x)
    assert recall(got, want) >= 0.95
    assert all(len(g) == 20 and g == sorted(g, key=lambda t: (-t[1], t[0])) for g in got.values())
    assert all(abs(s - (x[ids == q][0] * x[ids == i][0]).sum()) < 1e-12 for q, g in got.items() for i, s in g)


def test_ties_go_to_the_smaller_id(spark):
    """Few different components: most scores are equal, over many different vectors."""
    rng = np.random.default_rng(2)
    x, ids = rng.integers(-1, 2, size=(600, 5)).astype(float), rng.permutation(600)
    keep = (x != 0).any(axis=1)
    x, ids = x[keep], ids[keep]
    assert found(spark, ids, x, target=1.0) == truth(ids, x)


def test_cells_and_64_bits(spark, monkeypatch):
    """Small cells give the same rows; 64-bit vectors are not rounded."""
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(500, 6)), np.arange(500)
    want = truth(ids, x)
    whole = found(spark, ids, x, target=1.0)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 7)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 3)
    assert whole == found(spark, ids, x, target=1.0)
    assert recall(whole, want) >= 0.999
    assert max(abs(s - dict(want[q]).get(i, s)) for q, g in whole.items() for i, s in g) < 1e-14


def test_ids_that_repeat_and_long_lists(spark):
    """One id with two vectors counts by its best score; fewer candidates than k are all returned; a vector shared by many."""
    ids = np.array([0, 0, 1, 2, 40, *[100 + 1 + k for k in range(60)]])
    x = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0], [-1.0, 0.5], [3.0, 0.0], *[[0.5, 0.5]] * 60])
    assert found(spark, ids, x) == truth(ids, x)
    assert found(spark, ids[:5], x[:5]) == truth(ids[:5], x[:5])


def test_other_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "a", 2.0), (1, [1.0, 1.0], 2, "b", 3.0)], "vec_id long, embedding array<float>, leaf int, id string, v double")
    assert [tuple(r) for r in neighbours.nearest(df).collect()] == [(0, 1, 1, 1.0)]

import numpy as np
import pytest
from loamgraph.llm import neighbors as N

SCHEMA = "node_id string, model string, dim int, vec binary, updated_at long, id long, similarity double"


def data(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(60, 16))
    x = (centers[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.35).astype("<f4")
    x[5:25] = x[4]  # copies
    rows = [(f"n{i:04}", "m", 16, bytes(v.tobytes()), 1, 1, 0.0) for i, v in enumerate(x)]
    extra = [("n0000", "m", 16, rows[0][3], 9, 1, 0.0), ("bad1", "m", 16, b"123", 1, 1, 0.0), ("bad2", "m", 16, np.full(16, np.nan, "<f4").tobytes(), 1, 1, 0.0), ("bad3", "m", 16, np.zeros(16, "<f4").tobytes(), 1, 1, 0.0), ("bad4", "m", 16, None, 1, 1, 0.0), (None, "m", 16, rows[0][3], 1, 1, 0.0), ("lone", "other", 16, rows[0][3], 1, 1, 0.0)]
    return rows, extra, x.astype(float)


def test_recall_and_order(spark):
    rows, extra, x = data()
    got = N.neighbors(spark.createDataFrame(rows + extra, SCHEMA), 5, list_size=50).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(f"n{i:04}", f"n{j:04}") for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -np.round(s[i], 12)))[:5]}
    mine = {(r.node_id, r.other) for r in got}
    assert len(mine & want) / len(want) >= 0.9
    assert len(got) == len(mine) == 5 * len(x)
    for r in got:
        assert abs(r.similarity - s[int(r.node_id[1:]), int(r.other[1:])]) < 1e-9
    copies = sorted(r.other for r in got if r.node_id == "n0010")
    assert copies == ["n0004", "n0005", "n0006", "n0007", "n0008"]


@pytest.mark.parametrize(("shape", "least"), [("gaussian", -1.0), ("dense third", 0.5), ("mixture", 0.9)])
def test_nothing_is_lost_beyond_the_lists_asked(spark, shape, least):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1600, 24))
    if shape == "dense third":
        x[::3] = rng.normal(size=24) * 2 + x[::3] * 0.3
    if shape == "mixture":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, len(x))] + x * 0.4
    x = x.astype("<f4")
    rows = [(f"n{i:04}", "m", 24, bytes(v.tobytes()), 1, 1, 0.0) for i, v in enumerate(x)]
    got = {(r.node_id, r.other) for r in N.neighbors(spark.createDataFrame(rows, SCHEMA), 5, least, list_size=10).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    assert got == {(f"n{i:04}", f"n{j:04}") for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= least}


def test_groups_and_slices_of_the_rest(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 16)).astype("<f4")
    df = spark.createDataFrame([(f"n{i:04}", "m", 16, bytes(v.tobytes()), 1, 1, 0.0) for i, v in enumerate(x)], SCHEMA)
    whole = {(r.node_id, r.other) for r in N.neighbors(df, 3, list_size=600).collect()}
    monkeypatch.setattr(N, "LEAST_GROUP", 50)
    monkeypatch.setattr(N, "MEMBERS", 150)
    assert {(r.node_id, r.other) for r in N.neighbors(df, 3, list_size=6).collect()} == whole


def test_long_lists_are_cut(spark, monkeypatch):
    rows, extra, _ = data(400, 2)
    df = spark.createDataFrame(rows + extra, SCHEMA)
    whole = {(r.node_id, r.other) for r in N.neighbors(df, 3, 0.8, list_size=100).collect()}
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "QUERIES", 30)
    assert {(r.node_id, r.other) for r in N.neighbors(df, 3, 0.8, list_size=100).collect()} == whole


def test_empty(spark):
    assert N.neighbors(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_bisection_is_balanced():
    x = np.random.default_rng(0).normal(size=(1000, 8)).astype(np.float32)
    c = N.bisect(x, 37)
    assert c.shape == (37, 8) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    ids, s = N.Centroids(c).search(x)
    assert (ids[:, 0] == (x @ c.T).argmax(1)).mean() > 0.97 and (np.diff(s, axis=1) <= 1e-6).all()

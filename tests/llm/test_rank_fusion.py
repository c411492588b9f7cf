import random

import pytest
from loamgraph.llm import rank_fusion as R

NAMES = {"a": 1.0, "b": 1.0, "c": 2.0}
SCHEMA = "query long, item string, a double, b double, c double, at long, v double, bin string, n long"


def brute(rows, weights, q, p):
    """Net flows by all pairs."""
    out = {}
    for query in {r[0] for r in rows}:
        own = {}
        for r in rows:
            if r[0] == query and r[1] is not None and (r[1] not in own or r[5] < own[r[1]][5]):
                own[r[1]] = r
        items, n = sorted(own), len(own)
        flow = dict.fromkeys(items, 0.0)
        for k, w in enumerate(weights.values()):
            v = {i: float("-inf") if own[i][2 + k] is None or own[i][2 + k] != own[i][2 + k] else own[i][2 + k] for i in items}
            pct = {i: sum(v[j] < v[i] for j in items) / max(1, n - 1) for i in items}
            prefer = lambda d: 0.0 if d <= q + 1e-12 else 1.0 if d >= p - 1e-12 else (d - q) / (p - q)
            for i in items:
                flow[i] += w * sum(prefer(pct[i] - pct[j]) - prefer(pct[j] - pct[i]) for j in items if j != i)
        for i in items:
            out[query, i] = flow[i] / max(1, n - 1) / sum(weights.values())
    return out


def rows_of(seed):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, 0.0, -0.0, 1.0, float("nan"), rnd.random(), rnd.random() * 1e6])
    rows = [(q, f"i{k:02}", value(), value(), value(), 5, 0.0, "x", 9) for q in range(4) for k in range(rnd.randint(1, 25))]
    rows += [(*r[:5], 9, *r[6:]) for r in rows[:6]]  # delivered again, later
    return rows + [(None, "i", 1.0, 1.0, 1.0, 1, 0.0, "x", 9), (1, None, 1.0, 1.0, 1.0, 1, 0.0, "x", 9)]


@pytest.mark.parametrize(("q", "p", "large"), [(0.0, 1.0, 100_000), (0.0, 1.0, 3), (0.1, 0.5, 100_000), (0.05, 0.3, 4)])
def test_flows_equal_all_pairs(spark, q, p, large):
    rows = rows_of(int(10 * p) + large)
    got = R.net_flows(spark.createDataFrame(rows, SCHEMA), "query", "item", NAMES, "at", q, p, large).collect()
    want = brute([r for r in rows if r[0] is not None], NAMES, q, p)
    assert {(r.query, r.item) for r in got} == set(want)
    for r in got:
        assert abs(r.flow - want[r.query, r.item]) < 1e-9
        assert abs(r.positive - r.negative - r.flow) < 1e-9


def test_ties_top_and_empty(spark):
    rows = [(1, i, 1.0, 1.0, 1.0, 1, 0.0, "x", 9) for i in "dbca"]
    flows = R.net_flows(spark.createDataFrame(rows, SCHEMA), "query", "item", NAMES)
    assert [r.item for r in R.top(flows, "query", "item", 2).orderBy("place").collect()] == ["a", "b"]
    assert {r.flow for r in flows.collect()} == {0.0}
    assert R.net_flows(spark.createDataFrame([], SCHEMA), "query", "item", NAMES, "at").count() == 0

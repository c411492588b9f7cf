import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from loamgraph.functions.ids import path_form
from loamgraph.llm import cooccurrence as C
from pyspark.sql import functions as F

SCHEMA = "repo string, commit_id string, file string, code long, n long, item string"


def data(seed):
    rnd, rows = random.Random(seed), []
    for repo in ("r", "s"):
        for k in range(120):
            own = set(rnd.choices([f"f{i}" for i in range(80)], k=rnd.randint(0, 4)))
            g = rnd.randrange(12)
            if rnd.random() < 0.5:
                own |= {f"g{g}_{i}" for i in range(3)}
            if k % 9 == 0:
                own |= {f"h{i}" for i in range(30)}
            rows += [(repo, f"c{k}", f.replace("_", "\\") if rnd.random() < 0.2 else f"./{f}".replace("_", "/") if rnd.random() < 0.2 else f.replace("_", "/"), 1, 1, "x") for f in own]
    rows += rows[:40] + [("r", "c1", None, 1, 1, "x"), ("r", "c2", "", 1, 1, "x"), ("r", "c999", "", 1, 1, "x"), (None, "c1", "f1", 1, 1, "x"), ("r", None, "f1", 1, 1, "x")]
    rnd.shuffle(rows)
    return rows


def brute(rows, least, lift, weight):
    commits, repos = defaultdict(set), defaultdict(set)
    for r, c, f, *_ in rows:
        f = (f or "").replace("\\", "/").removeprefix("./")
        if f and r and c:
            commits[r, c].add(f)
            repos[r].add(c)
    alone, both = Counter(), Counter()
    for (r, _), fs in commits.items():
        alone.update((r, f) for f in fs)
        both.update((r, *p) for p in combinations(sorted(fs), 2))
    return {(r, a, b, n) for (r, a, b), n in both.items() if n >= least and n * len(repos[r]) >= lift * alone[r, a] * alone[r, b] and n >= weight * min(alone[r, a], alone[r, b])}


@pytest.mark.parametrize("large", [2000, 6, 2])
def test_counts_whatever_is_large(spark, large):
    rows = data(large)
    got = C.together(spark.createDataFrame(rows, SCHEMA), "repo", "commit_id", path_form(F.col("file")), large=large).collect()
    want = brute(rows, 5, 3, 0.4)
    assert {(r.repo, r.item_a, r.item_b, r.together) for r in got} == want and len(want) == len(got) > 100
    for r in got:
        odds = (r.together + 0.5) * (r.records - r.records_a - r.records_b + r.together + 0.5) / ((r.records_a - r.together + 0.5) * (r.records_b - r.together + 0.5))
        assert abs(r.odds_ratio - odds) < 1e-9 and abs(r.weight_a - r.together / r.records_a) < 1e-12


def test_empty(spark):
    assert C.together(spark.createDataFrame([], SCHEMA), "repo", "commit_id", F.col("file")).count() == 0

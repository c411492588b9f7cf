import random
import re
from itertools import combinations

import pytest
from loamgraph.llm import near_duplicates as N

SCHEMA = "uuid string, title string, description string, updated_at long, id long, key string, tokens string"
RND = random.Random(3)
WORDS = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(500)]


def records():
    out = []
    for k in range(60):
        base = RND.choices(WORDS[:60], k=25) + RND.sample(WORDS[60:], 5)
        for v in range(RND.randint(1, 5)):
            own = list(base)
            for _ in range(v * 3):
                own[RND.randrange(len(own))] = RND.choice(WORDS)
            RND.shuffle(own)
            out.append((f"u{k:02}{v}", own[0].upper(), " ".join(own[1:]) + ".", 5, 1, "k", "t"))
    out += [("copy", out[0][1], out[0][2], 5, 1, "k", "t"), (*out[3][:3], 9, 1, "k", "t"), (None, "a", "b", 1, 1, "k", "t"), ("empty", None, None, 1, 1, "k", "t"), ("short", "one two", "three", 1, 1, "k", "t")]
    return out + [("long1", "Über", "x-1 " + " ".join(f"y{i}" for i in range(3000)), 1, 1, "k", "t"), ("long2", "über", "x-1 " + " ".join(f"y{i}" for i in range(2500)), 1, 1, "k", "t")]


def brute(rows, t, least):
    own = {}
    for r in rows:
        if r[0] is not None and (r[0] not in own or r[3] < own[r[0]][3]):
            own[r[0]] = r
    sets = {u: set(re.findall(r"[^\W_]+", f"{r[1] or ''} {r[2] or ''}".lower())) for u, r in own.items()}
    sets = {u: s for u, s in sets.items() if len(s) >= least}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize(("t", "block", "slice_"), [(0.6, 8192, 65_536), (0.6, 16, 40), (0.85, 8192, 65_536)])
def test_all_pairs_are_found(spark, t, block, slice_):
    rows = records()
    got = N.similar_pairs(spark.createDataFrame(rows, SCHEMA), "uuid", ["title", "description"], t, 12, "updated_at", block, slice_).collect()
    want = brute(rows, t, 12)
    assert {(r.key_a, r.key_b): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) > 5


def test_groups(spark):
    rows = records()
    got = {r.uuid: r for r in N.components(spark.createDataFrame(rows, SCHEMA), "uuid", ["title", "description"], 0.6, 12, "updated_at").collect()}
    label = {u: u for u in got}
    for _ in got:
        for a, b in brute(rows, 0.6, 12):
            label[a] = label[b] = min(label[a], label[b])
    for a, b in combinations(got, 2):
        assert (got[a].group_key == got[b].group_key) == (label[a] == label[b])
    assert got["copy"].links == got["u000"].links


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.similar_pairs(df, "uuid", ["title", "description"]).count() == 0


def test_very_long_texts_are_compared(spark):
    rows = [(u, None, " ".join(f"y{i}" for i in range(n)), 1, 1, "k", "t") for u, n in (("a", 40_000), ("b", 39_000))]
    found = N.similar_pairs(spark.createDataFrame(rows, SCHEMA), "uuid", ["title", "description"], 0.6, 12, "updated_at").collect()
    assert [(r.key_a, r.key_b, r.similarity) for r in found] == [("a", "b", 0.975)]


def test_parts_of_large_classes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 3)
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(f"a{i:02}", "t", text, 1, 1, "k", "t") for i in range(11)] + [(f"b{i:02}", "t", text + " more", 1, 1, "k", "t") for i in range(7)]
    got = {(r.key_a, r.key_b) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA), "uuid", ["title", "description"], 0.6, 12, "updated_at").collect()}
    assert got == set(combinations(sorted(r[0] for r in rows), 2))

import pytest
from loamgraph.operators import alike, lifecycle
from pyspark.sql import functions as F
from test_knowledge import entry, know, links

WORDS = "cache lock queue reads fails often after restart under load".split()


def few_words(spark, count=60):
    """Entries of ten words, some of them repeated; a list of more words than have a closer bound; tags with nulls."""
    rows = [entry(f"{i:03}", " ".join(WORDS[(i * k + k // 3) % 10] for k in range(1, 6)), "ab"[i % 2], " ".join(WORDS[(i + k * k) % 7] for k in range(9)), tags=[["x"], ["x", None], []][i % 3], scope="pq"[i % 5 // 3]) for i in range(count)]
    long = [entry(f"long{i}", " ".join([*(f"w{k}" for k in range(90)), WORDS[i]]), "a", "reads") for i in range(3)]
    return know(spark, *rows, *long)


def test_no_row_is_made_of_a_candidate(spark, monkeypatch):
    written = []
    for module in (alike, lifecycle):
        monkeypatch.setattr(module, "cut", lambda df, own=module.cut: written.append((out := own(df)).count()) or out)
    k = few_words(spark)
    found = lifecycle.similar_entries(k, 0.6)
    plan = found._jdf.queryExecution().toString()
    assert sum(written) < k.count() and "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("blocks", [(), ("scope", "knowledge_type")])
def test_chunks_meet_as_all_pairs_do(spark, monkeypatch, blocks):
    monkeypatch.setattr(alike, "CHUNK", 16)
    k = few_words(spark)
    own = lifecycle._features(k)
    every = own.alias("a").join(own.alias("b"), F.expr("a.uuid < b.uuid")).where(" AND ".join(["true", *(f"a.{b} = b.{b}" for b in blocks)])).select("a.uuid", F.col("b.uuid").alias("v"), lifecycle._likeness("a", "b").alias("s")).collect()
    for least in (0.35, 0.6, 0.8):
        got = {(r.uuid_a, r.uuid_b): r.similarity for r in lifecycle.similar_entries(k, least, blocks).collect()}
        assert got == {(r.uuid, r.v): r.s for r in every if r.s >= least} and got


def test_new_entries_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(alike, "CHUNK", 16)
    k = few_words(spark).withColumn("status", F.when(F.substring("uuid", -1, 1).isin("0", "4"), "tentative").otherwise(F.when(F.substring("uuid", -1, 1) == "7", "obsolete").otherwise("active")))
    rows = k.collect()
    words = lambda text: {w for w in text.lower().split() if len(w) > 2}
    share = lambda a, b: len(a & b) / max(len(a), len(b), 1)
    best = {}
    for a in rows:
        if a.status == "tentative":
            scored = [(-round(0.5 * share(words(a.title), words(b.title)) + 0.3 * share(words(a.description), words(b.description)) + 0.2 * share({*a.tags} - {None}, {*b.tags} - {None}) + 0.1 * (a.knowledge_type == b.knowledge_type), 9), b.uuid) for b in rows if b.status != "obsolete" and b.uuid != a.uuid]
            best |= {(a.uuid, u): (-s, n + 1) for n, (s, u) in enumerate(sorted(x for x in scored if x[0] <= -0.5)[:3])}
    linked = next(iter(best))
    got = {(r.knowledge_uuid, r.node_uuid): (round(r.score, 9), r.place) for r in lifecycle.auto_link_entries(k, links(spark, (*linked, "r", True)), k.where("status = 'tentative'")).collect()}
    assert got == {p: x for p, x in best.items() if p != linked} and got


def test_no_row_is_made_of_a_new_entrys_candidate(spark):
    k = few_words(spark)
    plan = lifecycle.auto_link_entries(k, links(spark, ("000", "x", "r", True)), k.where("knowledge_type = 'a'"))._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan

import pytest
from loamgraph.operators import chunking, diffing, identity, lifecycle, prefix, recall, search
from loamgraph.plans import knowledge_queries
from pyspark.sql import functions as F

NOW = 1_775_000_000
DAY = 86_400
K = "uuid string, title string, knowledge_type string, description string, confidence double, observations int, tags array<string>, scope string, status string, last_validated_at long, applies_when string, superseded_by string, evidence string, created_at long, updated_at long, fetch_count int, last_fetched long"
L = "knowledge_uuid string, node_uuid string, relation string, is_knowledge boolean, linked_body_hash string, linked_logical_key string, created_at long"


def entry(uuid, title="t", kind="pattern", description="", confidence=0.6, observations=1, tags=(), scope="", status="active", validated=0, applies="", by="", evidence="", created=NOW, updated=NOW, fetched=0, last=0):
    return (uuid, title, kind, description, confidence, observations, list(tags), scope, status, validated, applies, by, evidence, created, updated, fetched, last)


def know(spark, *rows):
    return spark.createDataFrame(list(rows), K)


def links(spark, *rows):
    return spark.createDataFrame([(a, b, r, k, h, "", 1) for a, b, r, k, h in ((*x, False, "")[:5] if len(x) == 3 else (*x, "")[:5] for x in rows)], L)


def test_keyword_recall(spark):
    k = know(spark, entry("1", "Singleton", "pattern"), entry("2", "Error Handling", "convention"), entry("3", "JWT Auth", "decision", tags=["security"]))
    ids = lambda df: [r.uuid for r in df.orderBy(F.col("score").desc(), "uuid").collect()]
    assert len(ids(recall.recall(k, ""))) == 3 and ids(recall.recall(k, "", "pattern")) == ["1"] and ids(recall.recall(k, "auth")) == ["3"]
    assert ids(recall.recall(k, "wt")) == ["3"] and ids(recall.recall(k, "andlin")) == ["2"] and ids(recall.recall(k, "zzz")) == []


def test_recency_counts(spark):
    k = know(spark, entry("new"), entry("old", created=NOW - 200 * DAY, updated=NOW - 200 * DAY))
    s = {r.uuid: r.total for r in recall.task_scores(k, links(spark, ("x", "y", "r")), "", [], k.select("uuid").limit(0), NOW).collect()}
    assert s["new"] - s["old"] >= 15


@pytest.mark.parametrize(("relation", "sign"), [("supports", 1), ("contradicts", -1), ("supersedes", -1)])
def test_reasoning(spark, relation, sign):
    k = know(spark, entry("a", confidence=0.9), entry("b"))
    rows = recall.propagate(k, links(spark, ("a", "b", relation, True)), know(spark, entry("a")).select("uuid")).collect()
    assert [r.uuid for r in rows] == ["b"] and rows[0].adjustment * sign > 0 and abs(rows[0].adjustment) <= 0.3


def test_diversity_drops_near_titles(spark):
    rows = [("a", "cache grows on read", 9.0), ("b", "cache grows on write", 8.0), ("c", "other thing here", 7.0), ("d", "cache grows on read", 6.0)]
    out = recall.diverse(spark.createDataFrame(rows, "uuid string, title string, total double"), 3)
    assert [r.uuid for r in out.orderBy("place").collect()] == ["a", "c"]


def test_similar_entries_meets_all_pairs(spark):
    words = "cache lock queue reads fails often after restart under load when idle peers leave".split()
    rows = [entry(f"{i:02}", " ".join(words[(i * k) % 14] for k in range(1, 5)), "ab"[i % 2], " ".join(words[(i + k * k) % 14] for k in range(9)), tags=["x"] if i % 3 else []) for i in range(30)]
    k = know(spark, *rows)
    own = lifecycle._features(k)
    every = own.alias("a").join(own.alias("b"), F.expr("a.uuid < b.uuid")).select("a.uuid", F.col("b.uuid").alias("v"), lifecycle._likeness("a", "b").alias("s")).collect()
    for least in (0.4, 0.6):
        got = {(r.uuid_a, r.uuid_b): round(r.similarity, 9) for r in lifecycle.similar_entries(k, least).collect()}
        assert got == {(r.uuid, r.v): round(r.s, 9) for r in every if r.s >= least} and got
    with pytest.raises(ValueError, match="above"):
        lifecycle.similar_entries(k, 0.3)


def test_stale(spark):
    k = know(spark, entry("gone", confidence=0.5), entry("half"), entry("drift"), entry("aged", validated=NOW - 100 * DAY), entry("idle", created=NOW - 95 * DAY), entry("fine"), entry("done", status="obsolete"))
    n = spark.createDataFrame([("u1", "h1"), ("u2", "h2")], "uuid string, body_hash string")
    l = links(spark, ("gone", "x", "r"), ("half", "x", "r"), ("half", "y", "r"), ("half", "u1", "r"), ("drift", "u1", "r", False, "old"), ("idle", "u1", "r"), ("fine", "u2", "r", False, "h2"), ("done", "x", "r"))  # noqa: E741
    got = {r.uuid: (r.reason, round(r.staleness, 6), r.new_status, round(r.new_confidence, 6)) for r in lifecycle.stale(k, l, n, NOW).collect()}
    assert got == {"gone": ("all nodes gone", 1.0, "needs_review", 0.45), "half": ("nodes gone", round(0.7 * 2 / 3, 6), "needs_review", 0.57), "drift": ("bodies changed", 0.5, "needs_review", 0.57), "aged": ("not validated", 0.3, "needs_review", 0.6), "idle": ("not retrieved", 0.4, "needs_review", 0.6)}


def test_merge(spark):
    k = know(spark, entry("a", "Repository Pattern", description="x", tags=["p"], scope="repo"), entry("b", "Repository Pattern Design", description="y", tags=["p", "q"], scope="file", observations=2), entry("c"))
    l = links(spark, ("a", "n1", "r"), ("b", "n1", "r"), ("b", "n2", "r"), ("c", "b", "supports", True), ("b", "a", "related_to", True))  # noqa: E741
    pairs = spark.createDataFrame([("a", "b")], "keep string, absorb string")
    entries, out = lifecycle.merge(k, l, pairs, NOW)
    e = {r.uuid: r for r in entries.collect()}
    assert (e["a"].observations, e["a"].tags, e["a"].scope, e["a"].description) == (3, ["p", "q"], "file", "x\n---\ny") and abs(e["a"].confidence - (1 - 0.4 * 0.64)) < 1e-9
    assert (e["b"].status, e["b"].superseded_by, e["c"].status) == ("obsolete", "a", "active")
    assert {tuple(r)[:3] for r in out.collect()} == {("a", "n1", "r"), ("a", "n2", "r"), ("c", "a", "supports"), ("a", "b", "supersedes")}


def test_changes_of_entries(spark):
    k = know(spark, entry("a", evidence=""), entry("b", confidence=0.97))
    one = lambda df, u="a": {r.uuid: r for r in df.collect()}[u]
    news = spark.createDataFrame([("a", "t", "pattern", "more", ["z"]), ("n", "new", "bug_pattern", "d" * 3000, [])], "uuid string, title string, knowledge_type string, description string, tags array<string>")
    learnt = lifecycle.learn(k, news, NOW)
    assert one(learnt).observations == 2 and abs(one(learnt).confidence - 0.68) < 1e-9 and one(learnt, "n").confidence == 0.6 and len(one(learnt, "n").description) == 2000
    both = k.select("uuid")
    assert one(lifecycle.record_fetch(k, both, NOW), "b").confidence == 0.95 and one(lifecycle.record_fetch(k, both, NOW)).fetch_count == 1
    s = one(lifecycle.supersede(k, spark.createDataFrame([("b", "a")], "uuid string, superseded string"), NOW))
    assert (s.status, s.superseded_by, round(s.confidence, 6)) == ("obsolete", "b", 0.42)
    assert one(lifecycle.validate(k, both.where("uuid = 'a'"), NOW, "seen")).evidence == "seen" and one(lifecycle.mark_obsolete(k, both, NOW)).status == "obsolete"
    assert one(lifecycle.set_evidence(k, {"a": "e"})).evidence == "e"
    l = links(spark, ("a", "b", "supports", True))  # noqa: E741
    more = lifecycle.add_links(l, k, spark.createDataFrame([("a", "b", "supports"), ("a", "zz", "supports")], "knowledge_uuid string, node_uuid string, relation string"))
    assert {tuple(r)[:3] for r in more.select("knowledge_uuid", "node_uuid", "relation").collect()} == {("a", "b", "supports"), ("b", "a", "supported_by")}
    assert lifecycle.remove_links(more, l).count() == 1
    assert [lifecycle.forget(k, l, **t)[0].count() for t in ({"title": "t", "kind": "pattern"}, {"kind": "x"}, {}, {"below": 0.7})] == [0, 2, 2, 1]


def test_thought_chain(spark):
    k = know(spark, entry("a"), entry("b"), entry("c"))
    l = links(spark, ("a", "b", "leads_to", True), ("b", "c", "because", True), ("c", "x", "supports", True))  # noqa: E741
    for start in "abc":
        assert [(r.uuid, r.relation_to_next) for r in lifecycle.thought_chain(k, l, start).orderBy("step").collect()] == [("a", "leads_to"), ("b", "because"), ("c", None)]


def test_long_thought_chain_keeps_its_tail(spark):
    names = [f"t{i:03}" for i in range(206)]
    l = links(spark, *((a, b, "leads_to", True) for a, b in zip(names, names[1:], strict=False)))  # noqa: E741
    assert [r.uuid for r in lifecycle.thought_chain(know(spark, entry("t000")), l, "t003").orderBy("step").collect()] == names


def test_diff(spark):
    text = "--- a/auth.py\n+++ b/auth.py\n@@ -10,3 +10,5 @@\n+x\n@@ -1 +1,3 @@\n"
    h = diffing.hunks(diffing.diffs_of(spark, [text])).orderBy("start_line")
    assert [(r.file, r.start_line, r.end_line, r.old_start_line, r.old_end_line) for r in h.collect()] == [("auth.py", 1, 3, 1, 1), ("auth.py", 10, 14, 10, 12)]
    n = spark.createDataFrame([("a", "UA", "src/auth.py", "L10"), ("b", "ub", "src/auth.py", "L20"), ("c", "uc", "src/other.py", "L10")], "id string, uuid string, source_file string, source_location string")
    touched = diffing.touched_nodes(h, n)
    assert [r.uuid for r in touched.collect()] == ["ua"]
    assert [r.uuid for r in diffing.affected_entries(touched, links(spark, ("k", "ua", "r"), ("k2", "ub", "r"))).collect()] == ["k"]


def test_identity(spark):
    s = "id string, label string, file_type string, source_file string, source_location string, fingerprint string, body_hash string"
    old = spark.createDataFrame([("a", "alpha", "code", "f/a.py", "L10", "fp1", "h1", "u1"), ("b", "beta", "code", "f/b.py", "L10", None, "h2", "u2")], s + ", uuid string")
    new = spark.createDataFrame([("x", "renamed", "code", "g/z.py", "L99", "fp1", "h1"), ("b", "beta", "code", "f/b.py", "L12", None, "h9"), ("m", "beta", "code", "moved/b.py", "L10", None, "h2"), ("n", "brand", "document", "q/n.md", "L1", None, None)], s)
    got = {r.id: (r.uuid, r.how) for r in identity.assign(old, new).collect()}
    assert got["x"] == ("u1", "fingerprint") and got["b"] == ("u2", "id") and got["m"] == ("u2", "score") and got["n"][1] == "new"


@pytest.mark.parametrize(("old", "new", "ok"), [(100, 10, False), (20, 1, True), (50, 0, True), (100, 50, True), (100, 49, False), (51, 25, False)])
def test_shrink_guard(old, new, ok):
    assert identity.may_shrink(old, new) is ok and identity.may_shrink(old, new, True)


@pytest.mark.parametrize(("lines", "spans"), [(20, [(1, 20)]), (120, [(1, 50), (46, 95), (91, 120)]), (50, [(1, 50)]), (51, [(1, 50), (46, 51)])])
def test_windows(spark, lines, spans):
    df = spark.createDataFrame([("a.yaml", "\n".join(f"k{i}: v" for i in range(lines)) + "\n"), ("b.md", "  \n \n"), ("c.md", None)], "file_path string, content string")
    w = chunking.windows(df)
    assert [(r.start_line, r.end_line) for r in w.orderBy("start_line").collect()] == spans and w.first().language == "yaml"
    n = spark.createDataFrame([("n10", "a.yaml", "L10"), ("n60", "a.yaml", "L60")], "id string, source_file string, source_location string")
    first = chunking.first_nodes(w.withColumn("id", F.col("start_line").cast("string")), n)
    assert {r.id: r.node_id for r in first.collect()} == ({"1": "n10", "46": "n60"} if lines == 120 else {"1": "n10"})


def test_vectors(spark):
    rows = [("x", 2, search.pack([1, 0])), ("y", 2, search.pack([0, 2])), ("d", 2, search.pack([1, 1])), ("bad", 2, b"1234567"), ("no", 2, None)]
    v = search.unpack(spark.createDataFrame(rows, "id string, dim int, vec binary"))
    assert [(r.id, round(r.similarity, 6)) for r in search.nearest(v, [1.0, 0.0], 3).collect()] == [("x", 1.0), ("d", 0.707107), ("y", 0.0)]
    odd = [0.0, -0.0, 1.5, -3.25, 1e-42, 123456.789, float("inf")]
    out = spark.createDataFrame([(search.pack(odd), len(odd))], "vec binary, dim int").select(search.floats(F.col("vec"), F.col("dim")).alias("v")).first().v
    assert [round(x, 3) for x in out[:6]] == [0.0, 0.0, 1.5, -3.25, 0.0, 123456.789] and out[6] != out[6]


def test_prefix_sums_and_numbers(spark):
    rows = [(k % 3, k // 10, k, 1 + k % 4) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, bin int, o int, w int")
    got = {r.o: r.s for r in prefix.prefix_sums(df, ["g"], "bin", ["o"], {"s": F.col("w")}).collect()}
    assert got == {k: sum(w for g, _, o, w in rows if g == k % 3 and o < k) for k in range(100)}
    assert sorted(r.n for r in prefix.dense_ids(df.repartition(7), "n").collect()) == list(range(100))


def test_recommendations_and_review(spark):
    k = know(spark, entry("a", "A", "bug_pattern", status="active"), entry("b", "B", "convention", confidence=0.9), entry("c", "C", "tech_debt"))
    assert {(r.knowledge_uuid, r.action, r.priority) for r in recall.recommendations(k, "review").collect()} == {("a", "Watch for: A", 9), ("a", "Add test for: A", 8), ("b", "Follow: B", 9)}
    old = know(spark, entry("s", created=NOW - 99 * DAY))
    n = spark.createDataFrame([("u1", "h")], "uuid string, body_hash string")
    l = links(spark, ("s", "u1", "r"))  # noqa: E741
    assert [(r.knowledge_uuid, r.priority) for r in lifecycle.review_queue(old, l, n, NOW).collect()] == [("s", 7)]
    pending = spark.createDataFrame([("s", False)], "knowledge_uuid string, completed boolean")
    assert lifecycle.review_queue(old, l, n, NOW, pending).count() == 0


def test_chunk_nodes_of_long_files(spark, monkeypatch):
    rows = [("a", "f.py", "L3"), ("b", "f.py", "L1203"), ("c", "g.py", "L50"), ("d", "g.py", None), ("e", "h.py", None)]
    monkeypatch.setattr(knowledge_queries.R, "nodes", lambda *_: spark.createDataFrame(rows, "id string, source_file string, source_location string"))
    assert {tuple(r) for r in knowledge_queries.chunk_nodes(spark, "").collect()} == {("f.py:0", "a"), ("f.py:26", "b"), ("g.py:0", "c"), ("g.py:1", "c")}


def test_duplicates_leave_obsolete_out_and_say_why(spark):
    rows = [("a", "Cache lock order", "decision", "take the cache lock first", "active"), ("b", "cache lock order", "ops", "take the cache lock first", "active"), ("c", "cache lock order", "decision", "take the cache lock first", "obsolete"), ("d", "cache lock order now", "decision", "take the cache lock first", "active")]
    k = spark.createDataFrame([(*r, ["t"]) for r in rows], "uuid string, title string, knowledge_type string, description string, status string, tags array<string>")
    got = {(r.uuid_a, r.uuid_b): r.reason for r in lifecycle.duplicates(k, 0.6).collect()}
    assert got == {("a", "b"): "identical title", ("a", "d"): "similar content (90%), same type", ("b", "d"): "similar content (70%)"}
    assert lifecycle.duplicates(k.limit(0)).count() == 0

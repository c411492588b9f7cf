import warnings

import pytest
from pyspark.sql import functions as F
from loamgraph.operators import analyze, community, extract, graph
from loamgraph.plans import graph_queries
from loamgraph.sources import relations

NODE = "id string, label string, file_type string, source_file string, source_location string, community long, uuid string, body_hash string"


def nodes(spark, rows):
    full = [(r[0], r[1] if len(r) > 1 else r[0], "code", r[2] if len(r) > 2 else "src/mod.rs", "L1", r[3] if len(r) > 3 else 0, f"u-{r[0]}", None) for r in rows]
    return spark.createDataFrame(full, NODE)


def edges(spark, rows):
    full = [(a, b, rel, conf, "f", None, 1.0) for a, b, rel, conf in ((*r, "EXTRACTED")[:4] if len(r) == 3 else (*r, "calls", "EXTRACTED") if len(r) == 2 else r for r in rows)]
    return spark.createDataFrame(full, "source string, target string, relation string, confidence string, source_file string, source_location string, weight double")


@pytest.fixture
def calls(spark):
    return nodes(spark, [("a",), ("b",), ("c",), ("d",)]), edges(spark, [("a", "b"), ("b", "c"), ("d", "b")])


def test_callers_callees_and_paths(spark, calls):
    n, e = calls
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(graph.callers(n, e, ["c"], 1)) == {"b"} and ids(graph.callers(n, e, ["c"], 2)) == {"a", "b", "d"}
    assert ids(graph.callers(n, e, ["a"], 1, callees=True)) == {"b"} and ids(graph.callers(n, e, ["a"], 2, callees=True)) == {"b", "c"}
    assert [(r.target, r.length, r.path) for r in graph.shortest_paths(e, ["a"], ["c"], 5).collect()] == [("c", 2, "a > b > c")]
    assert graph.shortest_paths(e, ["c"], ["a"], 5).count() == 0


def test_cycles(spark):
    n = nodes(spark, [("x", "x", "cycle.rs"), ("y", "y", "cycle.rs"), ("p", "p", "other.rs"), ("q", "q", "other.rs"), ("s", "s", "other.rs")])
    e = edges(spark, [("x", "y"), ("y", "x"), ("p", "q"), ("s", "s"), ("y", "p")])
    assert [(r.size, r.members) for r in graph.cycles(n, e).collect()] == [(2, "x, y")]
    assert graph.cycles(n, e, source="other.rs").count() == graph.cycles(n, e, relations=()).count() == graph.cycles(n, e, relations=("imports",)).count() == 0


def test_components_of_several_loops(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("z", "y"), ("y", "z"), ("b", "y")])
    for one_task in (0, 100):
        assert {(r.id, r.component) for r in graph.components_of(e, one_task).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("y", "y"), ("z", "y")}


def test_hub_is_visited_but_not_passed(spark):
    n = nodes(spark, [("seed", "seed", "src/seed.rs"), ("hub",), *((f"noise_{i}",) for i in range(15))])
    e = edges(spark, [("seed", "hub"), *(("hub", f"noise_{i}") for i in range(15))])
    assert graph.bfs(n, e, ["seed"], 3).count() >= 16
    assert {r.id for r in graph.bfs(n, e, ["seed"], 3, hub=10).collect()} == {"seed", "hub"}
    assert {r.id for r in graph.bfs(n, e, ["seed"], 3, source="seed.rs").collect()} == {"seed"}


def test_hubs_leave_out_method_stubs_and_files(spark):
    n = nodes(spark, [("ok", "ok()", "src/a.rs"), ("p", "Server::process", "src/server.rs"), ("m", ".m()", "src/a.rs"), ("a", "a", "src/a.rs"), ("c", "concept", ""), *((f"x{i}", f"x{i}", "src/x.rs") for i in range(6))])
    e = edges(spark, [*(("ok", f"x{i}") for i in range(6)), *(("p", f"x{i}") for i in range(3)), *(("m", f"x{i}") for i in range(6)), *(("a", f"x{i}") for i in range(6)), *(("c", f"x{i}") for i in range(6))])
    assert [(r.label, r.degree) for r in graph.god_nodes(n, e, 1).collect()] == [("ok()", 6)]
    assert [r.label for r in graph.god_nodes(n, e, 5, source="server.rs").collect()] == ["Server::process"]


def test_cohesion_and_differences(spark):
    n = nodes(spark, [("a", "a", "f", 1), ("b", "b", "f", 1), ("c", "c", "f", 1), ("d", "d", "f", 2)])
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    assert {r.community: round(r.cohesion, 6) for r in graph.cohesion(n, e).collect()} == {1: round(2 / 3, 6), 2: 1.0}
    assert {(r.id, r.change) for r in graph.difference(n, nodes(spark, [("a",), ("z",)]), ["id"]).collect()} == {("z", "added"), ("b", "removed"), ("c", "removed"), ("d", "removed")}


def test_dfs_is_in_order(spark, calls):
    assert graph.dfs(calls[1], ["a"], 3) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def test_communities_hold_together(spark):
    names = [f"{g}{i}" for g in "pqr" for i in range(8)]
    rows = [(f"{g}{i}", f"{g}{j}") for g in "pqr" for i in range(8) for j in range(i) if (i + j) % 3] + [("p0", "q0"), ("q1", "r1")]
    n, e = nodes(spark, [(x,) for x in names] + [("alone",)]), edges(spark, rows)
    labels = community.modularity_labels(n, e, 20)
    found = {r.id: r.community for r in labels.collect()}
    assert set(found) == {*names, "alone"} and found["alone"] == "alone"
    assert community.modularity(e, labels) > 0.5
    parts = community.clusters(n, e).collect()
    assert len(parts) == 25 and {r.id for r in parts} == {*names, "alone"}


def test_local_moving_ends_when_no_node_would_move(spark):
    names = [f"c{i:03}" for i in range(200)]
    n, e = nodes(spark, [(x,) for x in names]), edges(spark, list(zip(names, names[1:], strict=False)))
    with pytest.warns(UserWarning, match="still move"):
        community.modularity_labels(n, e, 2, one_task=0)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        ways = [{r.id: r.community for r in community.modularity_labels(n, e, one_task=most).collect()} for most in (0, 1000)]
    near = {x: [names[j] for j in (i - 1, i + 1) if 0 <= j < 200] for i, x in enumerate(names)}
    gain = lambda x, c: sum(of[y] == c for y in near[x]) - len(near[x]) * sum(len(near[y]) for y in names if of[y] == c and y != x) / 398
    for of in ways:
        assert all(gain(x, of[y]) <= gain(x, of[x]) + 1e-6 for x in names for y in near[x])


def test_ancestors_of_any_distance(spark):
    e = edges(spark, [(f"k{i}", f"k{i + 1}", "extends") for i in range(36)] + [("k36", "k35", "extends")])
    found = {(r["class"], r.ancestor): r.distance for r in analyze.class_ancestors(e).collect()}
    assert found["k0", "k36"] == 36 and len(found) == 37 * 38 // 2 + 1


def test_dfs_query_walks_all_relations(spark, monkeypatch, calls):
    monkeypatch.setattr(graph_queries, "_ne", lambda *_: calls)
    assert [(r.id, r.depth) for r in graph_queries.dfs_order(spark, "").orderBy("place").collect()] == [("b", 0), ("a", 1), ("c", 1), ("d", 1)]


def test_parity_gaps(spark):
    n = nodes(spark, [("1", "hurryUp", "left/a.rs"), ("2", "close", "left/a.rs"), ("3", "ignoreGUIDs", "left/a.rs"), ("4", "hurry_up", "right/b.rs"), ("5", "close", "right/b.rs"), ("6", "process_ignore_guids", "right/b.rs"), ("7", "tickIgnoreGuids", "right/c.rs")])
    e = edges(spark, [("1", "3"), ("2", "3")])
    gaps = analyze.gaps(n, e, "left/", "right/")
    assert [r.label for r in gaps.collect()] == ["ignoreGUIDs"]
    assert [(r.id, r.place) for r in analyze.gap_candidates(gaps, n, "right/", 0.1, 3).orderBy("place").collect()] == [("6", 1), ("7", 2)]


def test_renames(spark):
    n = spark.createDataFrame([("n1", "handle_search_request", "code", "src/server.rs", "L1", 0, "u1", "h9"), ("n2", "other", "code", "lib/x.rs", "L1", 0, "u2", "h1")], NODE)
    l = spark.createDataFrame([("k", "gone", False, "src/server.rs::handle_search", "h0"), ("k", "gone2", False, "src/server.rs::zzz", "h1"), ("k", "u1", False, "src/server.rs::x", "")], "knowledge_uuid string, node_uuid string, is_knowledge boolean, linked_logical_key string, linked_body_hash string")  # noqa: E741
    got = {(r.node_uuid, r.id): round(r.score, 6) for r in analyze.renames(n, l, 0.4, 3).collect()}
    assert got == {("gone", "n1"): round(0.4 + 0.4 * 2 / 3, 6), ("gone2", "n1"): 0.4, ("gone2", "n2"): 0.9}


def test_edges_are_resolved(spark):
    raw = spark.createDataFrame([("A-b", "c", "Calls ", "EXTRACTED", "f", None, 1.0), ("a_b", "C", "calls", "EXTRACTED", "f", None, 1.0), ("a_b", "no", "calls", "EXTRACTED", "f", None, 1.0), (None, "c", "calls", "EXTRACTED", "f", None, 1.0)], "source string, target string, relation string, confidence string, source_file string, source_location string, weight double")
    assert [(r.source, r.target, r.relation) for r in relations.resolve_edges(raw, nodes(spark, [("a_b",), ("c",)])).collect()] == [("a_b", "c", "calls")]


PY = "import os\nfrom pkg.base import Base\n\n# NOTE: keep this small\nclass FileReader(Base):\n    '''Reads the files of a folder.'''\n    def read(self):\n        return parse(self)\n\ndef main():\n    FileReader().read()\n"
RS = "use std::fs;\npub struct Store {}\nimpl Store {\n    pub fn open(&self) {\n        helper();\n    }\n}\nfn helper() {\n}\n"
JS = "import x from './lib/util'\nclass DataLoader extends Loader {\n  load(a) {\n    processData(a)\n  }\n}\nfunction processData(a) {\n  return a\n}\n"


def test_extraction(spark):
    files = spark.createDataFrame([("p/reader.py", PY, "python"), ("s/store.rs", RS, "rust"), ("w/loader.js", JS, "javascript"), ("bad.py", "def (", "python"), ("e.py", "", "python"), ("n.py", None, "python")], "path string, content string, language string")
    n, e, c = extract.tables(extract.extract(files))
    labels = {r.label for r in n.collect()}
    assert {"FileReader", ".read()", "main()", "Store", ".open()", "helper()", "DataLoader", ".load()", "processData()", "bad", "e"} <= labels
    rows = {(r.source, r.target, r.relation) for r in e.collect()}
    assert {("reader", "reader_filereader", "contains"), ("reader_filereader", "reader_filereader_read", "method"), ("store_store", "store_store_open", "method"), ("loader", "loader_processdata", "contains")} <= rows
    assert any(r == "rationale_for" for *_, r in rows)
    assert {(r.caller, r.callee) for r in c.collect()} >= {("reader_filereader_read", "parse"), ("store_store_open", "helper"), ("loader_dataloader_load", "processdata"), ("reader_main", "read")}
    resolved = {tuple(r) for r in analyze.resolve_calls(n, e, c.select("caller", "callee")).collect()}
    assert {("store_store_open", "helper", "store_helper"), ("loader_dataloader_load", "processdata", "loader_processdata"), ("reader_main", "read", "reader_filereader_read")} <= resolved
    by_receiver = {tuple(r) for r in analyze.resolve_calls(n, e, c).collect()}
    assert {("store_store_open", "helper", "store_helper"), ("loader_dataloader_load", "processdata", "loader_processdata")} <= by_receiver
    deep = "x = " + "[" * 150 + "]" * 150 + "\ndef f():\n    pass\n"
    assert any(r.get("label") == "f()" for r in extract.extract_file("d.py", deep, "python"))


def test_calls_by_receiver(spark):
    names = [("base", "Base"), ("sub", "Sub"), ("other", "Other"), ("base_run", ".run()"), ("sub_go", ".go()"), ("other_run", ".run()"), ("other_go", ".go()"), ("main", "main()"), ("sub_run", ".run()")]
    n = nodes(spark, names)
    e = edges(spark, [("base", "base_run", "method"), ("sub", "sub_go", "method"), ("other", "other_run", "method"), ("other", "other_go", "method"), ("sub", "sub_run", "method"), ("sub", "base", "extends")])
    calls = [("sub_go", "run", "self"), ("sub_go", "RUN", "super()"), ("main", "go", "Sub"), ("main", "run", None), ("base_run", "go", "self"), ("main", "run", "nobody"), ("main", "main", None)]
    raw = spark.createDataFrame(calls, "caller string, callee string, receiver string")
    got = {tuple(r) for r in analyze.resolve_calls(n, e, raw.where("receiver != 'super()' OR receiver IS NULL")).collect()}
    assert got == {("sub_go", "run", "sub_run"), ("main", "go", "sub_go")}
    assert {tuple(r) for r in analyze.resolve_calls(n, e, raw.where("receiver = 'super()'")).collect()} == {("sub_go", "run", "base_run")}
    inherited = analyze.resolve_calls(n.where("id != 'sub_run'"), e.where("target != 'sub_run'"), spark.createDataFrame([("main", "run", "Sub")], "caller string, callee string, receiver string"))
    assert [r.target for r in inherited.collect()] == ["base_run"]


def test_query_graph_falls_back_and_fits(spark):
    n = nodes(spark, [("a", "alpha", "x/a.py", 1), ("b", "beta", "x/b.py", 1), ("c", "gamma", "y/c.py", 2)])
    e = edges(spark, [("a", "b"), ("b", "c")])
    assert {r.id for r in graph.query_graph(n, e, "alpha", 1).collect()} == {"a", "b"}
    assert graph.query_graph(n, e, "nothing", 1).count() == 0
    assert {r.id: r.depth for r in graph.query_graph(n, e, "nothing", 1, source="X/").collect()} == {"a": 0, "b": 0}
    assert {r.id for r in graph.query_graph(n, e, "alph gm", 1, fuzzy=True).collect()} == set()
    assert {r.id: r.depth for r in graph.query_graph(n, e, "gmma", 1, fuzzy=True).collect()} == {"c": 0, "b": 1}
    found = graph.query_graph(n, e, "alpha", 1)
    assert graph.rendered(found, e, 100).splitlines() == ["NODE alpha [x/a.py]", "NODE beta [x/b.py]", "EDGE alpha --calls--> beta"]
    assert graph.rendered(found, e, 6) == "NODE alpha [x/a.py]"


def test_hierarchy_of_folders(spark):
    n = nodes(spark, [("f", "m", "proj/src/core/m.py"), ("g", "n", "proj/n.py"), ("h", "z", "z.py")]).withColumn("source_location", F.lit("L1"))
    files = spark.createDataFrame([("proj/src/core/__init__.py",), ("proj/app.csproj",)], "source_file string")
    made, held = graph.hierarchy(n, files)
    assert {(r.id, r.label, r.file_type, r.norm_label) for r in made.collect()} == {("proj", "proj", "document", "crate"), ("proj_src_core", "core", "code", "crate")}
    assert {(r.source, r.target) for r in held.collect()} == {("proj", "proj_src_core"), ("proj_src_core", "f"), ("proj", "g")}


def test_gaps_with_options(spark):
    n = nodes(spark, [("a", "searchIndex", "l/include/a.h"), ("b", "searchTree", "l/b.c"), ("c", "other", "r/c.c")]).withColumn("file_type", F.when(F.col("id") == "b", "document").otherwise("code"))
    e = edges(spark, [("a", "b"), ("c", "a")])
    names = lambda **o: {r.label for r in analyze.gaps(n, e, "l/", "r/", **o).collect()}
    assert names() == {"searchIndex", "searchTree"} and names(file_type="code") == {"searchIndex"} and names(label="TREE") == {"searchTree"}
    assert names(min_degree=2) == {"searchIndex"} and names(public="/include/", public_only=True) == {"searchIndex"}


def test_co_changes_know_other_forms_of_a_name(spark):
    c = spark.createDataFrame([("r", "1", "a/foo.rs"), ("r", "1", "x"), ("r", "2", "root/a/foo.rs"), ("r", "2", "x"), ("r", "3", "y")], "repo string, commit_id string, file string")
    got = {r.file: (r.commits, r.target_commits) for r in analyze.co_changes(c, spark.createDataFrame([("r", "./a/foo.rs")], "repo string, target string")).collect()}
    assert got == {"x": (2, 2), "root/a/foo.rs": (1, 2)}


def test_dfs_walks_more_edges_than_a_driver_took(spark):
    ids = spark.range(210_000).select(F.format_string("n%06d", "id").alias("t"))
    e = ids.select(F.lit("hub").alias("source"), F.col("t").alias("target"), F.lit("calls").alias("relation"))
    rows = graph.dfs_rows(e.unionByName(e.select(F.col("target").alias("source"), F.concat("target", F.lit("x")).alias("target"), "relation").limit(5)), ["hub", "n000003", "alone"], 2)
    assert rows.count() == 210_007 and rows.agg(F.max("place")).first()[0] == 210_006
    first = [(r.id, r.depth) for r in rows.where("place < 5 OR place > 210004").orderBy("place").collect()]
    assert first[0] == ("hub", 0) and first[1] == ("n000000", 1) and first[-1] == ("alone", 0) and first[-2] == ("n209999", 1)


def test_dfs_is_that_of_the_recursive_walk(spark):
    pairs = sorted({(f"v{i}", f"v{i * k % 41}") for i in range(41) for k in (2, 7, 11)})
    e, seen, order = edges(spark, pairs), set(), []

    def walk(v, d):
        seen.add(v)
        order.append((v, d))
        for w in sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) if d < 3 else []:
            if w not in seen:
                walk(w, d + 1)

    for s in ("v7", "v40"):
        if s not in seen:
            walk(s, 0)
    assert graph.dfs(e, ["v7", "v40"], 3) == order


def test_communities_of_more_edges_take_one_task(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(community, "cut", lambda df, own=community.cut: cuts.append(1) or own(df))
    i = spark.range(300_001).select(F.format_string("n%06d", "id").alias("source"))
    e = i.select("source", F.concat("source", F.lit("x")).alias("target"), F.lit(2.0).alias("weight"))
    labels = community.modularity_labels(i.select(F.col("source").alias("id")), e)
    assert len(cuts) == 1 and labels.select("community").distinct().count() == 300_001
